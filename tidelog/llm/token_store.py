"""Token ids in fixed-width bit-packed files.

A file holds the ids of a run of documents, each id in the fewest bits that the vocabulary needs::

    magic "TIDETOK1"
    payload   blocks of BLOCK ids, little-endian bit order, each block padded to a whole byte
    footer    block offsets (blocks + 1, i64), document starts (documents + 1, i64), document ids (i64)
    trailer   bits u32, block u32, ids u64, documents u64, footer offset u64, magic

Any run of ids is found from the block offsets alone, so a reader fetches and unpacks (with numpy)
only the blocks and the parts of the footer that it needs. Files are written in ascending id order by
tasks that own a range of (id, hash of the text, row), so one repeated id, or null ids, are split as well;
a task starts a new file after FILE_DOCS documents or FILE_IDS ids, which bounds the footer. A task names its
files anew in each attempt and a file counts only if the task's row in the manifest names it, so a lost or
repeated task leaves no wrong data.

Memory of a task doesn't follow the data: texts are encoded in pieces of PIECE characters, cut at white
space, and the ids of words are kept in two generations of CACHE_BYTES each.

Edge cases: a null text is an empty one; an empty document has the end id alone; repeated ids follow
each other, ordered by the hash of the text; a null id comes first and is stored as -2**63; very long texts
are read piece by piece; other columns are ignored, whatever their names; an empty table writes no file
and gives an empty result.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import common

MAGIC = b"TIDETOK1"
BLOCK = 4096
TRAILER = struct.Struct("<IIQQQ8s")
NO_ID = -(1 << 63)
#: Bytes that a generation of learned words may take (estimated, with Python's own overhead of ENTRY each).
CACHE_BYTES, ENTRY = 40 << 20, 150
#: Characters of text that are encoded at a time.
PIECE = 1 << 20
#: Documents and ids of a file, after which a task starts the next one.
FILE_DOCS, FILE_IDS = 1 << 20, 1 << 28
#: Documents of a file that one reading task takes, and ids that it holds at a time.
READ_DOCS, READ_IDS = 20_000, 1 << 20
#: The normalizer and pre-tokenizer of tokenizers that may be applied word by word.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Latin-1 bytes of plain texts: ASCII and letters that NFC leaves alone; and the same in lower case.
_PLAIN = bytes([*range(9, 14), *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
_LOWER = bytes(c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
#: PRE_TOKENIZER's pattern for lower-cased plain texts.
_TOKENS = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[!-/:-@\[-`{-~]+")
_BREAK = re.compile(r"[ \t\n\x0b\x0c\r]")


def bits_of(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (spread.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(1).astype(np.uint32)


def _byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level BPE: itself if it prints, else the next free one from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


_BYTES = _byte_alphabet()


class Writer:
    """Streams documents into one file."""

    def __init__(self, path: str, bits: int, block: int = BLOCK):
        fs, inner = pafs.FileSystem.from_uri(path)
        fs.create_dir(os.path.dirname(inner), recursive=True)
        self.out, self.bits, self.block = fs.open_output_stream(inner), bits, block
        self.out.write(MAGIC)
        self.at, self.n_ids = len(MAGIC), 0
        self.offsets, self.starts, self.docs = array("q", [len(MAGIC)]), array("q", [0]), array("q")
        self.rest, self.n_rest = [], 0

    def add(self, ids: np.ndarray, ends: np.ndarray, docs: list[int]) -> None:
        """The next ``ids``; ``ends`` says where in them each of ``docs`` ends. What follows the last end belongs to a document to come."""
        self.starts.extend((self.n_ids + ends).tolist())
        self.docs.extend(docs)
        self.n_ids += len(ids)
        self.rest.append(ids)
        self.n_rest += len(ids)
        if self.n_rest >= self.block:
            flat = np.concatenate(self.rest)
            whole = len(flat) // self.block * self.block
            for k in range(0, whole, self.block):
                self._block(flat[k : k + self.block])
            self.rest, self.n_rest = [flat[whole:].copy()], len(flat) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.at += len(data)
        self.offsets.append(self.at)

    def close(self) -> tuple[int, int]:
        if self.n_rest:
            self._block(np.concatenate(self.rest))
        for part in (self.offsets, self.starts, self.docs):
            self.out.write(np.frombuffer(part, np.int64).astype("<i8").tobytes() if len(part) else b"")
        self.out.write(TRAILER.pack(self.bits, self.block, self.n_ids, len(self.docs), self.at, MAGIC))
        self.out.close()
        return len(self.docs), self.n_ids


class Reader:
    """Random access to one file: only the trailer is read at once."""

    def __init__(self, path: str):
        fs, inner = pafs.FileSystem.from_uri(path)
        self.f = fs.open_input_file(inner)
        size = self.f.size()
        self.bits, self.block, self.n_ids, self.n_docs, self.footer, magic = TRAILER.unpack(self.f.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {path}")
        self.blocks = -(-self.n_ids // self.block)

    def _footer(self, first: int, last: int) -> np.ndarray:
        return np.frombuffer(self.f.read_at(8 * (last - first), self.footer + 8 * first), "<i8")

    def offsets(self, first: int, last: int) -> np.ndarray:
        """Where blocks ``first`` to ``last`` begin; the end of the last block has the number ``blocks``."""
        return self._footer(first, last + 1)

    def starts(self, first: int, last: int) -> np.ndarray:
        """Where documents ``first`` to ``last`` begin; the end of the last one has the number ``n_docs``."""
        return self._footer(self.blocks + 1 + first, self.blocks + 2 + last)

    def docs(self, first: int, last: int) -> np.ndarray:
        """The ids of documents ``first`` up to ``last``, which is left out."""
        at = self.blocks + self.n_docs + 2
        return self._footer(at + first, at + last)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file, reading only the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        offsets = self.offsets(first, last + 1)
        data = self.f.read_at(int(offsets[-1] - offsets[0]), int(offsets[0]))
        if self.block * self.bits % 8 == 0:
            whole = unpack(data, min(self.n_ids, (last + 1) * self.block) - first * self.block, self.bits)
        else:
            cuts = (offsets - offsets[0]).tolist()
            whole = np.concatenate([unpack(data[a:b], min(self.block, self.n_ids - k * self.block), self.bits) for k, a, b in zip(range(first, last + 1), cuts[:-1], cuts[1:], strict=True)])
        return whole[start - first * self.block : stop - first * self.block]

    def close(self) -> None:
        self.f.close()


class Learned:
    """Ids of words: a word's number leads to its run in ``pool``."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.pool, self.used, self.bytes = np.zeros(1 << 16, np.uint32), 0, 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def add(self, words: list[bytes], flat: np.ndarray, size: np.ndarray) -> None:
        """``flat`` has the ids of all ``words`` in a row, ``size`` how many each has."""
        k, total = len(self.at), len(flat)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while k + len(words) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.pool[self.used : self.used + total] = flat
        self.start[k : k + len(words)] = self.used + np.cumsum(size) - size
        self.size[k : k + len(words)] = size
        self.at.update(zip(words, range(k, k + len(words)), strict=True))
        self.used += total
        self.bytes += sum(map(len, words)) + ENTRY * len(words) + 4 * total

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words numbered ``at`` in a row, and where each word's end."""
        size = self.size[at]
        ends = np.cumsum(size, dtype=np.int64)
        return self.pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[at] - (ends - size), size)], ends


class WordEncoder:
    """A public tokenizer, with the ids of common words kept.

    Where its normalizer and pre-tokenizer are the ones above, which never join characters across white space, the ids of a
    text are those of its words in a row, and those of a plain word are those of its pre-tokens. Any other tokenizer gets
    whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        parts = json.loads(self.tok.to_str())
        self.by_word = parts["normalizer"] == NORMALIZER and parts["pre_tokenizer"] == PRE_TOKENIZER and parts["post_processor"] is None
        self.by_word &= all(t["content"].startswith("<|") for t in parts["added_tokens"])
        self.known, self.old = Learned(), Learned()

    def _learn(self, words: set[bytes]) -> None:
        """Keep the ids of each word. A pre-token's bytes go straight to the BPE model in the byte-level alphabet; a word that
        isn't plain (marked by a zero byte) takes the whole tokenizer."""
        if self.old.at:
            seen = self.old.at.keys() & words
            if seen:
                flat, ends = self.old.ids(np.fromiter(map(self.old.at.__getitem__, seen), np.int64, len(seen)))
                self.known.add(list(seen), flat, np.diff(ends, prepend=0))
            words = words - seen
        ids, rest = [], [w for w in words if w[:1] == b"\0"]
        plain = [w for w in words if w[:1] != b"\0"]
        for w in plain:
            text = w.decode("latin-1")
            ids.append([t.id for t in self.tok.model.tokenize(text if text.isascii() else "".join(map(_BYTES.__getitem__, text.encode())))])
        if rest:
            ids += [got.ids for got in self.tok.encode_batch([w[1:].decode("utf-8", "replace") for w in rest], add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.known.add(plain + rest, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum())), size)

    def _words(self, text: str) -> list[bytes]:
        """Pre-tokens of plain words and, marked, other words."""
        try:
            raw = text.encode("latin-1")
            if not raw.translate(None, _PLAIN) and b"<|" not in raw:
                return _TOKENS.findall(raw.translate(_LOWER))
        except UnicodeEncodeError:
            pass
        out = []
        for w in text.encode("utf-8", "replace").split():
            if w.isascii() and b"<|" not in w and not w.translate(None, _PLAIN):
                out += _TOKENS.findall(w.translate(_LOWER))
            else:
                out.append(b"\0" + w)
        return out

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each text's."""
        if not self.by_word:
            got = [x.ids for x in self.tok.encode_batch([(t or "").encode("utf-8", "replace").decode() for t in texts], add_special_tokens=False)]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            return np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes
        words, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                found = self._words(text)
                counts[i] = len(found)
                words += found
        if missing := set(words).difference(self.known.at):
            self._learn(missing)
        flat, ends = self.known.ids(np.fromiter(map(self.known.at.__getitem__, words), np.int64, len(words)))
        of = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        if self.known.bytes > CACHE_BYTES:  # a new generation; what it needs of this one it takes over
            self.known, self.old = Learned(), self.known
        return flat, np.diff(of)

    def pieces(self, texts: list):
        """(texts, whether each is the last piece of its document): at most PIECE characters at a time, cut at white space."""
        some, last, held = [], [], 0
        for text in texts:
            text, at = text or "", 0
            while True:
                end = len(text)
                if self.by_word and end - at > PIECE:
                    cut = _BREAK.search(text, at + PIECE)
                    end = cut.start() if cut else end
                if some and held + end - at > PIECE:
                    yield some, np.array(last)
                    some, last, held = [], [], 0
                some.append(text[at:end])
                last.append(end == len(text))
                held += end - at
                at = end
                if last[-1]:
                    break
        if some:
            yield some, np.array(last)


def with_end(ids: np.ndarray, sizes: np.ndarray, last: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each last piece, and where documents end."""
    more = sizes + last
    out = np.full(int(more.sum()), end_id, np.uint32)
    ends = np.cumsum(more)[last]
    body = np.ones(len(out), bool)
    body[ends - 1] = False
    out[body] = ids
    return out, ends


_encoders: dict[str, WordEncoder] = {}


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write ``docs``; returns the manifest (shard, part, file, n_docs, n_ids, start)."""
    spark = docs.sparkSession
    bits = bits_of(vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(parts, "id", "h", "row").sortWithinPartitions("id", "h", "row").select("id", "text")

    def run(batches):
        from pyspark import TaskContext

        shard, part, out, path = TaskContext.get().partitionId(), 0, None, ""
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, WordEncoder(tokenizer))

        def closed():
            n_docs, n_ids = out.close()
            return pa.RecordBatch.from_pydict({"shard": [shard], "part": [part], "file": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

        for batch in batches:
            names, at = [NO_ID if i is None else i for i in batch.column(0).to_pylist()], 0
            for texts, last in encoder.pieces(batch.column(1).to_pylist()):
                if out is None:
                    path = f"{folder}/shard-{shard:06d}-{part:04d}-{uuid.uuid4().hex}.tok"
                    out = Writer(path, bits)
                ids, ends = with_end(*encoder.encode(texts), last, end_id)
                out.add(ids, ends, names[at : at + len(ends)])
                at += len(ends)
                if last[-1] and (len(out.docs) >= FILE_DOCS or out.n_ids >= FILE_IDS):
                    yield closed()
                    part, out = part + 1, None
        if out is not None:
            yield closed()

    shards = common.materialize(rows.mapInArrow(run, "shard long, part long, file string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _crc(r: Reader, start: int, stop: int) -> int:
    """Of the ids of a document, piece by piece."""
    value = 0
    for a in range(start, stop, READ_IDS):
        value = zlib.crc32(r.ids(a, min(stop, a + READ_IDS)).astype("<u4").tobytes(), value)
    return value


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone."""
    spark = manifest.sparkSession
    cut = F.explode(F.sequence(F.lit(0), F.col("n_docs") - 1, F.lit(READ_DOCS))).alias("first")
    tasks = manifest.where("n_docs > 0").select("file", "start", cut)

    def run(batches):
        for batch in batches:
            for path, base, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = Reader(path)
                last = min(r.n_docs, first + READ_DOCS)
                cuts, a = r.starts(first, last), 0
                while a < last - first:
                    # As many documents as READ_IDS ids make, one at least.
                    b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + READ_IDS, "right")) - 1)
                    if cuts[b] - cuts[a] > READ_IDS:
                        crc = [_crc(r, int(cuts[a]), int(cuts[b]))]
                    else:
                        ids, own = r.ids(int(cuts[a]), int(cuts[b])).astype("<u4"), (cuts[a : b + 1] - cuts[a]).tolist()
                        crc = [zlib.crc32(ids[x:y]) for x, y in zip(own[:-1], own[1:], strict=True)]
                    docs = pa.array([None if d == NO_ID else d for d in r.docs(first + a, first + b).tolist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([docs, pa.array(cuts[a:b] + base), pa.array(np.diff(cuts[a : b + 1])), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    a = b
                r.close()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return tasks.repartition(parts).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every document encoded, written, and read back."""
    import public_tokenizers
    from tokenizers import Tokenizer

    common.tune(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    folder = common.scratch_path(spark, "tokens")
    vocabulary = Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
    return read(write(common.read(spark, sf_dir, "documents"), folder, path, 2, vocabulary))
