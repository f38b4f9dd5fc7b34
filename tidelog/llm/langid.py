"""Language ID: script ranges, word scores and Viterbi spans.

The model holds, for each language, log chances of hashed character 1- to 4-grams of lower-cased words
(with word ends) and the scripts that its texts use. For each word of a text the scripts of its
letters leave only languages that use them; n-gram scores rate those; and Viterbi with a penalty for
each switch labels runs of words, so mixed texts give several spans. The language of most letters
is the text's.

The best path is found exactly and in two steps: a constant path is best if no other language gains
more than half the penalty on any run of words (m runs of other languages cost m - 1 switches at least,
and m where the constant language comes in at all). The largest gain is found by prefix sums, for a whole
batch at once; only texts with a larger one are labelled step by step.

Training takes a bounded sample (TRAIN_ROWS rows with the smallest hashed ids) of rows with text and
language. Edge cases: null, empty and letterless texts are ``und`` with score 0; a null language is
not learned; with nothing learned everything is ``und``; very long texts are read whole; repeated
rows are labelled as often as they come; of languages with equal scores the first in order of names
wins; other columns pass through untouched, but for those with the names of the added ones, which are replaced;
an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import common

#: Bounds of the training sample and of the number of languages.
TRAIN_ROWS, MAX_LANGS = 6_000, 250
BUCKETS = 1 << 17
#: Cost of a switch in nats; chance of a script below which a language is taken not to use it.
SWITCH, SCRIPT_SHARE = 8.0, 0.005
#: A word's score is bounded to this many nats against the best language, so no word decides alone.
WORD_BOUND = 6.0
CACHE = 200_000
#: First code point of each script range and the script's number (0: no letter's script).
RANGES = (
    (0x0000, 0), (0x0041, 1), (0x02B0, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6),
    (0x0700, 0), (0x0900, 7), (0x0980, 8), (0x0E00, 9), (0x0E80, 0), (0x10A0, 10), (0x1100, 11), (0x1200, 0),
    (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 12), (0x3100, 0), (0x3400, 13), (0xA000, 0), (0xAC00, 11),
    (0xD7B0, 0), (0xF900, 13), (0xFB00, 0), (0x20000, 13), (0x30000, 0),
)
_FIRST = np.array([a for a, _ in RANGES], np.int64)
_SCRIPT = np.array([s for _, s in RANGES], np.int64)
N_SCRIPTS = 14
#: Letters are the code points of category L: digits of all kinds, fractions and letter-like numbers are none.
_LETTERS = regex.compile(r"\p{L}+")


#: Bytes that part words: everything of ASCII but letters; A-Z become a-z.
_TABLE = bytes((c | 32) if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text) -> list[bytes]:
    """Runs of letters and other characters beyond ASCII; spans count these words."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram, letters of each word, and scripts of each word as bits.

    A word's n-grams are taken of its letters alone, with a mark at both ends.
    """
    cores = [w.decode() if w.isascii() else "".join(_LETTERS.findall(w.decode("utf-8", "replace").lower())) for w in words]
    sizes = np.array([len(c) for c in cores], np.int64)
    codes = _codes("".join(f" {c} " for c in cores))
    word = np.repeat(np.arange(len(words)), sizes + 2)
    grams, of = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, 5):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :].astype(np.uint64) + np.uint64(n)
        inside = word[: len(word) - n + 1] == word[n - 1 :]
        inside &= sizes[word[: len(inside)]] > 0
        x = h[inside]
        grams.append(((x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(BUCKETS))
        of.append(word[: len(inside)][inside])
    script = _SCRIPT[np.searchsorted(_FIRST, codes, "right") - 1]
    bits = np.zeros(len(words), np.int64)
    np.bitwise_or.at(bits, word, np.where(script > 0, 1 << script, 0))
    return np.concatenate(of) if of else word[:0], (np.concatenate(grams) if grams else h).astype(np.int64), sizes, bits


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        """``counts`` is langs x BUCKETS, ``scripts`` is langs x N_SCRIPTS (letters)."""
        self.langs = langs
        total = counts.sum(1, keepdims=True)
        self.logp = np.log((counts + 0.5) / (total + 0.5 * BUCKETS)).T.astype(np.float32)
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        self.uses = share >= SCRIPT_SHARE
        self.known, self.score, self.letters = {}, np.zeros((0, len(langs)), np.float32), np.zeros(0, np.int64)

    def word_scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Score of each word in each language (best 0, bounded below), and its letters."""
        of, gram, sizes, bits = word_grams(words)
        out = np.zeros((len(words), len(self.langs)))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(of, self.logp[gram, k], minlength=len(words))
        # An n-gram overlaps its neighbours, so their evidence counts once for each length.
        out /= 4.0
        used = (bits[:, None] >> np.arange(N_SCRIPTS)) & 1
        fits = (used @ self.uses.T.astype(np.int64)) == used.sum(1, keepdims=True)
        fits |= ~fits.any(1, keepdims=True)
        out = np.where(fits, out, -np.inf)
        out = np.maximum(out - out.max(1, keepdims=True), -WORD_BOUND) * (sizes > 0)[:, None]
        return out.astype(np.float32), sizes

    def scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        missing = set(words).difference(self.known)
        if len(self.known) + len(missing) > CACHE:
            self.known, self.score, self.letters = {}, self.score[:0], self.letters[:0]
            missing = set(words)
        if missing:
            unlike = list(missing)
            score, letters = self.word_scores(unlike)
            self.known.update(zip(unlike, range(len(self.known), len(self.known) + len(unlike)), strict=True))
            self.score, self.letters = np.concatenate([self.score, score]), np.concatenate([self.letters, letters])
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return self.score[at], self.letters[at]


def viterbi(score: np.ndarray, penalty: float = SWITCH) -> list[int]:
    """The best path through rows of ``score``, step by step; a tie stays."""
    rows = score.tolist()
    best, seen, tops = rows[0], [], []
    for row in rows[1:]:
        top = max(best)
        seen.append(best)
        tops.append(top)
        top -= penalty
        best = [(x if x >= top else top) + s for x, s in zip(best, row)]  # noqa: B905
    state = best.index(max(best))
    path = [state]
    for values, top in zip(reversed(seen), reversed(tops)):  # noqa: B905
        if values[state] < top - penalty:
            state = values.index(top)
        path.append(state)
    path.reverse()
    return path


def paths(score: np.ndarray, sizes: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best path of each of several texts whose words follow each other."""
    n, k = score.shape
    if not n:
        return np.zeros(0, np.int64)
    some = np.flatnonzero(sizes)
    ends = np.cumsum(sizes)[some]
    starts = ends - sizes[some]
    text = np.repeat(np.arange(len(some)), sizes[some])
    total = np.add.reduceat(score.astype(float), starts, axis=0)
    lead = total.argmax(1)
    path = lead[text]
    base = score[np.arange(n), path].astype(float)
    mixed = np.zeros(len(some), bool)
    lift = float(WORD_BOUND * sizes.max() * 2 + 1)
    for j in range(k):
        gain = np.cumsum(score[:, j] - base)
        before = np.concatenate([[0.0], gain[:-1]])
        gain, before = gain - before[starts][text], before - before[starts][text]
        low = np.minimum.accumulate(before - lift * text) + lift * text  # lowest prefix of the text so far
        mixed |= np.maximum.reduceat(gain - low, starts) > penalty / 2
    for i in np.flatnonzero(mixed):
        path[starts[i] : ends[i]] = viterbi(score[starts[i] : ends[i]], penalty)
    return path


def label(model: Model, texts: list) -> tuple[list, list, list]:
    """(language, share of letters, spans) of each text; a span is [first word, end word, language]."""
    if not model.langs:
        return ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    words = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    score, letters = model.scores([w for ws in words for w in ws])
    path = paths(score, sizes)
    langs, shares, spans, at = [], [], [], 0
    for n in sizes.tolist():
        p, heavy = path[at : at + n], letters[at : at + n]
        at += n
        weight = np.bincount(p, heavy, minlength=len(model.langs))
        if not weight.sum():
            langs.append("und"), shares.append(0.0), spans.append([])
            continue
        top = int(weight.argmax())
        langs.append(model.langs[top])
        shares.append(float(weight[top] / weight.sum()))
        cut = np.concatenate([[0], np.flatnonzero(p[1:] != p[:-1]) + 1, [n]]).tolist()
        spans.append([(a, b, model.langs[p[a]]) for a, b in zip(cut[:-1], cut[1:], strict=True)])
    return langs, shares, spans


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> bytes:
    """A model (pickled counts) from at most ``rows`` rows with text and language."""
    have = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    have = have.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    chosen = have.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(rows)  # bounded, so broadcast

    def count(batches):
        grams, scripts = {}, {}
        for batch in batches:
            for lang, text in zip(common.strings(batch, "lang"), common.strings(batch, "text"), strict=True):
                of, gram, sizes, _ = word_grams(words_of(text))
                grams[lang] = grams.get(lang, 0) + np.bincount(gram, minlength=BUCKETS)
                script = _SCRIPT[np.searchsorted(_FIRST, _codes("".join(_LETTERS.findall(text))), "right") - 1]
                scripts[lang] = scripts.get(lang, 0) + np.bincount(script, minlength=N_SCRIPTS)
        for lang, g in grams.items():
            at = np.flatnonzero(g)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(g[at])], names=["lang", "bucket", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * N_SCRIPTS, pa.string()), pa.array(np.arange(N_SCRIPTS) - N_SCRIPTS), pa.array(scripts[lang])], names=["lang", "bucket", "n"])

    # At most MAX_LANGS rows of two packed arrays come to the driver.
    counted = have.join(F.broadcast(chosen), "id", "left_semi").mapInArrow(count, "lang string, bucket long, n long")
    summed = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = summed.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("x")).orderBy("lang").limit(MAX_LANGS + 1)
    found = found.select("lang", F.transform("x", lambda s: s["bucket"].cast("int")).alias("b"), F.transform("x", lambda s: s["n"].cast("int")).alias("n")).toArrow()
    if found.num_rows > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = found.column("lang").to_pylist()
    grams, scripts = np.zeros((len(langs), BUCKETS), np.int32), np.zeros((len(langs), N_SCRIPTS), np.int64)
    for k in range(len(langs)):
        b, n = (np.array(found.column(c)[k].values) for c in ("b", "n"))
        grams[k, b[b >= 0]] = n[b >= 0]
        scripts[k, b[b < 0] + N_SCRIPTS] = n[b < 0]
    scripts[:, 0] = 0
    return pickle.dumps((langs, grams, scripts))


_models: dict[int, Model] = {}


def with_language(docs: DataFrame, model: bytes, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", spans_col: str = "spans") -> DataFrame:
    """``docs`` with predicted language, its share of the letters, and the spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_LANGS x BUCKETS counts at most
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def compute(texts):
        m = _models.get(0)
        if m is None or m.key is not shared.value:
            m = Model(*pickle.loads(shared.value))
            m.key = shared.value
            _models[0] = m
        parts = [label(m, texts[k : k + 250]) for k in range(0, len(texts), 250)]
        out = [[x for p in parts for x in p[c]] for c in range(3)]
        return [out[0], out[1], [[dict(zip(("first", "end", "lang"), s, strict=True)) for s in spans] for spans in out[2]]]

    return common.with_added(docs, text_col, [(lang_col, pa.string(), T.StringType()), (score_col, pa.float64(), T.DoubleType()), (spans_col, span, T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])))], compute)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: a language for every document, and its spans of one language as JSON; rows with crc32(id) mod 4 = 2 are held out of training."""
    common.tune(spark)
    docs = common.read(spark, sf_dir, "documents")
    held_out = common.crc32_of_id("doc_id") % 4 == 2
    model = fit(docs.where(~held_out))
    out = with_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"), F.to_json("spans").alias("spans"))
