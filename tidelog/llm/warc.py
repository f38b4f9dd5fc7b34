"""WARC files and a Merkle fixity audit of their replicas.

``write`` stores pages as gzip-compressed WARC records (a member each) and returns an index of
records. ``leaves`` hashes the stored bytes of each record of a replica; ``levels`` hashes runs of
FAN ordered children, each with its offset range, up to one root for a file, and on over files to
one root. ``audit`` compares the roots of two replicas and goes down only where digests differ,
level by level, to the damaged records.

Tasks name their files anew in each attempt and only files in the index count. Nothing is gathered
by file: a node has FAN children at most.

Edge cases: null url and html are empty; control characters of a url are percent-encoded, so none can end a header line; repeated pages are records of their own; a missing file or a
short one gives leaves without digest, which differ from any; an empty table writes no record
and its audit is empty; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import os
import re
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common

#: Children of an inner node.
FAN = 32
#: Records that one task reads in a row.
RUN = 512
INDEX = "page_id long, file_no long, name string, seq long, first long, last long, record_bytes long, block_digest string"


_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def record(page_id, url: str, html: str, date: str) -> tuple[bytes, str]:
    """One WARC resource record of ``date`` (ISO, seconds, Z) and the SHA-256 of its block."""
    block = html.encode("utf-8", "replace")
    digest = hashlib.sha256(block).hexdigest()
    head = (
        f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Date: {date}\r\n"
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>\r\n"
        f"WARC-Target-URI: {_CONTROL.sub(lambda c: f'%{ord(c[0]):02X}', url)}\r\nWARC-Block-Digest: sha256:{digest}\r\n"
        f"Content-Type: text/html\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode("utf-8", "replace") + block + b"\r\n\r\n", digest


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def write(pages: DataFrame, folder: str, date: str | None = None) -> DataFrame:
    """Store ``pages(page_id, url, html)`` as records of ``date`` (now, if none); returns the index, with byte ranges [first, last)."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        from pyspark import TaskContext

        part, out, at, seq, name = TaskContext.get().partitionId(), None, 0, 0, ""
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.warc.gz"
                    fs, inner = pafs.FileSystem.from_uri(f"{folder}/{name}")
                    fs.create_dir(os.path.dirname(inner), recursive=True)
                    out = fs.open_output_stream(inner, compression=None)
                data, digest = record(page_id, url or "", html or "", date)
                member = gzip.compress(data, 4, mtime=0)
                out.write(member)
                rows.append((page_id, part, name, seq, at, at + len(member), len(data), digest))
                at, seq = at + len(member), seq + 1
            if rows:
                yield _batch(rows)
        if out is not None:
            out.close()

    narrow = pages.select(F.col("page_id").cast("long"), "url", "html")
    return common.materialize(narrow.mapInArrow(run, INDEX), "warc-index")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _by_run(index: DataFrame) -> DataFrame:
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = F.floor(F.col("seq") / RUN)
    return index.select("file_no", "name", "seq", "first", "last").repartition(parts, "file_no", run).sortWithinPartitions("file_no", "seq")


def _stored(index: DataFrame, folder: str, schema: str, of) -> DataFrame:
    """Columns made by ``of(list of stored bytes or None)`` for each record of a replica, after file_no, seq, first and last."""

    def run(batches):
        opened, f, size = None, None, 0
        for batch in batches:
            found = []
            for _, name, _, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != opened:
                    if f is not None:
                        f.close()
                    fs, inner = pafs.FileSystem.from_uri(f"{folder}/{name}")
                    try:
                        f = fs.open_input_file(inner)
                        size = f.size()
                    except FileNotFoundError:
                        f, size = None, 0
                    opened = name
                found.append(of(f.read_at(last - first, first) if f is not None and last <= size else None))
            columns = [*(batch.column(k) for k in (0, 2, 3, 4)), *(pa.array(x) for x in zip(*found, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=["file_no", "seq", "first", "last", *(x.split()[0] for x in schema.split(", "))]).cast(kinds)
        if f is not None:
            f.close()

    types = {"string": pa.string(), "long": pa.int64()}
    whole = "file_no long, seq long, first long, last long, " + schema
    kinds = pa.schema([(n, types[k]) for n, k in map(str.split, whole.split(", "))])
    return _by_run(index).mapInArrow(run, whole)


def leaves(index: DataFrame, folder: str) -> DataFrame:
    """(file_no, seq, first, last, digest) of the stored bytes of every record under ``folder``."""
    return _stored(index, folder, "digest string", lambda data: (None if data is None else hashlib.sha256(data).hexdigest(),))


def _read(data: bytes | None) -> tuple:
    try:
        whole = gzip.decompress(data)
        headers, block = parse(whole)
    except (TypeError, OSError, EOFError, ValueError, KeyError, zlib.error):
        return None, None, None
    return len(whole), hashlib.sha256(block).hexdigest(), headers.get("WARC-Block-Digest", "").removeprefix("sha256:")


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """(file_no, seq, first, last, record_bytes, block_digest, stated_digest) of every record as it's stored; nulls where it can't be read."""
    return _stored(index, folder, "record_bytes long, block_digest string, stated_digest string", _read)


def _up(nodes: DataFrame, keys: list[str], at: str) -> DataFrame:
    child = F.concat_ws(":", F.col(at), "first", "last", F.coalesce("digest", F.lit("missing")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), child.alias("text"))))  # FAN at most
    hashed = F.sha2(F.array_join(F.transform(ordered, lambda c: c["text"]), "\n"), 256)
    up = nodes.withColumn("_up", F.floor(F.col(at) / FAN)).groupBy(*keys, "_up").agg(F.min("first").alias("first"), F.max("last").alias("last"), hashed.alias("digest"))
    return up.withColumnRenamed("_up", at)


def levels(leaf: DataFrame, n_records: int, n_files: int) -> list[DataFrame]:
    """Node tables from the leaves to the root; ``n_records`` is the most in a file, ``n_files`` one more than the last number."""
    out = [common.materialize(leaf, "leaves")]
    most = n_records
    while most > 1:
        out.append(common.materialize(_up(out[-1], ["file_no"], "seq"), "nodes"))
        most = -(-most // FAN)
    most = n_files
    while most > 1:
        out.append(common.materialize(_up(out[-1], ["seq"], "file_no"), "nodes"))
        most = -(-most // FAN)
    return out


def audit(index: DataFrame, folder_a: str, folder_b: str) -> DataFrame:
    """(file_no, seq) of the records whose stored bytes differ between two replicas of ``index``."""
    spark = index.sparkSession
    size = index.agg(F.max("seq"), F.max("file_no")).first()
    if size[0] is None:
        return spark.createDataFrame([], "file_no long, seq long")
    n_records, n_files = size[0] + 1, size[1] + 1
    a, b = (levels(leaves(index, folder), n_records, n_files) for folder in (folder_a, folder_b))
    in_file = sum(1 for _ in _powers(n_records))
    bad = None
    for depth in range(len(a) - 1, -1, -1):
        x, y = (side[depth].select("file_no", "seq", F.col("digest").alias(d)) for side, d in ((a, "a"), (b, "b")))
        if bad is not None:  # only below nodes that differ
            key = "seq" if depth + 1 <= in_file else "file_no"
            above = bad.withColumnRenamed(key, "_up")
            x, y = (s.withColumn("_up", F.floor(F.col(key) / FAN)).join(above, [*{"file_no", "seq"}.difference({key}), "_up"], "left_semi") for s in (x, y))
        bad = x.join(y, ["file_no", "seq"], "full_outer").where(F.col("a").isNull() | F.col("b").isNull() | (F.col("a") != F.col("b"))).select("file_no", "seq")
        bad = common.materialize(bad, "differs")
        if bad.isEmpty():
            return spark.createDataFrame([], "file_no long, seq long")
    return bad


def _powers(n: int):
    while n > 1:
        yield n
        n = -(-n // FAN)


def copy(index: DataFrame, folder_a: str, folder_b: str, damaged) -> None:
    """Copy a replica; the middle byte of records whose page_id ``damaged`` names (a condition) is turned over."""
    hit = index.withColumn("_hit", F.coalesce(damaged, F.lit(False)))
    hits = hit.where("_hit").select("name", (F.col("first") + F.floor((F.col("last") - F.col("first")) / 2)).alias("at"))
    # Positions of a file are packed by name; a file has as many records as its writer's partition.
    files = index.select("name").distinct().join(hits.groupBy("name").agg(F.collect_list("at").alias("at")), "name", "left")

    def run(batches):
        for batch in batches:
            for name, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, inner = pafs.FileSystem.from_uri(f"{folder_a}/{name}")
                _, other = pafs.FileSystem.from_uri(f"{folder_b}/{name}")
                fs.create_dir(os.path.dirname(other), recursive=True)
                turned, done = sorted(at or []), 0
                with fs.open_input_stream(inner, compression=None) as src, fs.open_output_stream(other, compression=None) as dst:
                    while chunk := src.read(1 << 20):
                        chunk = bytearray(chunk)
                        for x in turned:
                            if done <= x < done + len(chunk):
                                chunk[x - done] ^= 0xFF
                        dst.write(bytes(chunk))
                        done += len(chunk)
                yield pa.RecordBatch.from_pydict({"bytes": [done]})

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files.repartition(parts).mapInArrow(run, "bytes long").agg(F.sum("bytes")).collect()


#: Every this many page ids, one record of the second replica is damaged in the query.
DAMAGE = 97


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every stored page, and whether the audit finds its record damaged in the second replica."""
    common.tune(spark)
    base = common.scratch_path(spark, "warc")
    index = write(common.read(spark, sf_dir, "pages"), f"{base}/a")
    copy(index, f"{base}/a", f"{base}/b", F.col("page_id") % DAMAGE == 13)
    bad = audit(index, f"{base}/a", f"{base}/b").withColumn("hit", F.lit(True))
    found = read_back(index, f"{base}/a").select("file_no", "seq", "record_bytes", "block_digest", "stated_digest")
    out = index.select("file_no", "seq", "page_id").join(found, ["file_no", "seq"]).join(bad, ["file_no", "seq"], "left")
    status = F.when(F.col("hit"), "differs").when(F.col("block_digest").eqNullSafe(F.col("stated_digest")), "same").otherwise("unreadable")
    return out.select("page_id", "record_bytes", "block_digest", status.alias("status"))


SQL = f"""
WITH r AS (
  SELECT page_id, regexp_replace(coalesce(url, ''), '[\\x00-\\x1f\\x7f]', '%00', 'g') AS url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS block_digest FROM pages)
SELECT page_id,
       CAST(strlen('WARC/1.1' || 'WARC-Type: resource' || 'WARC-Date: 2000-01-01T00:00:00Z' || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, 'null') || '>'
         || 'WARC-Target-URI: ' || url || 'WARC-Block-Digest: sha256:' || block_digest || 'Content-Type: text/html'
         || 'Content-Length: ' || strlen(html)::VARCHAR || html) + 22 AS BIGINT) AS record_bytes,
       block_digest, CASE WHEN page_id % {DAMAGE} = 13 THEN 'differs' ELSE 'same' END AS status
FROM r
"""
