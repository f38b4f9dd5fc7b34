"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the hashes (into BUCKETS) of its lower-cased words, of neighbouring word
pairs and of pairs with one word between, each taken once. Learning rates are kept per coordinate
and an L1 term leaves few weights, which travel to every task in a compact form. Training takes a
bounded sample of the labelled rows (TRAIN_ROWS, those with the smallest hashed ids); scoring takes
whole texts of all rows.

Edge cases: null and empty texts get the score of the bias alone; null labels and null ids are not
learned from; repeated rows are scored as often as they come; very long texts are scored whole; training rows of
equal id are taken in the order of their buckets; without any labelled row every score is 0; an empty table gives an
empty result; other columns pass through untouched, but for one with the name of the score, which is replaced.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import common

BUCKETS = 1 << 18
#: Bound of the training sample.
TRAIN_ROWS = 24_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.1
#: Weight of a toxic text in training, as toxic texts are the rarer ones.
TOXIC_WEIGHT = 2.0
#: Words whose hashes a worker keeps.
CACHE = 300_000
_WORD = re.compile(r"[^\W\d_]+")
_cache: dict[str, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def features(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every feature; a row's features may repeat here."""
    words, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            found = _WORD.findall(text.lower())
            sizes[i] = len(found)
            words += found
    missing = set(words).difference(_cache)
    if len(_cache) + len(missing) > CACHE:
        _cache.clear()
        missing = set(words)
    for w in missing:
        b = w.encode("utf-8", "surrogatepass")
        _cache[w] = zlib.crc32(b) << 32 | zlib.adler32(b)
    h = np.fromiter(map(_cache.__getitem__, words), np.uint64, len(words))
    row = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    rows, hashes = [row], [_mix(h)]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xD1B54A32D192ED03)):
        if len(h) > gap:
            inside = row[:-gap] == row[gap:]
            rows.append(row[:-gap][inside])
            hashes.append(_mix((h[:-gap] * np.uint64(salt) + _mix(h[gap:]))[inside]))
    return np.concatenate(rows), (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64)


def _once(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(row * BUCKETS + bucket)
    return key // BUCKETS, key % BUCKETS


class Ftrl:
    """FTRL-proximal state; one update for each text."""

    def __init__(self):
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)  # the last is the bias

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == BUCKETS, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, buckets: np.ndarray, label: int) -> None:
        at = np.append(buckets, BUCKETS)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * (TOXIC_WEIGHT if label else 1.0)
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(rows: list[tuple[int, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights other than zero of (id, buckets, label) rows, taken in an order drawn from the ids."""
    model = Ftrl()
    for epoch in range(EPOCHS):
        for _, buckets, label in sorted(rows, key=lambda r: (zlib.crc32(b"%d %d" % (epoch, r[0])), r[1].tobytes())):
            model.learn(buckets, label)
    w = model.weights(np.arange(BUCKETS + 1))
    at = np.flatnonzero(w)
    return at, w[at]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", rows: int = TRAIN_ROWS) -> tuple[bytes, bytes]:
    """Sparse weights from at most ``rows`` labelled documents (smallest hashed ids first).

    The chosen ids, bounded by ``rows``, are broadcast, so texts are filtered where they are read.
    Features are made in parallel; one task runs the sequential learner on the bounded sample.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").select("id", "text", "label")

    def extract(batches):
        for batch in batches:
            row, bucket = _once(*features(common.strings(batch, "text")))
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            packed = [bucket[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], names=["id", "label", "buckets"])

    def learn(batches):
        got = [(i, np.frombuffer(b, np.int32), y) for batch in batches for i, y, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        at, w = train(got)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())], names=["at", "w"])

    found = sample.mapInArrow(extract, "id long, label int, buckets binary").repartition(1).mapInArrow(learn, "at binary, w binary").collect()
    return (bytes(found[0]["at"]), bytes(found[0]["w"])) if found else (b"", b"")


def score(docs: DataFrame, model: tuple[bytes, bytes], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` and its probability of being toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS + 1 weights at most

    def compute(texts):
        at_bytes, w_bytes = shared.value
        at, w = np.frombuffer(at_bytes, np.int32).astype(np.int64), np.frombuffer(w_bytes)
        if not len(at):
            return [np.zeros(len(texts))]
        dense = np.zeros(BUCKETS + 1)
        dense[at] = w
        row, bucket = features(texts)
        live = dense[bucket] != 0
        row, bucket = _once(row[live], bucket[live])
        sums = np.bincount(row, dense[bucket], minlength=len(texts)) + dense[BUCKETS]
        return [1 / (1 + np.exp(-np.clip(sums, -35, 35)))]

    return common.with_added(docs, text_col, [(score_col, pa.float64(), T.DoubleType())], compute)


def remove_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with the columns of ``docs``."""
    model = fit(docs, labels.select(F.col("doc_id").alias(id_col), F.col("toxic").alias("label")), id_col, text_col)
    name = common.free_name(docs, "toxic_score")
    return score(docs, model, text_col, name).where(F.col(name) < threshold).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: a score for every document; rows with crc32(id) mod 5 = 0 are held out of training."""
    common.tune(spark)
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    held_out = common.crc32_of_id("doc_id") % 5 == 0
    model = fit(docs, labels.where(~held_out))
    return score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
