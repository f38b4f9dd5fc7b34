"""Packing by optimal length buckets.

A document's length is its words and one end mark; documents above MAX_LENGTH are cut into pieces of
that length and a rest, so nothing is dropped. The histogram of all piece lengths (MAX_LENGTH entries
at most) goes to the driver, where dynamic programming finds the bucket boundaries with the least
padding. Inside a bucket, pieces in order of id fill batches of floor(budget / boundary) rows.

Ranks inside a bucket come from one range-partitioned sort and a count for each partition and bucket;
no bucket is gathered in a task, and rows that are equal in all of it are dealt by their place in the table.

Edge cases: null and empty texts have length 1; repeated rows are packed as often as they come; null
ids come first; very long texts are cut; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import common

MAX_LENGTH = 2048
BUCKETS = 16
#: Padded tokens of a batch at most.
TOKEN_BUDGET = 32_768


def length_of(text_col: str = "text") -> F.Column:
    """Words (runs of characters other than ASCII white space) and the end mark."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long") + 1


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """At most ``buckets`` upper bounds, the largest length last, with the least padding in all.

    Of several best choices the one with smaller last inner bounds is taken.
    """
    order = np.argsort(lengths)
    x, c = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    m = len(x)
    if not m:
        return []
    n = np.concatenate([[0], np.cumsum(c)])
    s = np.concatenate([[0], np.cumsum(c * x)])
    cost = x * n[1:] - s[1:]  # one bucket for the first lengths
    choice = []
    for _ in range(min(buckets, m) - 1):
        new, back = cost.copy(), np.full(m, -1)
        for j in range(1, m):
            total = cost[:j] + x[j] * (n[j + 1] - n[1 : j + 1]) - (s[j + 1] - s[1 : j + 1])
            k = int(total.argmin())
            if total[k] < new[j]:
                new[j], back[j] = total[k], k
        choice.append(back)
        cost = new
    out, j = [int(x[-1])], m - 1
    for back in reversed(choice):
        if back[j] >= 0:
            j = int(back[j])
            out.append(int(x[j]))
    return out[::-1]


def pieces_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_length: int = MAX_LENGTH, length_col: str | None = None) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens): runs of a document's tokens, whole documents where they fit.

    ``length_col`` has lengths that are known (such as a tokenizer's, the end mark included); without it words are counted.
    """
    length = F.greatest(F.lit(1), F.coalesce(F.col(length_col).cast("long"), F.lit(1))) if length_col else length_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), length.alias("n"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / max_length))))
    first = F.col("piece") * max_length
    return rows.select("doc_id", "piece", first.alias("first_token"), F.least(F.lit(max_length), F.col("n") - first).alias("n_tokens"))


def pack(pieces: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """``pieces`` with bucket (upper bound), batch_id, slot in the batch, and padding."""
    spark = pieces.sparkSession
    pieces = common.materialize(pieces, "pieces")
    seen = pieces.groupBy("n_tokens").count().collect()  # as many rows as there are lengths up to the bound
    counts = {r["n_tokens"]: r["count"] for r in seen}
    bounds = boundaries(np.array(list(counts)), np.array(list(counts.values())), buckets)
    if not bounds:
        return pieces.select("*", *(F.lit(None).cast("long").alias(c) for c in ("bucket", "batch_id", "slot", "padding")))
    bucket = F.lit(None).cast("long")
    base = F.lit(None).cast("long")
    done, low = 0, 0
    for b in bounds:
        bucket = F.when((F.col("n_tokens") > low) & (F.col("n_tokens") <= b), F.lit(b).cast("long")).otherwise(bucket)
        base = F.when(F.col("bucket") == b, F.lit(done).cast("long")).otherwise(base)
        rows = sum(n for x, n in counts.items() if low < x <= b)
        done += -(-rows // max(1, budget // b))
        low = b
    order = ["bucket", "doc_id", "piece", "n_tokens"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Equal rows are told apart by their place in the written table, so many of them aren't one task.
    placed = pieces.withColumns({"bucket": bucket, "_row": F.monotonically_increasing_id()})
    placed = placed.repartitionByRange(parts, *order, "_row").sortWithinPartitions(*order, "_row").drop("_row")
    placed = common.materialize(placed.withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33)
    runs = placed.groupBy(part.alias("part"), F.col("bucket").alias("run_bucket")).agg(F.min("at").alias("first_at"), F.count("*").alias("n"))
    before = Window.partitionBy("run_bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = placed.withColumn("part", part).join(runs, (F.col("bucket") == F.col("run_bucket")) & (runs["part"] == part)).withColumn("rank", F.col("offset") + F.col("at") - F.col("first_at"))
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket")))
    return ranked.select(
        *pieces.columns,
        "bucket",
        (base + F.floor(F.col("rank") / capacity)).alias("batch_id"),
        F.pmod("rank", capacity).alias("slot"),
        (F.col("bucket") - F.col("n_tokens")).alias("padding"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every piece of every document with its bucket and batch."""
    return pack(pieces_of(common.read(spark, sf_dir, "documents")))
