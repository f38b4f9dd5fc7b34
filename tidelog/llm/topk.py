"""Exact top-k search by inner product over a bit-sliced index.

The index cuts the rows into blocks; for every component of a block and every bit of its quantised
value there is a bitmap over the block's rows. A query adds the slices, each as often shifted as its
own component has bits set, with carry-save adders on whole bitmaps (a negative component adds the
complement instead), which gives the scores of all rows as bit slices. The best k are then selected from
the most significant slice downward; rows tied at the boundary are resolved exactly by score and
smaller id.

Queries stream past the index: a task holds one index block and a batch of queries at a time, so no task and no
broadcast grows with the data. A block is sent once, or as often as it takes to give every core a share of the
queries. Each block gives k rows for each query, which a window merges.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part; only
vectors of the same length are compared; a query never finds its own id; repeated rows are
candidates as often as they come, and a repeated query id is asked once (its smallest vector);
components are 64-bit whole numbers, and scores that could pass 64 bits are an error; rows that share an id are dealt to
different blocks; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import common

#: Rows of an index block, and queries that a task takes at least before a block is sent to another one.
BLOCK_ROWS, BLOCK_QUERIES = 32_768, 512
K, SCALE = 5, 256
#: Quantised components and sums of products stay below this, so 64 bits hold every score and slice.
MAX_WHOLE = 2.0**60


def quantise(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): whole numbers floor(SCALE * x) of every vector that takes part."""
    x = F.col(vector_col)
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    fits = lambda c: F.when(F.abs(c.cast("double")) < MAX_WHOLE / SCALE, F.floor(F.lit(float(SCALE)) * c.cast("double"))).otherwise(F.raise_error(F.lit("a component is too large to score in 64 bits")))
    v = F.transform(x, lambda c: fits(c).cast("long"))
    return df.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def slices_of(values: np.ndarray, low: int, bits: int) -> np.ndarray:
    """Bitmaps (components x bits x 64-bit words) of ``values - low``."""
    n, dims = values.shape
    words = -(-n // 64)
    out = np.zeros((dims, bits, words), np.uint64)
    padded = np.zeros(words * 64, np.uint8)
    for d in range(dims):
        u = values[:, d].astype(np.int64) - low
        for j in range(bits):
            padded[:n] = (u >> j) & 1
            out[d, j] = np.packbits(padded, bitorder="little").view(np.uint64)
    return out


def add_slices(slices: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """Bit slices of sum(|q| * u) where q > 0, and of sum(|q| * (2**bits - 1 - u)) where q < 0."""
    dims, bits, words = slices.shape
    columns: list[list[np.ndarray]] = [[] for _ in range(128)]
    for d in np.flatnonzero(query):
        q = int(query[d])
        rows = slices[d] if q > 0 else ~slices[d]
        size = abs(q)
        for i in range(size.bit_length()):
            if size >> i & 1:
                for j in range(bits):
                    columns[i + j].append(rows[j])
    out = []
    t, u = np.empty(words, np.uint64), np.empty(words, np.uint64)
    for w in range(127):
        stack, up = columns[w], columns[w + 1]
        while len(stack) >= 3:  # full adder
            a, b, c = stack.pop(), stack.pop(), stack.pop()
            np.bitwise_xor(a, b, out=t)
            np.bitwise_and(a, b, out=u)
            total, carry = t ^ c, t & c
            carry |= u
            stack.append(total)
            up.append(carry)
        if len(stack) == 2:  # half adder
            a, b = stack
            stack[:] = [a ^ b]
            up.append(a & b)
        out.append(stack[0] if stack else None)
    while out and out[-1] is None:
        out.pop()
    return [np.zeros(words, np.uint64) if x is None else x for x in out]


def best(score: list[np.ndarray], alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the k highest of the ``alive`` rows; ties go to lower rows."""
    sure, open_ = np.zeros_like(alive), alive
    for s in reversed(score):
        hit = open_ & s
        n = int(np.bitwise_count(sure).sum()) + int(np.bitwise_count(hit).sum())
        if n > k:
            open_ = hit
        else:
            sure = sure | hit
            open_ = open_ & ~s
            if n == k:
                open_ = np.zeros_like(alive)
                break
    at = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    first = at(sure)
    rows = np.concatenate([first, at(open_)[: k - len(first)]])
    value = np.zeros(len(rows), np.int64)
    for w, s in enumerate(score):
        value += ((s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << w
    return rows, value


def build_index(vectors: DataFrame) -> DataFrame:
    """One row a block: ids, slices and how they were made. ``vectors`` is (id, v)."""
    n_blocks = max(1, -(-vectors.count() // BLOCK_ROWS))
    dealt = vectors.withColumn("dims", F.size("v")).withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)))

    def index(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        values = np.stack(rows["v"].to_numpy()).astype(np.int64)
        low = int(values.min())
        bits = max(1, int(values.max() - low).bit_length())
        packed = slices_of(values, low, bits)
        return pd.DataFrame({"dims": [rows["dims"].iloc[0]], "block": [rows["block"].iloc[0]], "n": [len(rows)], "low": [low], "bits": [bits], "ids": [rows["id"].to_numpy(np.int64).tobytes()], "slices": [packed.tobytes()]})

    return common.materialize(dealt.groupBy("dims", "block").applyInPandas(index, "dims int, block long, n long, low long, bits int, ids binary, slices binary"), "slices")


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``vectors(id, v)`` for each of ``queries(id, v)``."""
    vectors = common.materialize(vectors, "vectors")
    queries = common.materialize(queries.groupBy("id").agg(F.min("v").alias("v")), "asked")
    # Slices hold values less the lowest of a block, at most four times the largest component.
    largest = vectors.agg(F.max(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double")))))).first()[0]
    weight = queries.agg(F.max(F.aggregate("v", F.lit(0.0), lambda t, c: t + F.abs(c.cast("double"))))).first()[0]
    if 4 * (largest or 0.0) * (weight or 0.0) >= MAX_WHOLE:
        raise OverflowError("scores of these vectors could pass 64 bits")
    index = build_index(vectors)
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = index.select(F.col("dims").alias("of_dims"), F.col("block").alias("of_block"))
    n_parts = max(1, min(-(-queries.count() // BLOCK_QUERIES), -(-parts // max(1, blocks.count()))))
    asked = queries.withColumn("dims", F.size("v")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n_parts)))
    # Each query goes once to each index block of its length.
    asked = asked.join(blocks, F.col("dims") == F.col("of_dims")).select("dims", F.col("of_block").alias("block"), "part", "id", "v")
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_parts - 1).cast("long"))))
    # Sorted, a block comes before the queries that it's asked.
    none = F.lit(0).cast("long")  # whole numbers without nulls stay whole in pandas
    asked = asked.withColumns({"asks": F.lit(True), "low": none, "bits": F.lit(0)})
    both = index.withColumns({"asks": F.lit(False), "id": none}).unionByName(asked, allowMissingColumns=True)
    key = ["dims", "block", "part"]
    both = both.repartition(max(parts, n_parts), *key).sortWithinPartitions(*key, "asks").select("asks", "id", "v", *key, "low", "bits", "ids", "slices")

    def find(batches):
        now = None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if not r.asks:
                    ids, dims, bits, low = np.frombuffer(r.ids, np.int64), int(r.dims), int(r.bits), int(r.low)
                    slices, now = np.frombuffer(r.slices, np.uint64).reshape(dims, bits, -1), (r.dims, r.block, r.part)
                    everyone = np.zeros(slices.shape[2] * 64, np.uint8)
                    everyone[: len(ids)] = 1
                    full = (1 << bits) - 1
                elif now == (r.dims, r.block, r.part):
                    qid, q = int(r.id), np.asarray(r.v, np.int64)
                    alive = everyone
                    own = slice(*np.searchsorted(ids, [qid, qid + 1]))
                    if own.stop > own.start:
                        alive = everyone.copy()
                        alive[own] = 0
                    rows, value = best(add_slices(slices, q), np.packbits(alive, bitorder="little").view(np.uint64), k)
                    shift = low * int(q.sum()) + full * int(q[q < 0].sum())
                    out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[rows], "score": value + shift}))
            if out:
                yield pd.concat(out)

    parts_of = both.mapInPandas(find, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return parts_of.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the five best of all embeddings for each whose id is divisible by 50."""
    common.tune(spark)
    vectors = quantise(common.read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(vectors, vectors.where("id % 50 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
