"""Chat formatting after the collapse of cumulative snapshots.

Loggers often store a conversation anew after each turn. A conversation is dropped if it equals the
first turns of a longer one; of equal ones that with the smallest id stays. Rolling hashes say so
without comparing texts: a turn's hash covers turn number, rank, role and text, and a prefix's hash
(two independent 64-bit words) is the exclusive or of its turns' hashes; of 10**12 prefixes two differing ones agree
with a chance of some 10**24 / 2**129, or 2 in 10**15. Prefixes that are not
whole conversations form the right side of an anti-join with the whole ones.

No conversation is gathered in one task: turns are dealt by (conversation, CHUNK turn numbers), hashes
and offsets run inside a chunk, and chunks are put in line by a window over one row a chunk.
Rendering gives a row for each turn of a kept conversation, with its place in the rendered text.

All is DataFrame functions. Edge cases: rows with null conv_id belong to no conversation and are
left out; a null turn comes first; null role and text count as empty; repeated rows are turns of
their own; rows with the same turn number are ordered by role and text, and share a task; very long texts are
hashed whole; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import common

#: Turn numbers in a chunk.
CHUNK = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def turns_with_prefixes(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` with position, prefix hashes, length and offset of each turn."""
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        # Turns without a number stand in a chunk before all others.
        F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))).alias("chunk"),
    )
    # Only the parts travel; the rendered turn is put together at the end.
    size = F.length("role") + F.length("text") + len(OPEN) + len(CLOSE) + 1
    part = Window.partitionBy("conv_id", "chunk")
    line = part.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("rank", F.row_number().over(line).cast("long"))
    rows = rows.withColumn("h1", F.xxhash64("turn", "rank", "role", "text")).withColumn("h2", F.xxhash64(F.lit("second"), "text", "role", "rank", "turn"))
    rows = rows.withColumns({
        "x1": F.bit_xor("h1").over(so_far),
        "x2": F.bit_xor("h2").over(so_far),
        "chars": F.sum(size).over(so_far),
        "in_chunk": F.count("*").over(part),
    })
    # One row a chunk: its last.
    chunks = rows.where("rank = in_chunk").select("conv_id", "chunk", "x1", "x2", F.col("rank").alias("n"), "chars")
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    chunks = chunks.select(
        F.col("conv_id").alias("c_id"),
        F.col("chunk").alias("c_chunk"),
        zero(F.bit_xor("x1").over(before)).alias("p1"),
        zero(F.bit_xor("x2").over(before)).alias("p2"),
        zero(F.sum("n").over(before)).alias("p_n"),
        zero(F.sum("chars").over(before)).alias("p_chars"),
        F.sum("n").over(whole).alias("n_turns"),
    )
    joined = rows.join(chunks, (F.col("conv_id") == F.col("c_id")) & (F.col("chunk") == F.col("c_chunk")))
    return joined.select(
        "conv_id",
        "chunk",
        "turn",
        (F.col("p_n") + F.col("rank")).alias("position"),
        "role",
        F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE)).alias("rendered"),
        (F.col("p_chars") + F.col("chars") - size).alias("start_char"),
        "n_turns",
        F.col("p1").bitwiseXOR(F.col("x1")).alias("hash1"),
        F.col("p2").bitwiseXOR(F.col("x2")).alias("hash2"),
    )


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_copies) of conversations that no longer one begins with."""
    key = ["position", "hash1", "hash2"]
    whole = prefixes.where("position = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = prefixes.where("position < n_turns").select(*key).distinct()
    return whole.join(proper, key, "left_anti").select("conv_id", "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """A row for each turn of each maximal conversation: rendered text and where it starts.

    Hashes alone are written, once, to find the conversations that stay; those come back by chunk, so texts are dealt by (conversation,
    chunk) all the way and a giant conversation is many tasks.
    """
    prefixes = turns_with_prefixes(turns)
    slim = common.materialize(prefixes.select("conv_id", "chunk", "position", "n_turns", "hash1", "hash2"), "prefixes")
    kept = slim.select("conv_id", "chunk").distinct().join(maximal(slim), "conv_id")
    kept = common.materialize(kept.select("conv_id", "chunk", "n_copies"), "kept")
    return prefixes.join(kept, ["conv_id", "chunk"]).select("conv_id", "turn", "position", "role", "rendered", "start_char", "n_turns", "n_copies")


def whole_texts(rendered: DataFrame) -> DataFrame:
    """(conv_id, text): the rendered turns put together, for conversations that fit in a row."""
    turns = F.array_sort(F.collect_list(F.struct("position", "rendered")))
    return rendered.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["rendered"]), "").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: rendered turns of all maximal conversations."""
    return render(common.read(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS position,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered,
         string_agg(coalesce(turn::VARCHAR, '-') || chr(31) || role || chr(31) || text, chr(30)) OVER w AS prefix
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY position ROWS UNBOUNDED PRECEDING)),
whole AS (
  SELECT min(conv_id) AS conv_id, count(*) AS n_copies, prefix FROM p WHERE position = n_turns GROUP BY prefix),
kept AS (
  SELECT conv_id, n_copies FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE position < n_turns))
SELECT conv_id, turn, position, role, rendered,
       CAST(sum(length(rendered)) OVER (PARTITION BY conv_id ORDER BY position ROWS UNBOUNDED PRECEDING) - length(rendered) AS BIGINT) AS start_char,
       n_turns, n_copies
FROM p JOIN kept USING (conv_id)
"""
