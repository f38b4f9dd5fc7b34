"""Row changes out of change vectors: pieces, classes, multi-row vectors, split columns and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.transactions import ORDER, XID


def islands(pieces: DataFrame, last_col: str = "fb_last") -> DataFrame:
    """``row_no`` in its transaction for each piece: a row ends with the piece flagged last."""
    order = Window.partitionBy(*XID).orderBy(*ORDER)
    ended = F.coalesce(F.lag(F.col(last_col).cast("int")).over(order), F.lit(0))
    rows = pieces.withColumn("_ended", ended)
    return rows.withColumn("row_no", F.sum("_ended").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_ended")


def op_of(kinds: Column) -> Column:
    """One letter for a row change: all insert pieces are an insert, all deletes a delete, a mix an update."""
    return F.when(F.size(kinds) > 1, "u").when(F.array_contains(kinds, "INSERT"), "c").when(F.array_contains(kinds, "DELETE"), "d").otherwise("u")


def assemble(pieces: DataFrame) -> DataFrame:
    """One row for each row change with op, first place, pieces and size."""
    return islands(pieces).groupBy(*XID, "row_no").agg(
        op_of(F.collect_set("kind")).alias("op"),  # a row has pieces of three kinds at most
        F.min("scn").alias("scn"),
        F.count("*").alias("n_pieces"),
        F.sum("size").alias("bytes"),
        F.min_by("obj", F.struct(*ORDER)).alias("obj"),
    )


def explode_rows(vectors: DataFrame, rows_col: str = "rows") -> DataFrame:
    """A vector of several rows becomes one row change each, ``slot_no`` from 0."""
    return vectors.select("*", F.posexplode(rows_col).alias("slot_no", "row")).drop(rows_col)


def merge_parts(parts: DataFrame, keys: list[str], part_col: str = "part", value_col: str = "value") -> DataFrame:
    """First, middle and last parts of a split column put together in order."""
    ordered = F.array_sort(F.collect_list(F.struct(part_col, value_col)))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda p: p[value_col]), "").alias(value_col), F.count("*").alias("n_parts"))


def merge_blocks(vectors: DataFrame) -> DataFrame:
    """Undo vectors over several blocks (``place``: HEAD, MID, TAIL) joined to the one that begins each run."""
    order = Window.partitionBy(*XID).orderBy(*ORDER)
    rows = vectors.withColumn("_starts", (F.col("place").isin("HEAD", "SINGLE")).cast("int"))
    rows = rows.withColumn("run", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*XID, "run").agg(F.min("scn").alias("scn"), F.sum("size").alias("bytes"), F.count("*").alias("n_blocks"))


#: Fixed value: the bit of a row's flags that marks a cluster key.
CLUSTER_KEY = 0x80


def without_cluster_keys(rows: DataFrame, flags_col: str = "fb") -> DataFrame:
    """Row changes that aren't entries of a cluster's key (null flags have no bit)."""
    return rows.where(F.coalesce(F.col(flags_col), F.lit(0)).bitwiseAND(F.lit(CLUSTER_KEY)) == 0)
