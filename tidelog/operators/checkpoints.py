"""Positions: low watermark, checkpoints, confirmation, resumption and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.transactions import XID


def low_watermark(open_tx: DataFrame) -> DataFrame:
    """The oldest begin of all open transactions: where reading must start again (no row: none is open)."""
    return open_tx.agg(F.min(F.struct("seq", "offset", *XID)).alias("m")).where("m IS NOT NULL").select("m.*")


def lwn_positions(records: DataFrame) -> DataFrame:
    """Highest number, place and time of each group of records (``lwn_id``)."""
    return records.groupBy("lwn_id").agg(F.max("scn").alias("scn"), F.max("seq").alias("seq"), F.max("offset").alias("offset"), F.max("ts").alias("ts"))


def due(positions: DataFrame, interval_s: int, interval_mb: int, schema_every: int) -> DataFrame:
    """The positions at which a checkpoint is written, and whether it holds the dictionary.

    One is written at a log switch, or once so much time or data lies behind the last one. That depends on
    the one before, so the fold runs over one row a group in order, inside a log file; files are apart, since a
    switch always writes.
    """
    state = F.struct(F.lit(None).cast("long").alias("t"), F.lit(None).cast("long").alias("b"), F.array().cast("array<long>").alias("out"))
    item = F.struct("scn", F.unix_timestamp("ts").alias("t"), F.col("bytes").alias("b"))
    listed = positions.groupBy("seq").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(acc, x):
        write = acc["t"].isNull() | (x["t"] - acc["t"] >= interval_s) | (F.floor((x["b"] - acc["b"]) / 1024 / 1024) >= interval_mb)
        return F.struct(F.when(write, x["t"]).otherwise(acc["t"]).alias("t"), F.when(write, x["b"]).otherwise(acc["b"]).alias("b"), F.when(write, F.concat(acc["out"], F.array(x["scn"]))).otherwise(acc["out"]).alias("out"))

    written = listed.select("seq", F.explode(F.aggregate("items", state, step)["out"]).alias("scn"))
    order = Window.orderBy("scn")  # a row a checkpoint
    return written.withColumn("has_schema", (F.row_number().over(order) - 1) % (schema_every + 1) == 0)


def retained(checkpoints: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep - 1`` checkpoints, and older ones up to the first that holds a dictionary."""
    order = Window.orderBy(F.col("scn").desc())
    rows = checkpoints.withColumn("_n", F.row_number().over(order))
    older = (F.col("_n") >= keep) & F.col("has_schema")
    seen = F.coalesce(F.sum(older.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_seen", seen).where((F.col("_n") < keep) | (F.col("_seen") == 0)).drop("_n", "_seen")


def recovery_point(checkpoints: DataFrame, start_scn: int) -> DataFrame:
    """The newest checkpoint up to a start, and the newest up to it that holds the dictionary."""
    usable = checkpoints.where(F.col("scn") <= start_scn)
    return usable.agg(F.max("scn").alias("scn"), F.max(F.when(F.col("has_schema"), F.col("scn"))).alias("schema_scn"))


def confirmed(messages: DataFrame) -> DataFrame:
    """The highest message up to which all are confirmed (null: none)."""
    gap = messages.agg(F.min(F.when(~F.col("confirmed"), F.col("id"))).alias("gap"))
    return messages.join(F.broadcast(gap)).where(F.col("gap").isNull() | (F.col("id") < F.col("gap"))).agg(F.max("id").alias("id"))


def after(messages: DataFrame, c_scn: int, c_idx: int) -> DataFrame:
    """Messages that a client at (c_scn, c_idx) hasn't had."""
    return messages.where((F.col("c_scn") > c_scn) | ((F.col("c_scn") == c_scn) & (F.col("c_idx") > c_idx)))


def once(messages: DataFrame) -> DataFrame:
    """At-least-once delivery made effectively once."""
    return messages.dropDuplicates(["c_scn", "c_idx"])
