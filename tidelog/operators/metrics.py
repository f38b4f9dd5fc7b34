"""Counters over a run, as rows with labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.messages import ddl_class


def dml_ops(changes: DataFrame, by_table: bool = False) -> DataFrame:
    """``type`` (insert, update, delete) and ``filter`` (out, skip), by table where asked."""
    kind = F.lower("kind").alias("type")
    keep = F.when(F.col("shown"), "out").otherwise("skip").alias("filter")
    more = ["owner", "name"] if by_table else []
    return changes.groupBy(kind, keep, *more).agg(F.count("*").alias("dml_ops"))


def transactions(classed: DataFrame) -> DataFrame:
    """``type`` (commit, rollback) and ``filter`` (out, partial, skip)."""
    kind = F.lower("outcome").alias("type")
    return classed.where("outcome IS NOT NULL").groupBy(kind, F.when(F.col("fate") == "rollback", "out").otherwise(F.col("fate")).alias("filter")).agg(F.count("*").alias("transactions"))


def ddl_ops(ddl: DataFrame) -> DataFrame:
    return ddl.groupBy(ddl_class(F.col("code")).alias("type")).agg(F.count("*").alias("ddl_ops"))


def log_switches(files: DataFrame) -> DataFrame:
    """Files read, of an archived or an online log."""
    return files.groupBy("type").agg(F.countDistinct("seq").alias("log_switches"), F.sum("bytes").alias("bytes_read"))


def lag(messages: DataFrame) -> DataFrame:
    """Seconds from the record's time to its output: least, mean, most."""
    s = F.unix_timestamp("sent_ts") - F.unix_timestamp("ts")
    return messages.agg(F.min(s).alias("least"), F.avg(s).alias("mean"), F.max(s).alias("most"))


def prometheus(table: DataFrame, name: str) -> DataFrame:
    """Lines of the text exposition format."""
    labels = [c for c in table.columns if c != name]
    body = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"')) for c in labels))
    return table.select(F.concat(F.lit(name + "{"), body, F.lit("} "), F.col(name).cast("string")).alias("line"))


def observed(df: DataFrame, name: str) -> DataFrame:
    """Counts rows and bytes while the frame is written, without another pass."""
    return df.observe(name, F.count("*").alias("messages"), F.sum(F.octet_length("body")).alias("bytes"))
