"""The streaming twin: the change log arrives file by file and must give what a batch gives."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidelog.operators import transactions as tx
from tidelog.plans import fixtures, scratch
from tidelog.plans.transaction_queries import ORACLE as _BATCH
from tidelog.streaming import assemble

#: Parts that the log arrives in; transactions span them.
FILES = 4
#: Change numbers of one file: a part of a long log is many files, so that no task writes or reads a whole one.
NUMBERS_A_FILE = 100_000


def _log(spark, sf_dir) -> tuple[str, object, int]:
    """The log as files in order of arrival (a range of change numbers each), its schema, and how many files are a part."""
    redo = fixtures.redo(spark, sf_dir)
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max(F.col("event_id") + 1)).first()[0] or 0
    a_file = min(NUMBERS_A_FILE, max(1, math.ceil(last / FILES)))
    number = F.floor((F.greatest(F.coalesce("scn", F.lit(1)), F.lit(1)) - 1) / a_file)
    folder = scratch.path(spark, "log")
    files = assemble.write_log(redo.withColumn("file", number), folder, "file")
    return folder, redo.schema, math.ceil(files / FILES)


def stream_committed(spark, sf_dir):
    folder, schema, a_part = _log(spark, sf_dir)
    out = scratch.path(spark, "stream")
    stream = assemble.committed(assemble.read_log(spark, folder, schema, a_part))
    assemble.write_batches(stream, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(assemble.OUTPUT).parquet(f"{out}/rows").select(*tx.XID, "scn", "commit_scn", "num")


def stream_window_counts(spark, sf_dir):
    """Closed windows only: the last ones wait for the watermark."""
    folder, schema, a_part = _log(spark, sf_dir)
    out = scratch.path(spark, "stream")
    # The log's clock has no zone; watermarks need instants, so it is read as UTC whatever the session's zone is.
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    log = assemble.read_log(spark, folder, schema, a_part).withColumn("ts", F.timestamp_micros(F.timestamp_diff("MICROSECOND", zero, F.col("ts"))))
    day = zero + F.make_dt_interval(secs=F.unix_seconds("window.start"))
    counted = assemble.counts(log, "1 day", "1 hour").select(day.alias("day"), "kind", "n")
    counted.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counted.schema).parquet(f"{out}/rows")


QUERIES = {f.__name__: f for f in (stream_committed, stream_window_counts)}
ORACLE = {
    "stream_committed": _BATCH["message_num"],
    "stream_window_counts": f"""
WITH r AS ({fixtures.text(fixtures.REDO)})
SELECT date_trunc('day', ts)::TIMESTAMP AS day, kind, count(*) AS n FROM r GROUP BY 1, 2 HAVING date_trunc('day', any_value(ts)) + INTERVAL 25 HOUR <= (SELECT max(ts) FROM r)""",
}
