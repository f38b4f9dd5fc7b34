"""A whole run from a configuration: log files, dictionary, replay, sink.

Logs are logical change logs as Parquet or JSON files, in the layout of ``replay``; the dictionary is a table of versions. A batch
reads the files and folders that the configuration lists (``redo-log``), an offline run the archive below ``path-mapping``'s target
or the first folder. Files are put in order by the sequence in their names and used up to the first gap.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import ids
from tidelog.operators import messages
from tidelog.operators import transactions as tx
from tidelog.plans import config as configuration
from tidelog.plans import replay
from tidelog.sources import logs, sinks

MB = 1 << 20


@dataclass
class Result:
    """What a run sent: the messages (lazy), and a row for each file where the sink writes files."""

    messages: DataFrame
    files: DataFrame | None = None


def log_files(spark: SparkSession, conf: configuration.Config) -> list[str]:
    """Paths of the log files to read, in order of sequence, from the start to the first gap. Names come to the driver, contents don't."""
    reader = conf.reader
    pairs = list(zip(reader["path-mapping"][::2], reader["path-mapping"][1::2], strict=True))
    found: dict[int, str] = {}
    for path in reader["redo-log"]:
        for source, target in pairs:
            if path.startswith(source):
                path = target + path[len(source) :]
                break
        for row in logs.listed(spark, path, reader["log-archive-format"]).select("path", "seq").collect():  # a row a file
            found.setdefault(row["seq"], row["path"])
    start = reader["start-seq"] if reader["start-seq"] is not None else min(found, default=0)
    out, seq = [], start
    while seq in found:
        out.append(found[seq])
        seq += 1
    switches = conf.debug["stop-log-switches"]
    return out[:switches] if switches else out


def read_logs(spark: SparkSession, files: list[str], schema) -> DataFrame:
    """Records of log files; JSON by the end of the name, Parquet otherwise."""
    if not files:
        return spark.createDataFrame([], schema)
    plain = [f for f in files if f.endswith(".json")]
    rest = [f for f in files if not f.endswith(".json")]
    parts = [spark.read.schema(schema).json(plain)] if plain else []
    parts += [spark.read.schema(schema).parquet(*rest)] if rest else []
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _ids(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Transaction ids of a list in the configuration."""
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(ids.xid_parse(F.col("text")).alias("x"))
    return rows.select("x.*")


def run(spark: SparkSession, text: str, schema, versions: DataFrame, ddl: DataFrame | None = None, sink=None) -> Result:
    """Carry out the configuration ``text``.

    ``schema`` is that of the log files. The sink is the configuration's: files by a template, or nothing kept (``discard``); for Kafka
    and network writers the rows to send go to ``sink(rows)``, as their transports aren't part of Spark.
    """
    conf = configuration.parse(text)
    reader, debug, options = conf.reader, conf.debug, conf.format
    redo = read_logs(spark, log_files(spark, conf), schema)
    redo = logs.from_position(redo, scn=reader["start-scn"], time=None if reader["start-scn"] is not None else reader["start-time"], seconds_back=None if reader["start-scn"] is not None else reader["start-time-rel"])
    if reader["con-id"] is not None and "con_id" in redo.columns:
        redo = tx.in_container(redo, reader["con-id"])
    if conf.filter["dump-xid"]:
        redo = tx.only(redo, _ids(spark, conf.filter["dump-xid"]))
    skip = _ids(spark, conf.filter["skip-xid"]) if conf.filter["skip-xid"] else None
    if debug["stop-transactions"]:
        redo = tx.only(redo, tx.first_n(tx.transactions(redo), debug["stop-transactions"]))
    rules = conf.tables or None
    size = conf.source["transaction-max-mb"] * MB
    full = bool(options.message & 1)
    out = replay.whole(
        redo, versions, options, ddl if conf.flag("show_ddl") else None, begin=not options.message & 4, commit=not options.message & 8,
        rules=rules, skip_xid=skip, max_bytes=size, schemaless=conf.flag("schemaless"), hide_system=not conf.flag("show_system_transactions"),
    ) if not full else one_message(redo, versions, options, rules, skip, size)
    writer = conf.writer
    if writer["type"] == "discard":
        sinks.discard(out)
        return Result(out)
    if writer["type"] == "file":
        stamp = datetime.now(timezone.utc).strftime(writer["timestamp-format"])
        if not writer["output"]:  # standard output, message by message
            for row in out.orderBy(*replay.MESSAGE_ORDER).select("body").toLocalIterator():
                print(row["body"], end=sinks.NEW_LINES[writer["new-line"]])
            return Result(out)
        files = sinks.write_files(out, writer["output"], replay.MESSAGE_ORDER, writer["new-line"], writer["max-file-size"], writer["append"], stamp)
        return Result(out, files)
    if sink is None:
        raise configuration.ConfigError(f"writer.type: {writer['type']!r} needs a sink for its rows")
    sink(sinks.kafka_rows(out.withColumn("tag", F.lit(None).cast("string")), writer["topic"], writer["max-message-mb"] * MB) if writer["type"] == "kafka" else out)
    return Result(out)


def one_message(redo: DataFrame, versions: DataFrame, options: messages.FormatOptions, rules, skip, size) -> DataFrame:
    """One message for a transaction, in the columns of ``replay.whole``."""
    placed = replay.changes(redo, versions, options, rules, skip, size)
    placed = replay._with_first(placed, versions, options, False)
    told = messages.one_message(messages.dml(placed, options), options)
    ends = redo.where("kind = 'COMMIT'").groupBy(*tx.XID).agg(F.max("seq").alias("seq"))
    return told.join(ends, tx.XID).select("commit_scn", *tx.XID, F.lit(0).alias("at"), F.lit(0).alias("num"), F.lit("transaction").alias("place"), "seq", "c_scn", "c_idx", "body")
