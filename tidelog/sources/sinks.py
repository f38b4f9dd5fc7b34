"""Sinks for messages (``c_scn, c_idx, tag, body`` and, for files, ``seq``)."""

from __future__ import annotations

import os
import re
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NEW_LINES = {0: "", 1: "\n", 2: "\r\n"}


def write_lines(messages: DataFrame, path: str, new_line: int = 1, max_rows: int = 0, by_seq: bool = False) -> None:
    """Messages as a folder of text files by Spark's own writer, in commit order from file to file.

    Rotation is by rows a file or by log sequence; names and sizes by a template are ``write_files``' matter.
    """
    if new_line not in (1, 2):
        raise ValueError("Spark's text writer needs a line end: use write_files for messages without one")
    # Range partitions keep commit order from file to file.
    rows = messages.repartitionByRange("c_scn", "c_idx").sortWithinPartitions("c_scn", "c_idx")
    writer = rows.select("body", *(["seq"] if by_seq else [])).write.option("lineSep", NEW_LINES[new_line])
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    (writer.partitionBy("seq") if by_seq else writer).text(path)


class OutputError(ValueError):
    """An output that can't be written as asked."""


def rotation(output: str, max_file_size: int, append: int = 1) -> str:
    """How files change: ``none``, ``number``, ``time`` or ``sequence``; what can't be is an ``OutputError``."""
    name = output.rsplit("/", 1)[-1]
    fields = re.findall(r"%(?:(?:[2-9]|10)?i|[st])", name)
    if "%" in re.sub(r"%(?:(?:[2-9]|10)?i|[st])", "", name) or len(fields) > 1:
        raise OutputError(f"bad output file name: {output!r}")
    if not fields:
        if not append:
            raise OutputError(f"{output!r} names one file, so messages must be appended to it")
        return "none"
    if fields[0] == "%s":
        return "sequence"
    if not max_file_size:
        raise OutputError(f"{output!r} changes files by size, so a size must be given")
    return "time" if fields[0] == "%t" else "number"


def write_files(messages: DataFrame, output: str, order: list[str], new_line: int = 0, max_file_size: int = 0, append: int = 1, stamp: str = "") -> DataFrame:
    """Messages (``body``, and ``seq`` for files by sequence) in ``order`` as files named by a template; returns (file, messages, bytes).

    ``%i`` files are cut where the next message would pass ``max_file_size``; each task cuts its own range of the order, so the last
    file of a range may be smaller, and numbers run on from task to task. ``%s`` gives one file a log sequence, and one task writes
    it, streaming. ``%t`` gives one file of the run, and a name without a field one file; each task writes its own range of the order,
    and only their bytes are strung together in one place. A file appears under its name when it is complete (it is renamed), so a
    lost task leaves no part of one; an existing file is added to only where it is the only one.
    """
    how, end = rotation(output, max_file_size, append), NEW_LINES[new_line].encode()
    folder, name = output.rsplit("/", 1) if "/" in output else (".", output)
    folder = folder if "://" in folder else f"file://{os.path.abspath(folder)}"
    rows = messages.select("body", *(["seq"] if how == "sequence" else []), *(F.col(c).alias(f"_o{k}") for k, c in enumerate(order)))
    keys = [f"_o{k}" for k in range(len(order))]
    if how == "sequence":
        placed = rows.repartition("seq").sortWithinPartitions("seq", *keys).select("body", "seq")
    else:
        placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("body", F.lit(0).cast("long").alias("seq"))

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, top = pafs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        out, held, n, number, now = None, 0, 0, 0, None

        def done():
            out.close()
            return pa.RecordBatch.from_pydict({"part": [part], "number": [number], "seq": [now], "temporary": [path], "messages": [n], "bytes": [held]})

        for batch in batches:
            for body, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (body or "").encode() + end
                if out is not None and (seq != now or (how == "number" and held + len(data) > max_file_size)):
                    yield done()
                    out, number = None, number + 1
                if out is None:
                    path, held, n, now = f"{top}/.{uuid.uuid4().hex}.part", 0, 0, seq
                    out = fs.open_output_stream(path, compression=None)
                out.write(data)
                held, n = held + len(data), n + 1
        if out is not None:
            yield done()

    # A row a file or range; sorted here, as a sort in the plan would run the writing twice to find its ranges.
    files = sorted(placed.mapInArrow(run, "part long, number long, seq long, temporary string, messages long, bytes long").collect(), key=lambda f: (f.part, f.number))
    groups = [[f] for f in files] if how in ("number", "sequence") else [files] if files else []
    fs, top = pafs.FileSystem.from_uri(folder)
    targets = [f"{top}/{file_name(name, k, g[0].seq, stamp)}" for k, g in enumerate(groups)]
    exists = [fs.get_file_info(t).type != pafs.FileType.NotFound for t in targets]
    if any(exists) and not append:
        for f in files:
            fs.delete_file(f.temporary)
        raise OutputError(f"{targets[exists.index(True)]} exists")
    out = []
    for group, target, there in zip(groups, targets, exists, strict=True):
        into, *others = [target if there else group[0].temporary, *(f.temporary for f in group[0 if there else 1 :])]
        if others:  # the messages follow what is there
            with fs.open_append_stream(into) as old:
                for path in others:
                    with fs.open_input_stream(path, compression=None) as new:
                        while chunk := new.read(1 << 20):
                            old.write(chunk)
                    fs.delete_file(path)
        if not there:
            fs.move(into, target)
        out.append((target, sum(f.messages for f in group), sum(f.bytes for f in group)))
    return messages.sparkSession.createDataFrame(out, "file string, messages long, bytes long")


def numbered_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """Lines of text files as (file, n, line), numbered from 0 in each file; a large file is read in splits.

    A split's lines follow each other in its task, so counts of splits (a row each) carry the numbers on.
    """
    if not files:
        return spark.createDataFrame([], "file string, n long, line string")
    read = spark.read.option("lineSep", "\n").text(files)
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    splits = splits.select("file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(F.broadcast(splits), ["file", "_start"]).select("file", (F.col("_at") + F.col("_shift")).alias("n"), "line")


def file_name(template: str, number: int, seq: int, stamp: str) -> str:
    """``%i`` counter (``%2i`` to ``%10i`` filled with zeros), ``%s`` sequence, ``%t`` time."""

    def put(m):
        digits, kind = m.groups()
        if kind == "i":
            return str(number).zfill(int(digits or 0))
        return str(seq) if kind == "s" else stamp

    if re.search(r"%(?!(?:[2-9]|10)?i|[st])", template):
        raise ValueError(f"bad output file name: {template!r}")
    return re.sub(r"%([2-9]|10)?([ist])", put, template)


def kafka_rows(messages: DataFrame, topic: str, max_bytes: int = 100 * 1024 * 1024) -> DataFrame:
    """Rows for a Kafka writer: key (tag), value, topic; larger messages are marked, not dropped."""
    return messages.select(
        F.lit(topic).alias("topic"), F.col("tag").cast("binary").alias("key"), F.col("body").cast("binary").alias("value"), (F.octet_length("body") > max_bytes).alias("too_large")
    )


def without_checkpoints(messages: DataFrame, show: bool = False) -> DataFrame:
    """Checkpoint messages (``place`` is checkpoint) only travel to a sink where they are asked for."""
    return messages if show else messages.where("place <> 'checkpoint'")


def discard(messages: DataFrame) -> None:
    """Runs everything and keeps nothing."""
    messages.write.format("noop").mode("overwrite").save()


class StreamServer:
    """Answers of the subscription protocol (INFO, START, CONTINUE, CONFIRM) over a table of messages.

    Transport is left out: a request is a dict, answers are dicts or a frame of messages to send.
    """

    def __init__(self, messages: DataFrame, database: str):
        self.messages, self.database = messages, database
        self.started, self.position = False, None

    def handle(self, request: dict) -> dict | DataFrame:
        if request.get("database") != self.database:
            return {"code": "INVALID_DATABASE"}
        kind = request.get("code")
        if kind == "INFO":
            return {"code": "REPLICATE" if self.started else "READY", "position": self.position}
        if kind == "START":
            if self.started:
                return {"code": "ALREADY_STARTED"}
            self.started = True
            from tidelog.sources.logs import from_position

            known = {k: request[k] for k in ("scn", "seq", "time", "seconds_back") if k in request}
            return from_position(self.messages, **known).orderBy("c_scn", "c_idx")
        if kind == "CONTINUE":
            from tidelog.operators.checkpoints import after

            self.started = True
            return after(self.messages, request["c_scn"], request["c_idx"]).orderBy("c_scn", "c_idx")
        if kind == "CONFIRM":
            new = (request["c_scn"], request["c_idx"])
            self.position = max(self.position or new, new)
            return {"code": "CONFIRMED", "position": self.position}
        return {"code": "INVALID_COMMAND"}
