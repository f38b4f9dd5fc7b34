"""Log files: which there are, in what order, and whether their blocks are sound."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pattern(name_format: str) -> tuple[str, dict[str, int]]:
    """A regular expression for a file name format, and the group of each field.

    ``%s`` sequence, ``%t`` thread, ``%r`` incarnation, ``%a``, ``%d`` numbers; ``%h`` small letters and digits.
    """
    out, groups, at = "", {}, 0
    while at < len(name_format):
        c = name_format[at]
        if c == "%":
            field = name_format[at + 1 : at + 2]
            if not field or field not in "sStTradh":
                raise ValueError(f"bad file name format at {at}: {name_format!r}")
            groups[field.lower()] = len(groups) + 1
            out += "([0-9a-z]+)" if field == "h" else "([0-9]+)"
            at += 2
        else:
            out += re.escape(c)
            at += 1
    return f"^{out}$", groups


def sequence_of(name: Column, name_format: str) -> Column:
    """The sequence in a file name; null where the name doesn't fit."""
    form, groups = pattern(name_format)
    return F.when(name.rlike(form), F.regexp_extract(name, form, groups["s"]).cast("long"))


def map_path(path: Column, mapping: list[tuple[str, str]]) -> Column:
    """The first prefix that fits is replaced."""
    out = path
    for source, target in reversed(mapping):
        out = F.when(path.startswith(source), F.concat(F.lit(target), F.substring(path, F.lit(len(source) + 1), F.length(path)))).otherwise(out)
    return out


def listed(spark: SparkSession, path: str, name_format: str) -> DataFrame:
    """Archived logs below a path in order of sequence: path, name, size, sequence. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).withColumn("seq", sequence_of(name, name_format)).where("seq IS NOT NULL").orderBy("seq")


def database_catalog(spark: SparkSession, url: str, resetlogs: int, thread: int, first: int, properties: dict[str, str]) -> DataFrame:
    """The same from a database's catalogue, the condition pushed down."""
    query = f"(SELECT NAME, SEQUENCE#, FIRST_CHANGE#, NEXT_CHANGE# FROM V$ARCHIVED_LOG WHERE RESETLOGS_ID = {int(resetlogs)} AND THREAD# = {int(thread)} AND SEQUENCE# >= {int(first)}) logs"
    return spark.read.jdbc(url, query, properties=properties)


def snapshot(spark: SparkSession, url: str, table: str, scn: int, properties: dict[str, str], where: str = "1 = 1") -> DataFrame:
    """A dictionary table as of a change number."""
    return spark.read.jdbc(url, f"(SELECT * FROM {table} AS OF SCN {int(scn)} WHERE {where}) snapshot", properties=properties)


def gaps(files: DataFrame, start: int) -> DataFrame:
    """(after, before): runs of missing sequences from ``start`` on, in each incarnation and thread. A row a file is sorted."""
    keys = [c for c in ("resetlogs", "thread") if c in files.columns]
    order = Window.partitionBy(*keys).orderBy("seq")
    seen = files.where(F.col("seq") >= start).select(*keys, "seq").distinct()
    rows = seen.withColumn("before", F.col("seq")).withColumn("after", F.coalesce(F.lag("seq").over(order), F.lit(start - 1)))
    return rows.where("before - after > 1").select(*keys, "after", "before")


def usable(files: DataFrame, start: int) -> DataFrame:
    """Files from ``start`` up to the first gap (older ones are skipped, later ones wait)."""
    order = Window.orderBy("seq")
    rows = files.where(F.col("seq") >= start).withColumn("_n", F.dense_rank().over(order))
    return rows.where(F.col("seq") - start + 1 == F.col("_n")).drop("_n")


def from_position(records: DataFrame, scn: int | None = None, seq: int | None = None, time: str | None = None, seconds_back: int | None = None) -> DataFrame:
    """Records from a start: by number, sequence, absolute time or time before the newest record."""
    if scn is not None:
        return records.where(F.col("scn") >= scn)
    if seq is not None:
        return records.where(F.col("seq") >= seq)
    if time is not None:
        return records.where(F.col("ts") >= F.lit(time).cast("timestamp"))
    if seconds_back is not None:
        newest = records.agg(F.max("ts").alias("_newest"))
        return records.join(F.broadcast(newest)).where(F.unix_timestamp("ts") >= F.unix_timestamp("_newest") - seconds_back).drop("_newest")
    return records


def sequence_range(files: DataFrame) -> DataFrame:
    """The lowest and highest sequence of each incarnation and thread: where reading may start."""
    keys = [c for c in ("resetlogs", "thread") if c in files.columns]
    return files.groupBy(*keys).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def after_checkpoints(positions: DataFrame, due: DataFrame, n: int) -> DataFrame:
    """Positions up to the ``n``-th checkpoint (a stop rule, so the limit is the feature)."""
    last = due.orderBy("scn").limit(n).agg(F.max("scn").alias("_last"), F.count("*").alias("_n"))
    return positions.join(F.broadcast(last)).where((F.col("_n") < n) | (F.col("scn") <= F.col("_last"))).drop("_last", "_n")


def by_incarnation(files: DataFrame) -> DataFrame:
    """``turn``: position in reading order, where a new incarnation starts its sequences anew."""
    return files.withColumn("turn", F.row_number().over(Window.orderBy("resetlogs", "seq")) - 1)


#: Magic number and the marks of block sizes (``MAGIC``, ``BLOCK_MARKS``).
MAGIC = "7D7C7B7A"
BLOCK_MARKS = {512: 0x22, 1024: 0x22, 4096: 0x82}


def _int(data: Column, at: int, n: int, big: bool) -> Column:
    order = range(n) if big else range(n - 1, -1, -1)
    return F.conv(F.concat(*(F.hex(F.substring(data, at + 1 + k, 1)) for k in order)), 16, 10).cast("long")


def probe(data: Column) -> Column:
    """Struct (big_endian, block_size) of a file's first bytes; null if they aren't a log's."""
    magic = F.hex(F.substring(data, 29, 4))
    big = magic == "7A7B7C7D"
    size = F.when(big, _int(data, 20, 4, True)).otherwise(_int(data, 20, 4, False))
    mark = F.conv(F.hex(F.substring(data, 2, 1)), 16, 10).cast("int")
    fine = magic.isin(MAGIC, "7A7B7C7D") & (F.hex(F.substring(data, 1, 1)) == "00") & (((size.isin(512, 1024)) & (mark == 0x22)) | ((size == 4096) & (mark == 0x82)))
    return F.when(fine, F.struct(big.alias("big_endian"), size.alias("block_size")))


def blocks(files: DataFrame, block_size: int) -> DataFrame:
    """A row for each block of ``files(path, content)``: number and bytes."""
    n = F.floor(F.octet_length("content") / block_size)
    rows = files.select("path", "content", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block"))
    return rows.select("path", "block", F.substring("content", (F.col("block") * block_size + 1).cast("int"), F.lit(block_size)).alias("data"))


@F.pandas_udf(T.IntegerType())
def _folded(data: pd.Series) -> pd.Series:
    """All 16-bit words of each block (of one size) folded by exclusive or, as 64-bit words first."""
    words = np.frombuffer(b"".join(data), "<u8").reshape(len(data), -1)
    x = np.bitwise_xor.reduce(words, axis=1)
    x = x ^ (x >> np.uint64(32))
    return pd.Series(((x ^ (x >> np.uint64(16))) & np.uint64(0xFFFF)).astype(np.int32))


def checksum(data: Column, block_size: int) -> Column:
    """The words of a block folded by exclusive or to 16 bits, its own sum (at 14) left out; null for a block of another size."""
    blank = F.lit(bytes(block_size))
    whole = F.octet_length(data) == block_size
    return F.when(whole, _folded(F.when(whole, data).otherwise(blank)).bitwiseXOR(_int(data, 14, 2, False).cast("int")))


def check_blocks(rows: DataFrame, block_size: int, sequence: int, online: bool = False, big: bool = False, sums: bool = True) -> DataFrame:
    """``status`` of each block: OK, EMPTY, OVERWRITTEN, BAD_DATA, SEQUENCE, BLOCK or CRC."""
    d = F.col("data")
    mark = F.conv(F.hex(F.substring(d, 2, 1)), 16, 10).cast("int")
    number, seq = _int(d, 4, 4, big), _int(d, 8, 4, big)
    own = _int(d, 14, 2, big)
    status = F.when(F.hex(F.substring(d, 1, 2)) == "0000", "EMPTY").when(mark != BLOCK_MARKS[block_size], "BAD_DATA")
    if online:
        status = status.when(seq < sequence, "EMPTY").when(seq > sequence, "OVERWRITTEN")
    else:
        status = status.when(seq != sequence, "SEQUENCE")
    status = status.when(number != F.col("block"), "BLOCK")
    if sums:
        calculated = checksum(d, block_size)
        if big:
            calculated = F.shiftleft(calculated.bitwiseAND(F.lit(0xFF)), 8).bitwiseOR(F.shiftright(calculated, 8))
        status = status.when(own != calculated, "CRC")
    return rows.withColumn("status", status.otherwise("OK"))


def dump(records: DataFrame) -> DataFrame:
    """``records`` with a ``line`` each for people to read: place, transaction, kind and object. Unknown parts are a dash."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-")) if c in records.columns else F.lit("-")
    xid = F.concat_ws(".", *(F.lower(F.lpad(F.hex(F.col(c)), n, "0")) for c, n in (("usn", 4), ("slt", 3), ("sqn", 8))))
    parts = [F.lit("SEQ"), text("seq"), F.lit("SCN"), F.concat(text("scn"), F.lit(":"), text("sub_scn")), F.lit("XID"), xid, text("kind"), F.lit("OBJ"), text("obj"), F.lit("SIZE"), text("size")]
    return records.withColumn("line", F.concat_ws(" ", *parts))
