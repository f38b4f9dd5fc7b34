"""Queries over identifiers, codecs and text forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import codec, formats, ids

_EVENTS = "SELECT event_id, CAST(1700000000 + event_id * 4001 AS BIGINT) AS s, CAST((event_id * 104729999) % 1000000000 AS BIGINT) AS ns FROM events"


def _events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", (F.col("event_id") * 4001 + 1_700_000_000).alias("s"), (F.col("event_id") * 104_729_999 % 1_000_000_000).alias("ns"))


def fmt_timestamp_modes(spark, sf_dir):
    s, ns = F.col("s"), F.col("ns")
    return _events(spark, sf_dir).select("event_id", *(formats.timestamp(s, ns, m).alias(f"m{m}") for m in range(16)))


def fmt_timestamp_tz_modes(spark, sf_dir):
    s, ns = F.col("s"), F.col("ns")
    return _events(spark, sf_dir).select("event_id", *(formats.timestamp_tz(s, ns, F.lit("Europe/Warsaw"), m).alias(f"m{m}") for m in range(12)))


def fmt_interval_dts_modes(spark, sf_dir):
    e = F.col("event_id")
    parts = (e % 2 == 1, e % 1000, e % 24, e % 60, e * 7 % 60, F.col("ns"))
    return _events(spark, sf_dir).select("event_id", *(formats.interval_ds(*parts, m).alias(f"m{m}") for m in range(11)))


def fmt_interval_ytm_modes(spark, sf_dir):
    e = F.col("event_id")
    return _events(spark, sf_dir).select("event_id", *(formats.interval_ym(e % 3 == 1, e % 500, e % 12, m).alias(f"m{m}") for m in range(5)))


def _xid() -> tuple:
    return F.col("event_id") % 9 + 1, F.col("event_id") % 34, F.col("event_id") * 37 + 5


def fmt_xid_modes(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", *(ids.xid_text(*_xid(), m).alias(f"m{m}") for m in range(4)))


def fmt_scn_modes(spark, sf_dir):
    scn = F.col("event_id") * 1_000_003 + 17
    return _events(spark, sf_dir).select("event_id", *(ids.scn_text(scn, m).alias(f"m{m}") for m in range(3)))


def xid_parse_roundtrip(spark, sf_dir):
    rows = _events(spark, sf_dir)
    text = F.when(F.col("event_id") % 3 == 0, F.upper(ids.xid_text(*_xid(), 0))).otherwise(ids.xid_text(*_xid(), 0))
    text = F.when(F.col("event_id") % 3 == 0, F.substring(text, 3, 17)).otherwise(text)
    got = ids.xid_parse(F.when(F.col("event_id") % 11 == 0, F.lit("bad")).otherwise(text))
    return rows.select("event_id", got["usn"].alias("usn"), got["slt"].alias("slt"), got["sqn"].alias("sqn"))


def rowid_encode(spark, sf_dir):
    e = F.col("event_id")
    obj, dba, slot = e * 97 + 70_000, e * 524_287 % (1 << 32), e % 700
    text = ids.rowid_text(obj, dba, slot)
    back = ids.rowid_parse(text)
    return _events(spark, sf_dir).select("event_id", text.alias("rid"), ids.rowid_hex(obj, dba, slot).alias("hex"), (back["data_obj"] == obj).alias("same_obj"), back["dba"].alias("dba"), back["slot"].alias("slot"))


def log_time_decode(spark, sf_dir):
    ts = F.timestamp_seconds("s")
    packed = (((((F.year(ts) - 1988).cast("long") * 12 + F.month(ts) - 1) * 31 + F.day(ts) - 1) * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60 + F.second(ts)
    return _events(spark, sf_dir).select("event_id", ids.log_time(packed).alias("epoch"))


def zone_parse(spark, sf_dir):
    text = F.concat(F.when(F.col("event_id") % 2 == 0, "+").otherwise("-"), F.lpad((F.col("event_id") % 17).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"))
    return _events(spark, sf_dir).select("event_id", ids.zone_seconds(text).alias("seconds"))


def number_decode(spark, sf_dir):
    """Whole numbers written as base-100 bytes and read again."""
    e = F.col("event_id")
    rows = _events(spark, sf_dir).withColumn("v", F.when(e % 2 == 0, 1).otherwise(-1) * (e * 7919 + 1))
    v = F.col("v")
    # Base-100 digits without leading zero pairs, as fixed-width decimal text cut in twos.
    rows = rows.withColumn("d", F.abs(v).cast("string"))
    rows = rows.withColumn("d", F.when(F.length("d") % 2 == 1, F.concat(F.lit("0"), "d")).otherwise(F.col("d")))
    rows = rows.withColumn("pairs", F.transform(F.sequence(F.lit(0), F.floor(F.length("d") / 2).cast("int") - 1), lambda k: F.substring(F.col("d"), k * 2 + 1, F.lit(2)).cast("int")))
    hexed = F.array_join(F.transform("pairs", lambda p: F.lpad(F.hex(F.when(v < 0, 101 - p).otherwise(p + 1)), 2, "0")), "")
    first = F.lpad(F.hex(F.when(v < 0, 0x3F - F.size("pairs")).otherwise(0xC0 + F.size("pairs"))), 2, "0")
    rows = rows.withColumn("data", F.unhex(F.concat(first, hexed, F.when(v < 0, "66").otherwise(""))))
    return rows.select("event_id", codec.number(F.col("data")).alias("value"))


def raw_and_characters(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/customer.parquet")
    data = F.encode("c_name", "UTF-8")
    return d.select("c_custkey", codec.raw(data).alias("raw"), codec.characters(data, "AL32UTF8").alias("text"), codec.character_output(F.col("c_name"), 2).alias("hex"))


QUERIES = {
    f.__name__: f
    for f in (
        fmt_timestamp_modes, fmt_timestamp_tz_modes, fmt_interval_dts_modes, fmt_interval_ytm_modes, fmt_xid_modes, fmt_scn_modes,
        xid_parse_roundtrip, rowid_encode, log_time_decode, zone_parse, number_decode, raw_and_characters,
    )
}


def _round(digits: int) -> tuple[str, str]:
    unit = 10 ** (9 - digits)
    up = f"((ns + {unit // 2 if unit > 1 else 0}) // {unit})"
    return f"(s + {up} // {10**digits})", f"({up} % {10**digits})"


def _sql_epoch(digits: int) -> str:
    s, f = _round(digits)
    return f"({s} * {10**digits} + {f})"


def _sql_iso(digits: int, zulu: bool) -> str:
    s, f = _round(digits)
    text = f"strftime(make_timestamp({s} * 1000000), '%Y-%m-%d{'T' if zulu else ' '}%H:%M:%S')"
    if digits:
        text += f" || '.' || lpad(({f})::VARCHAR, {digits}, '0')"
    return text + (" || 'Z'" if zulu else "")


def _sql_modes() -> list[str]:
    out = [f"{_sql_epoch(formats.PLACES[m % 4])}::VARCHAR" for m in range(8)]
    return out + [_sql_iso(formats.PLACES[m % 4], m < 12) for m in range(8, 16)]


def _hex(value: str, n: int) -> str:
    return f"lpad(lower(to_hex({value})), {n}, '0')"


def _swap(value: str, n: int) -> str:
    return " || ".join(f"substr({_hex(value, n)}, {n - 1 - 2 * k}, 2)" for k in range(n // 2))


_U, _S, _Q = "(event_id % 9 + 1)", "(event_id % 34)", "(event_id * 37 + 5)"
_SIGN = "CASE WHEN event_id % 2 = 1 THEN '-' ELSE '' END"
_DS = "((((event_id % 1000) * 24 + event_id % 24) * 60 + event_id % 60) * 60 + event_id * 7 % 60)"
_CLOCK = "lpad((event_id % 24)::VARCHAR, 2, '0') || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') || ':' || lpad((event_id * 7 % 60)::VARCHAR, 2, '0') || '.' || lpad(ns::VARCHAR, 9, '0')"
_YSIGN = "CASE WHEN event_id % 3 = 1 THEN '-' ELSE '' END"


def _letters(value: str, n: int) -> str:
    return " || ".join(f"substr('{ids.ALPHABET}', (({value}) >> {6 * k} & 63)::INTEGER + 1, 1)" for k in range(n - 1, -1, -1))


def _from(select: str) -> str:
    return f"SELECT event_id, {select} FROM ({_EVENTS}) e"


_OBJ, _DBA, _SLOT = "(event_id * 97 + 70000)", "(event_id * 524287 % 4294967296)", "(event_id % 700)"
ORACLE = {
    "fmt_timestamp_modes": _from(", ".join(f"{x} AS m{m}" for m, x in enumerate(_sql_modes()))),
    "fmt_timestamp_tz_modes": _from(", ".join([f"{_sql_epoch(p)}::VARCHAR || ',Europe/Warsaw' AS m{k}" for k, p in enumerate(formats.PLACES)] + [f"{_sql_iso(p, z)} || ' Europe/Warsaw' AS m{k + (4 if z else 8)}" for z in (True, False) for k, p in enumerate(formats.PLACES)])),
    "fmt_interval_dts_modes": _from(", ".join([f"{_SIGN} || (({_DS} + ((ns + {u // 2 if u > 1 else 0}) // {u}) // {1000000000 // u}) * {1000000000 // u} + ((ns + {u // 2 if u > 1 else 0}) // {u}) % {1000000000 // u})::VARCHAR AS m{m}" for m, u in enumerate((1, 1000, 1000000, 1000000000) * 2)] + [f"{_SIGN} || (event_id % 1000)::VARCHAR || '{c}' || {_CLOCK} AS m{8 + k}" for k, c in enumerate(" ,-")])),
    "fmt_interval_ytm_modes": _from(", ".join([f"{_YSIGN} || ((event_id % 500) * 12 + event_id % 12)::VARCHAR AS m{m}" for m in range(2)] + [f"{_YSIGN} || (event_id % 500)::VARCHAR || '{c}' || (event_id % 12)::VARCHAR AS m{2 + k}" for k, c in enumerate(" ,-")])),
    "fmt_xid_modes": _from(f"'0x' || {_hex(_U, 4)} || '.' || {_hex(_S, 3)} || '.' || {_hex(_Q, 8)} AS m0, {_U}::VARCHAR || '.' || {_S}::VARCHAR || '.' || {_Q}::VARCHAR AS m1, ({_U} * 281474976710656 + {_S} * 4294967296 + {_Q})::VARCHAR AS m2, {_swap(_U, 4)} || {_swap(_S, 4)} || {_swap(_Q, 8)} AS m3"),
    "fmt_scn_modes": _from(f"(event_id * 1000003 + 17)::VARCHAR AS m0, '0x' || {_hex('(event_id * 1000003 + 17)', 16)} AS m1, '0x' || {_hex('((event_id * 1000003 + 17) >> 32)', 4)} || '.' || {_hex('((event_id * 1000003 + 17) % 4294967296)', 8)} AS m2"),
    "xid_parse_roundtrip": _from(f"CASE WHEN event_id % 11 <> 0 THEN {_U} END AS usn, CASE WHEN event_id % 11 <> 0 THEN {_S} END AS slt, CASE WHEN event_id % 11 <> 0 THEN {_Q} END AS sqn"),
    "rowid_encode": _from(f"{_letters(_OBJ, 6)} || {_letters(f'{_DBA} >> 22', 3)} || {_letters(f'{_DBA} % 4194304', 6)} || {_letters(_SLOT, 3)} AS rid, {_hex(_DBA, 8)} || '.' || {_hex(f'({_OBJ} % 65536)', 4)} || '.' || {_hex(_SLOT, 4)} AS hex, true AS same_obj, {_DBA} AS dba, {_SLOT} AS slot"),
    "log_time_decode": _from("s AS epoch"),
    "zone_parse": _from("CASE WHEN event_id % 17 <= 15 THEN CAST((CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) * (event_id % 17 * 3600 + event_id % 60 * 60) AS BIGINT) END AS seconds"),
    "number_decode": _from("CASE WHEN event_id % 2 = 0 THEN (event_id * 7919 + 1)::VARCHAR ELSE (-(event_id * 7919 + 1))::VARCHAR END AS value"),
    "raw_and_characters": "SELECT c_custkey, lower(hex(encode(c_name))) AS raw, c_name AS text, lower(hex(encode(c_name))) AS hex FROM customer",
}
