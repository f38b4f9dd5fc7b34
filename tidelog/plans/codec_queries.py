"""Decoders of stored bytes, JSON texts, dictionary joins, files and stop rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import codec
from tidelog.operators import checkpoints, dictionary, diff, messages, rows
from tidelog.operators import transactions as tx
from tidelog.plans import fixtures, output_queries, scratch
from tidelog.sources import logs, sinks

_REDO = fixtures.text(fixtures.REDO)


def _customers(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")


def _hex(value, digits: int):
    return F.lpad(F.hex(value.cast("long")), digits, "0")


def binary_doubles(spark, sf_dir):
    """Whole numbers as doubles whose bits were turned to sort: positive ones by the sign bit, negative ones by all bits."""
    c = _customers(spark, sf_dir).withColumn("k", F.col("c_custkey").cast("long") + 1)
    # Exponent and fraction of k put together; the sign bit is the first of the first hexadecimal digit.
    c = c.withColumn("e", F.floor(F.log2(F.col("k") + 0.25)).cast("int"))
    bits = F.shiftleft((F.col("e") + 1023).cast("long"), 52) + F.expr("shiftleft(k - shiftleft(1L, e), 52 - e)")
    up = F.unhex(_hex(bits.bitwiseXOR(F.lit(-(1 << 63))), 16))
    down = F.unhex(_hex(bits.bitwiseOR(F.lit(-(1 << 63))).bitwiseXOR(F.lit(-1)), 16))
    return c.select("c_custkey", codec.binary_double(F.when(F.col("c_custkey") % 3 == 0, down).otherwise(up)).alias("value"))


def _date_hex(ts):
    two = lambda value, more: _hex(value + more, 2)
    year = F.year(ts)
    parts = [two(F.floor(year / 100), 100), two(year % 100, 100), two(F.month(ts), 0), two(F.day(ts), 0), two(F.hour(ts), 1), two(F.minute(ts), 1), two(F.second(ts), 1)]
    return F.concat(*parts)


def stored_timestamps(spark, sf_dir):
    """Dates of 7 bytes and timestamps of 11, some of them not valid."""
    e = _events(spark, sf_dir)
    nanos = F.date_format("ts", "SSSSSS").cast("long") * 1000
    data = F.when(F.col("event_id") % 3 == 0, _date_hex(F.col("ts"))).when(F.col("event_id") % 7 == 1, F.lit("7878FF0101010100")).otherwise(F.concat(_date_hex(F.col("ts")), _hex(nanos, 8)))
    value = codec.timestamp(F.unhex(data))
    return e.select("event_id", value["seconds"].alias("seconds"), value["nanos"].alias("nanos"))


def stored_zoned_timestamps(spark, sf_dir):
    e = _events(spark, sf_dir)
    hour, minute = F.col("event_id") % 25 - 12, F.when(F.col("event_id") % 25 < 12, -30).otherwise(30)
    region = F.col("event_id") % 10 == 9
    tail = F.when(region, F.lit("81A8")).otherwise(F.concat(_hex(hour + 20, 2), _hex(minute + 60, 2)))
    value = codec.timestamp_tz(F.unhex(F.concat(_date_hex(F.col("ts")), tail)), {106: "Europe/Warsaw"})
    return e.select("event_id", value["seconds"].alias("seconds"), value["nanos"].alias("nanos"), value["zone"].alias("zone"))


def stored_intervals(spark, sf_dir):
    c = _customers(spark, sf_dir)
    k = F.col("c_custkey")
    ym = codec.interval_ym(F.unhex(F.concat(_hex(k % 200 - 100 + (1 << 31), 8), _hex(F.when(k % 200 < 100, -(k % 12)).otherwise(k % 12) + 60, 2))))
    ds = codec.interval_ds(F.unhex(F.concat(_hex(k % 400 + (1 << 31), 8), _hex(k % 24 + 60, 2), _hex(k % 60 + 60, 2), _hex((k * 7) % 60 + 60, 2), _hex(k * 1001 + (1 << 31), 8))))
    return c.select("c_custkey", ym["negative"].alias("negative"), ym["year"].alias("year"), ym["month"].alias("month"), ds["day"].alias("day"), ds["hour"].alias("hour"), ds["second"].alias("second"), ds["nanos"].alias("nanos"))


def dates_before_christ(spark, sf_dir):
    """Years -4711 to -1 count without a year 0."""
    c = _customers(spark, sf_dir)
    year = -(F.col("c_custkey") * 37 % 4711 + 1)
    century, rest = F.ceil(year / 100), year - F.ceil(year / 100) * 100
    data = F.concat(_hex(century + 100, 2), _hex(rest + 100, 2), _hex(F.col("c_custkey") % 12 + 1, 2), _hex(F.col("c_custkey") % 28 + 1, 2), F.lit("010101"))
    return c.select("c_custkey", codec.timestamp(F.unhex(data))["seconds"].alias("seconds"))


def character_sets(spark, sf_dir):
    """A name's bytes in several character sets, back to text; malformed bytes become U+FFFD."""
    c = _customers(spark, sf_dir)
    k, out = F.col("c_custkey") % 4, None
    name = F.col("c_name")
    cases = [("AL32UTF8", F.encode(name, "UTF-8")), ("WE8ISO8859P1", F.encode(name, "ISO-8859-1")), ("AL16UTF16", F.encode(name, "UTF-16BE")), ("US7ASCII", F.concat(F.encode(name, "US-ASCII"), F.unhex(F.lit("FF"))))]
    for n, (charset, data) in enumerate(cases):
        part = c.where(k == n).select("c_custkey", F.lit(charset).alias("charset"), codec.characters(data, charset).alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def json_escapes(spark, sf_dir):
    """Quotes, backslashes, controls and nulls in the text of a message."""
    c = _customers(spark, sf_dir)
    odd = F.when(F.col("c_custkey") % 4 != 0, F.concat(F.col("c_name"), F.lit('"\\/\t\n\r\b\f\x01é')))
    body = messages.JsonObject().add("owner", odd).add("key", F.col("c_custkey"), text=False).column()
    return c.select("c_custkey", body.alias("body"))


def hidden_nulls(spark, sf_dir):
    """Nulls of columns whose type isn't supported are left out, on one side or both."""
    c = _customers(spark, sf_dir)
    image = F.create_map(F.lit("A"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.lit("C"), F.lit(None).cast("string"), F.lit("L"), F.lit(None).cast("string"), F.lit("X"), F.col("c_mktsegment"))
    types = F.create_map(F.lit("A"), F.lit(1), F.lit("C"), F.lit(112), F.lit("L"), F.lit(8), F.lit("X"), F.lit(8))
    return c.select("c_custkey", messages.image_json(diff.hide_unsupported(image, types, after=False)).alias("before"), messages.image_json(diff.hide_unsupported(image, types, after=True)).alias("after"))


def cluster_key_rows(spark, sf_dir):
    c = _customers(spark, sf_dir).withColumn("fb", (F.col("c_custkey") * 31 % 256).cast("int"))
    return rows.without_cluster_keys(c).select("c_custkey", "fb")


def sequence_intersect(spark, sf_dir):
    """Sequences that both the archive and the online logs have."""
    files = output_queries._files(spark, sf_dir).select("seq")
    return files.where("seq < 12").intersect(files.where("seq >= 8"))


def sequence_range(spark, sf_dir):
    files = output_queries._files(spark, sf_dir).withColumn("resetlogs", F.col("seq") % 3)
    return logs.sequence_range(files)


def stop_after_checkpoints(spark, sf_dir):
    """Positions up to the seventh checkpoint."""
    positions = output_queries._lwns(spark, sf_dir)
    due = positions.where("lwn_id % 9 = 4").select("scn")
    return logs.after_checkpoints(positions, due, 7).select("lwn_id", "scn")


def header_probe(spark, sf_dir):
    """Byte order and block size of the first bytes of files, some of them not logs."""
    c = _customers(spark, sf_dir)
    k = F.col("c_custkey") % 5
    size = F.when(k == 0, "00020000").when(k == 1, "00040000").when(k == 2, "00100000").otherwise("00000200")
    magic = F.when(k == 3, "7A7B7C7D").when(k == 4, "00000000").otherwise("7D7C7B7A")
    head = F.concat(F.lit("00"), F.when(k == 2, "82").otherwise("22"), F.repeat(F.lit("00"), 18), size, F.repeat(F.lit("00"), 4), magic)
    found = logs.probe(F.unhex(head))
    return c.select("c_custkey", found["big_endian"].alias("big_endian"), found["block_size"].alias("block_size"))


def block_scan(spark, sf_dir):
    """Files cut into blocks: a row a block, with its first and last byte."""
    c = _customers(spark, sf_dir).where("c_custkey <= 200")
    content = F.unhex(F.repeat(F.concat(_hex(F.col("c_custkey") % 256, 2), F.repeat(F.lit("00"), 510), _hex(F.col("c_custkey") % 251, 2)), 3))
    cut = logs.blocks(c.select(F.col("c_custkey").cast("string").alias("path"), content.alias("content")), 512)
    return cut.select(F.col("path").cast("long").alias("c_custkey"), F.col("block").cast("long"), codec.byte(F.col("data"), 0).alias("first"), codec.byte(F.col("data"), 511).alias("last"))


def output_rotation(spark, sf_dir):
    """Messages in files of at most 4,000 bytes: all are there, in order, and only messages larger than that pass it."""
    sent = output_queries._messages(spark, sf_dir).select("id", F.concat(F.lit("message "), F.col("id").cast("string")).alias("body"))
    files = sinks.write_files(sent, f"{scratch.path(spark, 'out')}/m-%4i.txt", ["id"], new_line=2, max_file_size=4000)
    number = F.regexp_extract("file", r"m-(\d+)\.txt$", 1).cast("long")
    whole = files.agg(F.sum("messages").alias("messages"), F.sum("bytes").alias("bytes"), (F.max("bytes") <= 4000).alias("within"), (F.max(number) + 1 == F.count("*")).alias("numbered"))
    content = spark.read.format("binaryFile").load([r.file for r in files.collect()] or [])
    lines = content.select(F.regexp_extract("path", r"m-(\d+)\.txt$", 1).cast("long").alias("f"), F.posexplode(F.split(F.col("content").cast("string"), "\r\n")).alias("n", "line")).where("line <> ''")
    ids = lines.select(F.col("f") * 1_000_000 + F.col("n"), F.expr("CAST(substr(line, 9) AS BIGINT)").alias("id")).toDF("at", "id")
    # In order: the file and line of a message rise with its id.
    apart = ids.withColumn("before", F.max("id").over(tx.Window.partitionBy(F.floor(F.col("at") / 1_000_000)).orderBy("at").rowsBetween(-1, -1)))
    return whole.crossJoin(apart.agg(F.count(F.when(F.col("before") >= F.col("id"), 1)).alias("out_of_order"), F.countDistinct("id").alias("distinct_ids")))


def log_dump(spark, sf_dir):
    """The log as lines, of the transactions that a dump names."""
    redo = fixtures.redo(spark, sf_dir)
    return logs.dump(tx.only(redo, tx.transactions(redo).where("sqn % 5 = 2"))).select("scn", "sub_scn", "line")


def _parts(spark, sf_dir):
    """Dictionary rows of tables: owners, objects, columns, constraints and large objects."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("obj"), "n_name", F.col("n_regionkey").cast("long").alias("user_id"))
    owners = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("user_id"), F.col("r_name").alias("owner"))
    columns = n.select("obj", F.explode(F.sequence(F.lit(1), (F.col("obj") % 5 + 1).cast("int"))).alias("col")).withColumns({"int_col": F.col("col"), "name": F.concat(F.lit("C"), F.col("col").cast("string")), "is_guard": F.col("col") == 4})
    keys = columns.where("col <= 2 AND obj % 3 <> 0").select("obj", "int_col", F.lit("P").alias("type"))
    lobs = columns.where("col = 3").select("obj", "int_col", (F.col("obj") * 100 + 3).alias("lob_obj"))
    return owners, n.select("obj", "user_id", F.col("n_name").alias("name")), columns, keys, lobs


def dictionary_snapshot(spark, sf_dir):
    """Owners, objects, columns and large objects of one owner's tables joined, as a snapshot reads them."""
    owners, objects, columns, _, lobs = _parts(spark, sf_dir)
    return dictionary.snapshot_columns(owners.where("user_id < 3"), objects, columns, lobs).select("owner", "obj", "table_name", "col", "name", "lob_obj")


def table_maps_with_lobs(spark, sf_dir):
    """A row for each table with its columns, key, guard columns and large objects."""
    _, objects, columns, keys, lobs = _parts(spark, sf_dir)
    maps = dictionary.table_maps(objects, columns, keys, lobs)
    return maps.select("obj", F.array_join("cols", ",").alias("cols"), F.array_join("key", ",").alias("key"), F.array_join("guards", ",").alias("guards"), F.array_join(F.transform("lobs", lambda x: x.cast("string")), ",").alias("lobs"))


def uncommitted_names(spark, sf_dir):
    """Names of records of tables that aren't committed yet, from the rows of the transaction that makes them."""
    owners, objects, _, _, _ = _parts(spark, sf_dir)
    changes = fixtures.redo(spark, sf_dir).where(F.col("kind").isin(*tx.CHANGES)).select("scn", (F.col("scn") % 30).alias("obj"))
    known = objects.where("obj < 10").join(owners, "user_id").select("obj", "owner", "name")
    return dictionary.named(changes, known, objects.where("obj >= 10"), owners.where("user_id <> 2"))


def key_override(spark, sf_dir):
    """A rule's key instead of the primary key, and what it names that tables don't have."""
    _, objects, columns, keys, lobs = _parts(spark, sf_dir)
    maps = dictionary.override_key(dictionary.table_maps(objects, columns, keys, lobs), ["C3", "C1"])
    return maps.select("obj", F.array_join("key", ",").alias("key"), F.array_join("missing", ",").alias("missing"))


def checkpoints_shown(spark, sf_dir):
    """Checkpoint messages go to a sink only where they are asked for."""
    points = output_queries._points(spark, sf_dir).select("scn", F.lit("checkpoint").alias("place"))
    sent = fixtures.redo(spark, sf_dir).where("kind = 'COMMIT'").select("scn", F.lit("commit").alias("place")).unionByName(points)
    hidden, shown = sinks.without_checkpoints(sent), sinks.without_checkpoints(sent, show=True)
    return hidden.withColumn("flag", F.lit(False)).unionByName(shown.withColumn("flag", F.lit(True))).groupBy("flag", "place").agg(F.count("*").alias("n"))


def metrics_output(spark, sf_dir):
    """Messages and bytes sent, and how far the confirmed position lies behind."""
    sent = output_queries._messages(spark, sf_dir).withColumn("body", F.concat(F.lit("m"), F.col("id").cast("string")))
    last = checkpoints.confirmed(sent).select(F.col("id").alias("confirmed_id"))
    return sent.agg(F.count("*").alias("messages_sent"), F.sum(F.octet_length("body")).alias("bytes_sent"), F.max("id").alias("last_id")).crossJoin(last).withColumn("lag", F.col("last_id") - F.col("confirmed_id"))


QUERIES = {
    f.__name__: f
    for f in (
        binary_doubles, stored_timestamps, stored_zoned_timestamps, stored_intervals, dates_before_christ, character_sets, json_escapes, hidden_nulls, cluster_key_rows,
        sequence_intersect, sequence_range, stop_after_checkpoints, header_probe, block_scan, output_rotation, dictionary_snapshot, table_maps_with_lobs, uncommitted_names,
        key_override, checkpoints_shown, metrics_output, log_dump,
    )
}

_S = "CAST(floor(epoch(ts)) AS BIGINT)"
_COLS = "(SELECT n_nationkey::BIGINT AS obj, unnest(range(1, n_nationkey % 5 + 2)) AS col FROM nation)"
_OWNER = "(SELECT n_nationkey::BIGINT AS obj, n_name AS name, n_regionkey::BIGINT AS user_id FROM nation)"
ORACLE = {
    "binary_doubles": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN -(c_custkey + 1)::DOUBLE ELSE (c_custkey + 1)::DOUBLE END AS value FROM customer",
    "stored_timestamps": f"""
SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_id % 7 = 1 THEN NULL ELSE {_S} END AS seconds,
       CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 7 = 1 THEN NULL ELSE (epoch_us(ts) % 1000000) * 1000 END AS nanos FROM events""",
    "stored_zoned_timestamps": f"""
SELECT event_id, {_S} AS seconds, CAST(0 AS BIGINT) AS nanos,
       CASE WHEN event_id % 10 = 9 THEN 'Europe/Warsaw' ELSE CASE WHEN event_id % 25 < 12 THEN '-' ELSE '+' END || lpad(abs(event_id % 25 - 12)::VARCHAR, 2, '0') || ':30' END AS zone FROM events""",
    "stored_intervals": """
SELECT c_custkey, c_custkey % 200 < 100 AS negative, abs(c_custkey % 200 - 100)::BIGINT AS year, (c_custkey % 12)::BIGINT AS month, (c_custkey % 400)::BIGINT AS day, (c_custkey % 24)::BIGINT AS hour,
       (c_custkey * 7 % 60)::BIGINT AS second, (c_custkey * 1001)::BIGINT AS nanos FROM customer""",
    "dates_before_christ": "SELECT c_custkey, CAST(datediff('day', DATE '1970-01-01', make_date(-(c_custkey * 37 % 4711), c_custkey % 12 + 1, c_custkey % 28 + 1)) AS BIGINT) * 86400 AS seconds FROM customer",
    "character_sets": """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'AL32UTF8' WHEN 1 THEN 'WE8ISO8859P1' WHEN 2 THEN 'AL16UTF16' ELSE 'US7ASCII' END AS charset, CASE WHEN c_custkey % 4 = 3 THEN c_name || chr(65533) ELSE c_name END AS text FROM customer""",
    "json_escapes": r"""
SELECT c_custkey, '{"owner":' || CASE WHEN c_custkey % 4 <> 0 THEN '"' || c_name || '\"\\/\t\n\r\b\f\u0001é"' ELSE 'null' END || ',"key":' || c_custkey || '}' AS body FROM customer""",
    "hidden_nulls": """
SELECT c_custkey, '{"A":' || CASE WHEN c_custkey % 2 = 0 THEN '"' || c_name || '"' ELSE 'null' END || ',"X":"' || c_mktsegment || '"}' AS before,
       '{"A":' || CASE WHEN c_custkey % 2 = 0 THEN '"' || c_name || '"' ELSE 'null' END || ',"C":null,"X":"' || c_mktsegment || '"}' AS after FROM customer""",
    "cluster_key_rows": "SELECT c_custkey, CAST(c_custkey * 31 % 256 AS INTEGER) AS fb FROM customer WHERE c_custkey * 31 % 256 < 128",
    "sequence_intersect": f"SELECT DISTINCT seq FROM ({_REDO}) WHERE seq % 6 <> 4 AND seq BETWEEN 8 AND 11",
    "sequence_range": f"SELECT seq % 3 AS resetlogs, min(seq) AS first_seq, max(seq) AS last_seq FROM ({_REDO}) WHERE seq % 6 <> 4 GROUP BY 1",
    "stop_after_checkpoints": f"""
WITH p AS (SELECT CAST(floor(scn / 20) AS BIGINT) AS lwn_id, max(scn) AS scn FROM ({_REDO}) GROUP BY 1), d AS (SELECT scn FROM p WHERE lwn_id % 9 = 4 ORDER BY scn LIMIT 7)
SELECT lwn_id, scn FROM p WHERE (SELECT count(*) FROM d) < 7 OR scn <= (SELECT max(scn) FROM d)""",
    "header_probe": """
SELECT c_custkey, CASE WHEN c_custkey % 5 < 4 THEN c_custkey % 5 = 3 END AS big_endian, CASE c_custkey % 5 WHEN 0 THEN 512 WHEN 1 THEN 1024 WHEN 2 THEN 4096 WHEN 3 THEN 512 END::BIGINT AS block_size FROM customer""",
    "block_scan": "SELECT c_custkey, unnest(range(0, 3)) AS block, CAST(c_custkey % 256 AS INTEGER) AS first, CAST(c_custkey % 251 AS INTEGER) AS last FROM customer WHERE c_custkey <= 200",
    "output_rotation": f"""
SELECT count(*) AS messages, CAST(sum(length('message ' || scn) + 2) AS BIGINT) AS bytes, true AS within, true AS numbered, CAST(0 AS BIGINT) AS out_of_order, count(DISTINCT scn) AS distinct_ids
FROM ({_REDO}) WHERE kind IN ('INSERT', 'UPDATE', 'DELETE')""",
    "log_dump": f"""
SELECT scn, sub_scn, 'SEQ ' || seq || ' SCN ' || scn || ':' || sub_scn || ' XID ' || lpad(lower(to_hex(usn)), 4, '0') || '.' || lpad(lower(to_hex(slt)), 3, '0') || '.' || lpad(lower(to_hex(sqn)), 8, '0')
       || ' ' || kind || ' OBJ ' || coalesce(obj::VARCHAR, '-') || ' SIZE ' || size AS line FROM ({_REDO}) WHERE sqn % 5 = 2""",
    "dictionary_snapshot": f"""
SELECT r_name AS owner, o.obj, o.name AS table_name, col, 'C' || col AS name, CASE WHEN col = 3 THEN o.obj * 100 + 3 END AS lob_obj
FROM {_OWNER} o JOIN region ON r_regionkey = user_id AND user_id < 3 JOIN {_COLS} c ON c.obj = o.obj""",
    "table_maps_with_lobs": f"""
SELECT obj, string_agg('C' || col, ',' ORDER BY col) AS cols, coalesce(string_agg(CASE WHEN col <= 2 AND obj % 3 <> 0 THEN 'C' || col END, ',' ORDER BY col), '') AS key,
       coalesce(string_agg(CASE WHEN col = 4 THEN 'C4' END, ','), '') AS guards, coalesce(string_agg(CASE WHEN col = 3 THEN (obj * 100 + 3)::VARCHAR END, ','), '') AS lobs FROM {_COLS} GROUP BY obj""",
    "uncommitted_names": f"""
SELECT scn, c.obj, CASE WHEN c.obj < 10 OR user_id <> 2 THEN r_name END AS owner, CASE WHEN c.obj < 10 OR user_id <> 2 THEN o.name END AS name
FROM (SELECT scn, scn % 30 AS obj FROM ({_REDO}) WHERE kind IN ('INSERT', 'UPDATE', 'DELETE')) c LEFT JOIN {_OWNER} o ON o.obj = c.obj LEFT JOIN region ON r_regionkey = user_id""",
    "key_override": f"""
SELECT obj, coalesce(string_agg(CASE WHEN col IN (1, 3) THEN 'C' || col END, ',' ORDER BY col), '') AS key, CASE WHEN max(col) < 3 THEN 'C3' ELSE '' END AS missing FROM {_COLS} GROUP BY obj""",
    "checkpoints_shown": f"""
WITH c AS (SELECT count(*) AS n FROM ({_REDO}) WHERE kind = 'COMMIT'), p AS (SELECT count(DISTINCT CAST(floor(scn / 500) AS BIGINT)) AS n FROM ({_REDO}))
SELECT false AS flag, 'commit' AS place, n FROM c UNION ALL SELECT true, 'commit', n FROM c UNION ALL SELECT true, 'checkpoint', n FROM p""",
    "metrics_output": f"""
WITH m AS (SELECT scn AS id, scn % 977 <> 500 OR scn < 700 AS confirmed FROM ({_REDO}) WHERE kind IN ('INSERT', 'UPDATE', 'DELETE')),
c AS (SELECT max(id) AS id FROM m WHERE id < coalesce((SELECT min(id) FROM m WHERE NOT confirmed), 9223372036854775807))
SELECT count(*) AS messages_sent, CAST(sum(length('m' || m.id)) AS BIGINT) AS bytes_sent, max(m.id) AS last_id, (SELECT id FROM c) AS confirmed_id, max(m.id) - (SELECT id FROM c) AS lag FROM m""",
}
