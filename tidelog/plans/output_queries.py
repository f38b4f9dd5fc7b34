"""Queries over large objects, messages, positions, metrics, log files and analytics on change tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import formats
from tidelog.operators import checkpoints, dictionary, lob, messages, metrics
from tidelog.operators import transactions as tx
from tidelog.plans import fixtures
from tidelog.sources import logs, sinks

_REDO = fixtures.text(fixtures.REDO)
_DICT = fixtures.text(fixtures.DICTIONARY)
PAGE = 1000


def _pages(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL AND text <> ''").select(F.col("doc_id").alias("lob_id"), "text")
    pages = d.select("lob_id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PAGE).cast("int"))).alias("page_no"))
    pages = pages.select("lob_id", "page_no", F.substring("text", F.col("page_no") * PAGE + 1, F.lit(PAGE)).alias("page"))
    sizes = d.select("lob_id", F.floor(F.length("text") / PAGE).cast("int").alias("size_pages"), (F.length("text") % PAGE).alias("size_rest"))
    return pages, sizes


def lob_reassemble(spark, sf_dir):
    return lob.reassemble(_pages(spark, sf_dir)[0]).select("lob_id", "value", "n_pages", "status")


def lob_damage(spark, sf_dir):
    pages, sizes = _pages(spark, sf_dir)
    pages = pages.where("NOT (lob_id % 5 = 2 AND page_no = 1)")
    return lob.reassemble(pages, sizes.where("lob_id % 7 <> 3")).select("lob_id", "n_pages", "status")


def lob_orphan_pages(spark, sf_dir):
    pages, _ = _pages(spark, sf_dir)
    locators = pages.select("lob_id").distinct().where("lob_id % 3 <> 1").withColumn("owner_sqn", F.col("lob_id") * 2)
    known, orphans = lob.with_orphans(pages, locators)
    return known.groupBy("lob_id", "owner_sqn").agg(F.count("*").alias("n")).unionByName(orphans.groupBy("lob_id").agg(F.count("*").alias("n")).withColumn("owner_sqn", F.lit(None).cast("long")))


def _shown(spark, sf_dir):
    placed = tx.committed_changes(fixtures.redo(spark, sf_dir))
    named = dictionary.schemaless(dictionary.as_of(placed, fixtures.dictionary(spark, sf_dir)))
    letter = F.when(F.col("kind") == "INSERT", "c").when(F.col("kind") == "DELETE", "d").otherwise("u")
    image = F.create_map(F.lit("ID"), F.col("scn").cast("string"), F.lit("SIZE"), F.when(F.col("scn") % 4 != 0, F.col("size").cast("string")))
    return named.withColumns({
        "op": letter, "ts_s": formats.seconds_of(F.col("ts")), "begin_s": formats.seconds_of(F.col("begin_ts")), "commit_s": formats.seconds_of(F.col("end_ts")), "c_scn": F.col("begin_scn"), "c_idx": F.col("num") + 1,
        "user": F.concat(F.lit("U"), F.col("usn").cast("string")), "thread": F.lit(1), "owner": F.coalesce("owner", F.lit("?")), "rid": F.lit("AAAAAAAAAAAAAAAAAA"),
        "before_json": messages.image_json(image), "after_json": messages.image_json(image), "attrs_json": F.lit(None).cast("string"), "columns_json": F.lit('["ID","SIZE"]'),
    })


def debezium_envelope(spark, sf_dir):
    options = messages.FormatOptions.debezium(database="DB1")
    return messages.dml(messages.first_of_obj(_shown(spark, sf_dir), ["commit_scn", "scn"]), options).select(*tx.XID, "scn", "body")


def plain_envelope(spark, sf_dir):
    return messages.dml(messages.first_of_obj(_shown(spark, sf_dir), ["commit_scn", "scn"]), messages.FormatOptions(schema=1)).select(*tx.XID, "scn", "body")


def schema_once(spark, sf_dir):
    return messages.first_of_obj(_shown(spark, sf_dir), ["commit_scn", "scn"]).where("first_of_obj").select("obj", "commit_scn", "scn")


def tx_one_message(spark, sf_dir):
    options = messages.FormatOptions(message=1)
    changes = messages.dml(messages.first_of_obj(_shown(spark, sf_dir), ["commit_scn", "scn"]), options)
    return messages.one_message(changes, options).select(*tx.XID, "n_changes", F.octet_length("body").cast("long").alias("n_bytes"))


def begin_commit_messages(spark, sf_dir):
    done = tx.emitted(tx.transactions(fixtures.redo(spark, sf_dir)))
    rows = done.withColumns({"scn": F.col("begin_scn"), "ts_s": formats.seconds_of(F.col("begin_ts")), "begin_s": formats.seconds_of(F.col("begin_ts")), "commit_s": formats.seconds_of(F.col("end_ts")), "c_scn": F.col("begin_scn"), "c_idx": F.lit(0), "user": F.lit("U"), "thread": F.lit(1)})
    both = messages.around(rows, messages.FormatOptions(), "begin").withColumn("place", F.lit("begin")).unionByName(messages.around(rows.withColumn("scn", F.col("commit_scn")), messages.FormatOptions(), "commit").withColumn("place", F.lit("commit")))
    return both.select(*tx.XID, "place", "body")


def checkpoint_messages(spark, sf_dir):
    lwns = _lwns(spark, sf_dir).withColumns({"ts_s": formats.seconds_of(F.col("ts")), "c_scn": F.col("scn"), "c_idx": F.lit(0), "redo": F.col("scn") % 2 == 0})
    return messages.checkpoints(lwns, messages.FormatOptions(scn=1)).select("lwn_id", "body")


def ddl_text_assembly(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    parts = F.array(F.lit("SHOP"), F.lit("ALTER TABLE "), F.col("c_name"), F.col("c_mktsegment"))
    chunks = c.select("c_custkey", F.posexplode(parts).alias("p", "chunk")).select("c_custkey", (F.col("p") + 1).alias("seq_no"), "chunk", F.lit(4).alias("n_chunks")).where("NOT (c_custkey % 9 = 4 AND seq_no = 3)")
    return messages.ddl_text(chunks, ["c_custkey"])


def session_attributes(spark, sf_dir):
    redo = fixtures.redo(spark, sf_dir).where(F.col("kind").isin(*tx.CHANGES))
    pieces = redo.select(*tx.XID, F.when(F.col("scn") % 2 == 0, "login username").otherwise("client id").alias("name"), F.concat(F.lit("v"), F.col("scn").cast("string")).alias("value"), F.col("scn").alias("pos"))
    got = messages.attributes(pieces)
    return got.select(*tx.XID, F.element_at("attrs", "login username").alias("login"), F.element_at("attrs", "client id").alias("client"))


def metrics_dml_ops(spark, sf_dir):
    rows = fixtures.redo(spark, sf_dir).where(F.col("kind").isin(*tx.CHANGES))
    named = dictionary.as_of(rows, fixtures.dictionary(spark, sf_dir)).withColumn("shown", F.col("name").isNotNull())
    return metrics.dml_ops(named, by_table=True)


def metrics_transactions(spark, sf_dir):
    return metrics.transactions(tx.classes(tx.transactions(fixtures.redo(spark, sf_dir)), 200))


def metrics_ddl_ops(spark, sf_dir):
    codes = F.element_at(F.array(*map(F.lit, (1, 4, 9, 85, 8, 12, 15, 11, 198, 99))), (F.col("c_custkey") % 10 + 1).cast("int"))
    return metrics.ddl_ops(spark.read.parquet(f"{sf_dir}/customer.parquet").select(codes.alias("code")))


def metrics_prometheus(spark, sf_dir):
    return metrics.prometheus(metrics_transactions(spark, sf_dir), "transactions")


def metrics_log_switches(spark, sf_dir):
    files = fixtures.redo(spark, sf_dir).groupBy("seq").agg(F.sum("size").alias("bytes")).withColumn("type", F.when(F.col("seq") % 4 == 3, "online").otherwise("archived"))
    return metrics.log_switches(files)


def metrics_lag(spark, sf_dir):
    return metrics.lag(fixtures.redo(spark, sf_dir).select("ts", (F.col("ts") + F.make_dt_interval(secs=F.col("scn") % 50)).alias("sent_ts")))


def low_watermark(spark, sf_dir):
    """The oldest transaction that is still open at the end of the log, which lacks the ends of some."""
    redo = fixtures.redo(spark, sf_dir).where(f"NOT ({fixtures.UNENDED})")
    begins = redo.where("kind = 'BEGIN'").select("seq", F.col("scn").alias("offset"), *tx.XID)
    done = redo.where("kind IN ('COMMIT', 'ROLLBACK')").select(*tx.XID)
    return checkpoints.low_watermark(begins.join(done, tx.XID, "left_anti"))


def _lwns(spark, sf_dir):
    redo = fixtures.redo(spark, sf_dir).withColumns({"lwn_id": F.floor(F.col("scn") / 20), "offset": F.col("scn") * 512})
    return checkpoints.lwn_positions(redo)


def lwn_positions(spark, sf_dir):
    return _lwns(spark, sf_dir)


def checkpoint_due(spark, sf_dir):
    positions = _lwns(spark, sf_dir).withColumn("bytes", F.col("offset") * 40)
    return checkpoints.due(positions, interval_s=3600 * 20, interval_mb=3, schema_every=3)


def _points(spark, sf_dir):
    return fixtures.redo(spark, sf_dir).select((F.floor(F.col("scn") / 500) * 500).alias("scn")).distinct().withColumn("has_schema", F.col("scn") % 3000 == 0)


def checkpoint_retention(spark, sf_dir):
    return checkpoints.retained(_points(spark, sf_dir), keep=5)


def recovery_point(spark, sf_dir):
    return checkpoints.recovery_point(_points(spark, sf_dir), 4321)


def _messages(spark, sf_dir):
    return fixtures.redo(spark, sf_dir).where(F.col("kind").isin(*tx.CHANGES)).select(F.col("scn").alias("id"), F.floor(F.col("scn") / 7).alias("c_scn"), (F.col("scn") % 7).alias("c_idx"), ((F.col("scn") % 977 != 500) | (F.col("scn") < 700)).alias("confirmed"))


def confirm_prefix(spark, sf_dir):
    return checkpoints.confirmed(_messages(spark, sf_dir))


def resume_dedup(spark, sf_dir):
    sent = _messages(spark, sf_dir)
    again = sent.where("id % 4 = 1")
    return checkpoints.once(checkpoints.after(sent.unionByName(again), 300, 3)).select("c_scn", "c_idx")


def _files(spark, sf_dir):
    seqs = fixtures.redo(spark, sf_dir).select("seq").distinct().where("seq % 6 <> 4")
    return seqs.withColumn("name", F.concat(F.lit("arch_1_"), F.col("seq").cast("string"), F.lit("_abc9.dbf")))


def log_seq_from_filename(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("name", F.when(F.col("seq") % 5 == 0, "other.txt").otherwise(F.col("name")))
    return files.select(F.col("seq").alias("want"), logs.sequence_of(F.col("name"), "arch_%t_%s_%h.dbf").alias("seq"))


def path_mapping(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat(F.lit("/"), F.col("c_mktsegment"), F.lit("/a/"), F.col("c_name")).alias("path"))
    return c.select("c_custkey", logs.map_path(F.col("path"), [("/BUILDING/a", "/x"), ("/B", "/y"), ("/AUTO", "/z/")]).alias("path"))


def gap_check(spark, sf_dir):
    return logs.gaps(_files(spark, sf_dir), 1)


def usable_files(spark, sf_dir):
    return logs.usable(_files(spark, sf_dir), 1).select("seq")


def incarnation_order(spark, sf_dir):
    return logs.by_incarnation(_files(spark, sf_dir).withColumn("resetlogs", F.col("seq") % 3)).select("resetlogs", "seq", F.col("turn").cast("long"))


def start_position(spark, sf_dir):
    redo = fixtures.redo(spark, sf_dir)
    cases = {"scn": {"scn": 4000}, "seq": {"seq": 7}, "time": {"time": "2024-01-10 00:00:00"}, "back": {"seconds_back": 86400}}
    out = None
    for name, case in cases.items():
        part = logs.from_position(redo, **case).agg(F.count("*").alias("n"), F.min("scn").alias("first")).select(F.lit(name).alias("start"), "n", "first")
        out = part if out is None else out.unionByName(part)
    return out


def block_validation(spark, sf_dir):
    """Blocks of 512 bytes built from events: number, sequence and payload, some of them spoilt."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("block"))
    little = lambda c, n: F.concat(*(F.lpad(F.hex(F.shiftright(c, 8 * k).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for k in range(n)))
    number = F.when(F.col("block") % 13 == 5, F.col("block") + 1).otherwise(F.col("block")).cast("long")
    seq = F.when(F.col("block") % 17 == 3, F.lit(41)).otherwise(F.lit(42)).cast("long")
    # Every 16-bit word of the body occurs twice, so the sum is that of the head alone.
    head = F.concat(F.lit("0122"), F.lit("0000"), little(number, 4), little(seq, 4), F.lit("0000"))
    rows = e.withColumn("head", head)
    words = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.conv(F.substring(F.col("head"), k * 4 + 3, F.lit(2)), 16, 10).cast("int") * 256 + F.conv(F.substring(F.col("head"), k * 4 + 1, F.lit(2)), 16, 10).cast("int"))
    rows = rows.withColumn("sum", F.aggregate(words, F.lit(0), lambda acc, w: acc.bitwiseXOR(w)))
    rows = rows.withColumn("sum", F.when(F.col("block") % 19 == 7, F.col("sum").bitwiseXOR(F.lit(1))).otherwise(F.col("sum")).cast("long"))
    body = F.repeat(F.lpad(F.hex(F.col("block") % 65536), 4, "0"), 248)
    data = F.when(F.col("block") % 23 == 1, F.unhex(F.repeat(F.lit("00"), 512))).otherwise(F.unhex(F.concat("head", little(F.col("sum"), 2), body)))
    return logs.check_blocks(rows.select("block", data.alias("data")), 512, 42).select("block", "status")


def kafka_rows(spark, sf_dir):
    m = _messages(spark, sf_dir).select(F.col("c_scn").cast("string").alias("tag"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("body"))
    return sinks.kafka_rows(m, "changes", 5).groupBy("topic", "too_large").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys"))


def sequence_union(spark, sf_dir):
    """Online and archived sequences together: distinct, and with repeats."""
    files = _files(spark, sf_dir).select("seq")
    archived, online = files.where("seq < 12"), files.where("seq >= 8")
    distinct = archived.union(online).distinct().select(F.lit("distinct").alias("kind"), "seq")
    return distinct.unionByName(archived.unionByName(online).select(F.lit("all").alias("kind"), "seq"))


def change_cube(spark, sf_dir):
    """Ordinary analytics on the change table: cube with grouping ids."""
    rows = fixtures.redo(spark, sf_dir).where(F.col("kind").isin(*tx.CHANGES))
    return rows.cube("kind", "obj").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.grouping_id().cast("long").alias("gid"))


def change_sessions(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    got = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return got.select("user_id", F.col("w.start").alias("first_ts"), "n")


def change_windows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).select(F.col("w.start").alias("day"), "event_type", "n", "users")


def change_percentiles(spark, sf_dir):
    rows = fixtures.redo(spark, sf_dir).where(F.col("kind").isin(*tx.CHANGES))
    return rows.groupBy("kind").agg(F.percentile("size", 0.5).alias("p50"), F.percentile("size", 0.9).alias("p90"), F.countDistinct("usn", "slt", "sqn").alias("n_tx"))


QUERIES = {
    f.__name__: f
    for f in (
        lob_reassemble, lob_damage, lob_orphan_pages, debezium_envelope, plain_envelope, schema_once, tx_one_message, begin_commit_messages, checkpoint_messages,
        ddl_text_assembly, session_attributes, metrics_dml_ops, metrics_transactions, metrics_ddl_ops, metrics_prometheus, metrics_log_switches, metrics_lag,
        low_watermark, lwn_positions, checkpoint_due, checkpoint_retention, recovery_point, confirm_prefix, resume_dedup, log_seq_from_filename, path_mapping,
        gap_check, usable_files, incarnation_order, start_position, block_validation, kafka_rows, sequence_union, change_cube, change_sessions, change_windows, change_percentiles,
    )
}

from tidelog.plans.transaction_queries import _TX  # noqa: E402

_CH = f"(SELECT * FROM ({_REDO}) WHERE kind IN ('INSERT', 'UPDATE', 'DELETE'))"
_D = "(SELECT doc_id AS lob_id, text FROM documents WHERE text IS NOT NULL AND text <> '')"
_N = f"CAST((length(text) - 1) // {PAGE} + 1 AS BIGINT)"
_SHOWN = _TX + f""",
dict AS ({_DICT}),
placed AS (SELECT live.*, begin_scn, commit_scn, b.ts AS begin_ts, c.ts AS end_ts, row_number() OVER (PARTITION BY live.usn, live.slt, live.sqn ORDER BY live.scn, live.sub_scn) - 1 AS num
  FROM live JOIN out_tx USING (usn, slt, sqn) JOIN (SELECT usn, slt, sqn, ts FROM redo WHERE kind = 'BEGIN') b USING (usn, slt, sqn) JOIN (SELECT usn, slt, sqn, ts FROM redo WHERE kind = 'COMMIT') c USING (usn, slt, sqn)),
shown AS (SELECT p.*, coalesce(owner, '?') AS owner, coalesce(name, 'OBJ_' || p.obj) AS name, CASE kind WHEN 'INSERT' THEN 'c' WHEN 'DELETE' THEN 'd' ELSE 'u' END AS op,
    '{{"ID":"' || scn || '","SIZE":' || coalesce('"' || CASE WHEN scn % 4 <> 0 THEN size END || '"', 'null') || '}}' AS image,
    row_number() OVER (PARTITION BY p.obj ORDER BY commit_scn, scn) = 1 AS first_of_obj,
    CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, CAST(floor(epoch(begin_ts)) AS BIGINT) AS begin_s, CAST(floor(epoch(end_ts)) AS BIGINT) AS commit_s
  FROM placed p LEFT JOIN dict d ON p.obj = d.obj AND scn >= valid_from AND (valid_to IS NULL OR scn < valid_to))
"""
_HX = lambda v, n: f"lpad(lower(to_hex({v})), {n}, '0')"
_SWAP = lambda v, n: " || ".join(f"substr({_HX(v, n)}, {n - 1 - 2 * k}, 2)" for k in range(n // 2))
_XIDT = f"'0x' || {_HX('usn', 4)} || '.' || {_HX('slt', 3)} || '.' || {_HX('sqn', 8)}"
_SIDES = "CASE WHEN op <> 'c' THEN ',\"before\":' || image ELSE '' END || CASE WHEN op <> 'd' THEN ',\"after\":' || image ELSE '' END"
_PLAIN_PAYLOAD = f"'{{\"op\":\"' || op || '\",\"schema\":{{\"owner\":\"' || owner || '\",\"table\":\"' || name || '\"' || CASE WHEN first_of_obj THEN ',\"columns\":[\"ID\",\"SIZE\"]' ELSE '' END || '}}' || {_SIDES} || '}}'"
_LWN = f"(SELECT CAST(floor(scn / 20) AS BIGINT) AS lwn_id, max(scn) AS scn, max(seq) AS seq, max(scn * 512) AS \"offset\", max(ts) AS ts FROM ({_REDO}) GROUP BY 1)"
_POINTS = f"(SELECT DISTINCT CAST(floor(scn / 500) AS BIGINT) * 500 AS scn, CAST(floor(scn / 500) AS BIGINT) * 500 % 3000 = 0 AS has_schema FROM ({_REDO}))"
_MSG = f"(SELECT scn AS id, CAST(floor(scn / 7) AS BIGINT) AS c_scn, scn % 7 AS c_idx, scn % 977 <> 500 OR scn < 700 AS confirmed FROM {_CH})"
_FILES = f"(SELECT DISTINCT seq FROM ({_REDO}) WHERE seq % 6 <> 4)"
_CLASSED = _TX + ", fates AS (SELECT *, CASE WHEN outcome IS NULL THEN 'open' WHEN outcome = 'ROLLBACK' THEN 'rollback' WHEN begin_scn IS NULL THEN 'partial' WHEN commit_scn <= 200 THEN 'skip' ELSE 'out' END AS fate FROM tx)"
_TXM = "SELECT lower(outcome) AS type, CASE fate WHEN 'rollback' THEN 'out' ELSE fate END AS filter, count(*) AS transactions FROM fates WHERE outcome IS NOT NULL GROUP BY 1, 2"
ORACLE = {
    "lob_reassemble": f"SELECT lob_id, text AS value, {_N} AS n_pages, 'ok' AS status FROM {_D}",
    "lob_damage": f"""
SELECT lob_id, n_pages, CASE WHEN lob_id % 7 = 3 THEN 'no size' WHEN n_pages < {_N} THEN 'page missing' ELSE 'ok' END AS status
FROM (SELECT lob_id, text, {_N} - CASE WHEN lob_id % 5 = 2 AND length(text) > {PAGE} THEN 1 ELSE 0 END AS n_pages FROM {_D})""",
    "lob_orphan_pages": f"SELECT lob_id, CASE WHEN lob_id % 3 <> 1 THEN lob_id * 2 END AS owner_sqn, {_N} AS n FROM {_D}",
    "debezium_envelope": _SHOWN + f"""
SELECT usn, slt, sqn, scn, '{{"scn":' || scn || ',"b_scn":' || begin_scn || ',"e_scn":' || commit_scn || ',"tm":' || ts_s * 1000 || ',"b_tm":' || begin_s * 1000 || ',"e_tm":' || commit_s * 1000
  || ',"c_scn":' || begin_scn || ',"c_idx":' || num + 1 || ',"xid":"' || {_SWAP('usn', 4)} || {_SWAP('slt', 4)} || {_SWAP('sqn', 8)} || '","db":"DB1","usr":"U' || usn || '","rth":1,"payload":[{{"op":"' || op
  || '","schema":{{"owner":"' || owner || '","table":"' || name || '","obj":' || obj || ',"columns":["ID","SIZE"]}},"num":' || num || ',"rid":"AAAAAAAAAAAAAAAAAA"' || {_SIDES} || '}}]}}' AS body FROM shown""",
    "plain_envelope": _SHOWN + f"""
SELECT usn, slt, sqn, scn, '{{"c_scn":' || begin_scn || ',"c_idx":' || num + 1 || ',"xid":"' || {_XIDT} || '","payload":[' || {_PLAIN_PAYLOAD} || ']}}' AS body FROM shown""",
    "schema_once": _SHOWN + "SELECT obj, commit_scn, scn FROM shown WHERE first_of_obj",
    "tx_one_message": _SHOWN + """
SELECT usn, slt, sqn, count(*) AS n_changes, CAST(strlen('{"scn":' || begin_scn || ',"tm":' || begin_s * 1000000000 || ',"c_scn":' || begin_scn || ',"c_idx":0,"xid":"0x0000.000.00000000","payload":[]}')
  + sum(strlen('{"op":"c","schema":{"owner":"' || owner || '","table":"' || name || '"}}')) + count(*) - 1
  + sum(CASE WHEN op <> 'c' THEN strlen(',"before":' || image) ELSE 0 END + CASE WHEN op <> 'd' THEN strlen(',"after":' || image) ELSE 0 END) AS BIGINT) AS n_bytes
FROM shown GROUP BY usn, slt, sqn, begin_scn, begin_s""",
    "begin_commit_messages": _TX + f""",
m AS (SELECT t.*, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM out_tx t JOIN (SELECT usn, slt, sqn, ts FROM redo WHERE kind = 'BEGIN') b USING (usn, slt, sqn))
SELECT usn, slt, sqn, 'begin' AS place, '{{"scn":' || begin_scn || ',"tm":' || s * 1000000000 || ',"c_scn":' || begin_scn || ',"c_idx":0,"xid":"' || {_XIDT} || '","payload":[{{"op":"begin"}}]}}' AS body FROM m
UNION ALL SELECT usn, slt, sqn, 'commit', '{{"c_scn":' || begin_scn || ',"c_idx":0,"xid":"' || {_XIDT} || '","payload":[{{"op":"commit"}}]}}' FROM m""",
    "checkpoint_messages": f"""
SELECT lwn_id, '{{"scns":"0x' || {_HX('scn', 16)} || '","tm":' || CAST(floor(epoch(ts)) AS BIGINT) * 1000000000 || ',"c_scn":' || scn || ',"c_idx":0,"payload":[{{"op":"chkpt","seq":' || seq || ',"offset":' || "offset"
  || CASE WHEN scn % 2 = 0 THEN ',"redo":true' ELSE '' END || '}}]}}' AS body FROM {_LWN}""",
    "ddl_text_assembly": "SELECT c_custkey, 'SHOP' AS schema_name, 'ALTER TABLE ' || c_name || c_mktsegment AS sql_text FROM customer WHERE c_custkey % 9 <> 4",
    "session_attributes": f"SELECT usn, slt, sqn, max_by('v' || scn, scn) FILTER (scn % 2 = 0) AS login, max_by('v' || scn, scn) FILTER (scn % 2 = 1) AS client FROM {_CH} GROUP BY usn, slt, sqn",
    "metrics_dml_ops": f"""
SELECT lower(kind) AS type, CASE WHEN name IS NULL THEN 'skip' ELSE 'out' END AS filter, owner, name, count(*) AS dml_ops
FROM {_CH} p LEFT JOIN ({_DICT}) d ON p.obj = d.obj AND scn >= valid_from AND (valid_to IS NULL OR scn < valid_to) GROUP BY 1, 2, 3, 4""",
    "metrics_transactions": _CLASSED + _TXM,
    "metrics_ddl_ops": """
SELECT CASE WHEN k IN (0, 1, 2) THEN 'create' WHEN k = 3 THEN 'truncate' WHEN k IN (4, 5) THEN 'drop' WHEN k IN (6, 7) THEN 'alter' WHEN k = 8 THEN 'purge' ELSE 'other' END AS type, count(*) AS ddl_ops
FROM (SELECT c_custkey % 10 AS k FROM customer) GROUP BY 1""",
    "metrics_prometheus": _CLASSED + f"SELECT 'transactions{{type=\"' || type || '\",filter=\"' || filter || '\"}} ' || transactions AS line FROM ({_TXM})",
    "metrics_log_switches": f"SELECT CASE WHEN seq % 4 = 3 THEN 'online' ELSE 'archived' END AS type, count(DISTINCT seq) AS log_switches, CAST(sum(size) AS BIGINT) AS bytes_read FROM ({_REDO}) GROUP BY 1",
    "metrics_lag": f"SELECT min(s) AS least, avg(s) AS mean, max(s) AS most FROM (SELECT CAST(floor(epoch(ts + to_seconds(scn % 50))) - floor(epoch(ts)) AS BIGINT) AS s FROM ({_REDO}))",
    "low_watermark": f"""
WITH redo AS (SELECT * FROM ({_REDO}) WHERE NOT ({fixtures.UNENDED}))
SELECT seq, scn AS "offset", usn, slt, sqn FROM redo WHERE kind = 'BEGIN' AND (usn, slt, sqn) NOT IN (SELECT (usn, slt, sqn) FROM redo WHERE kind IN ('COMMIT', 'ROLLBACK'))
ORDER BY seq, scn, usn, slt, sqn LIMIT 1""",
    "checkpoint_due": f"""
WITH RECURSIVE r AS (SELECT seq, scn, CAST(floor(epoch(ts)) AS BIGINT) AS t, "offset" * 40 AS b, row_number() OVER (PARTITION BY seq ORDER BY scn) AS rn FROM {_LWN}),
f AS (
  SELECT seq, rn, scn, t, b, true AS due FROM r WHERE rn = 1
  UNION ALL
  SELECT seq, rn, scn, CASE WHEN due THEN now_t ELSE t END, CASE WHEN due THEN now_b ELSE b END, due
  FROM (SELECT r.seq, r.rn, r.scn, f.t, f.b, r.t AS now_t, r.b AS now_b, r.t - f.t >= 72000 OR floor((r.b - f.b) / 1024 / 1024) >= 3 AS due FROM f JOIN r ON r.seq = f.seq AND r.rn = f.rn + 1))
SELECT seq, scn, (row_number() OVER (ORDER BY scn) - 1) % 4 = 0 AS has_schema FROM f WHERE due""",
    "lwn_positions": f"SELECT * FROM {_LWN}",
    "checkpoint_retention": f"""
WITH n AS (SELECT *, row_number() OVER (ORDER BY scn DESC) AS n FROM {_POINTS}), f AS (SELECT min(n) AS first FROM n WHERE n >= 5 AND has_schema)
SELECT scn, has_schema FROM n, f WHERE n < 5 OR first IS NULL OR n <= first""",
    "recovery_point": f"SELECT max(scn) AS scn, max(CASE WHEN has_schema THEN scn END) AS schema_scn FROM {_POINTS} WHERE scn <= 4321",
    "confirm_prefix": f"SELECT max(id) AS id FROM {_MSG} WHERE id < coalesce((SELECT min(id) FROM {_MSG} WHERE NOT confirmed), 9223372036854775807)",
    "resume_dedup": f"SELECT DISTINCT c_scn, c_idx FROM {_MSG} WHERE c_scn > 300 OR (c_scn = 300 AND c_idx > 3)",
    "log_seq_from_filename": f"SELECT seq AS want, CASE WHEN seq % 5 <> 0 THEN seq END AS seq FROM {_FILES}",
    "path_mapping": "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '/x/' || c_name WHEN c_mktsegment LIKE 'AUTO%' THEN '/z/' || substr(c_mktsegment, 5) || '/a/' || c_name WHEN c_mktsegment LIKE 'B%' THEN '/y' || substr(c_mktsegment, 2) || '/a/' || c_name ELSE '/' || c_mktsegment || '/a/' || c_name END AS path FROM customer",
    "gap_check": f"SELECT * FROM (SELECT coalesce(lag(seq) OVER (ORDER BY seq), 0) AS after, seq AS before FROM {_FILES} WHERE seq >= 1) WHERE before - after > 1",
    "usable_files": f"SELECT seq FROM (SELECT seq, row_number() OVER (ORDER BY seq) AS n FROM {_FILES} WHERE seq >= 1) WHERE seq = n",
    "incarnation_order": f"SELECT seq % 3 AS resetlogs, seq, row_number() OVER (ORDER BY seq % 3, seq) - 1 AS turn FROM {_FILES}",
    "start_position": f"""
WITH r AS ({_REDO})
SELECT 'scn' AS start, count(*) AS n, min(scn) AS first FROM r WHERE scn >= 4000 UNION ALL SELECT 'seq', count(*), min(scn) FROM r WHERE seq >= 7
UNION ALL SELECT 'time', count(*), min(scn) FROM r WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' UNION ALL SELECT 'back', count(*), min(scn) FROM r WHERE floor(epoch(ts)) >= (SELECT floor(epoch(max(ts))) FROM r) - 86400""",
    "block_validation": """
SELECT event_id AS block, CASE WHEN event_id % 23 = 1 THEN 'EMPTY' WHEN event_id % 17 = 3 THEN 'SEQUENCE' WHEN event_id % 13 = 5 THEN 'BLOCK' WHEN event_id % 19 = 7 THEN 'CRC' ELSE 'OK' END AS status FROM events""",
    "kafka_rows": f"SELECT 'changes' AS topic, length('m' || id) > 5 AS too_large, count(*) AS n, count(DISTINCT c_scn) AS n_keys FROM {_MSG} GROUP BY 1, 2",
    "sequence_union": f"SELECT 'distinct' AS kind, seq FROM {_FILES} UNION ALL SELECT 'all', seq FROM {_FILES} WHERE seq < 12 UNION ALL SELECT 'all', seq FROM {_FILES} WHERE seq >= 8",
    "change_cube": f"SELECT kind, obj, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, CAST(grouping_id(kind, obj) AS BIGINT) AS gid FROM {_CH} GROUP BY CUBE (kind, obj)",
    "change_sessions": """
WITH l AS (SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM l)
SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM s GROUP BY user_id, k""",
    "change_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2",
    "change_percentiles": f"SELECT kind, CAST(quantile_cont(size, 0.5) AS DOUBLE) AS p50, CAST(quantile_cont(size, 0.9) AS DOUBLE) AS p90, count(DISTINCT (usn, slt, sqn)) AS n_tx FROM {_CH} GROUP BY kind",
}
