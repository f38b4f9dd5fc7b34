"""Runs from a configuration text to the lines of a file."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidelog.operators import transactions as tx
from tidelog.operators.messages import FormatOptions
from tidelog.plans import config, fixtures, replay, run, scratch
from tidelog.plans.transaction_queries import _TX
from tidelog.sources import sinks

#: Tables of the run: one with a key, one without, and one of the system.
TABLES = """
SELECT CAST(obj AS BIGINT) AS obj, owner, name, CAST(0 AS BIGINT) AS valid_from, CAST(NULL AS BIGINT) AS valid_to, 'ID,NAME,SIZE' AS columns_text, key_text, is_system,
       array(named_struct('name', 'ID', 'type', 2, 'length', 22, 'precision', 10, 'scale', 0, 'nullable', false), named_struct('name', 'NAME', 'type', 1, 'length', 30, 'precision', -1, 'scale', -1, 'nullable', true),
             named_struct('name', 'SIZE', 'type', 2, 'length', 22, 'precision', -1, 'scale', 0, 'nullable', true)) AS types
FROM (VALUES (0, 'SHOP', 'ORDERS', 'ID', false), (1, 'SHOP', 'CUSTOMER', '', false), (2, 'SYS', 'INNER', 'ID', true)) AS d(obj, owner, name, key_text, is_system)
"""


def configuration(folder: str, output: str, **over) -> str:
    """A configuration that replays the log files of a folder into one file."""
    source = {
        "alias": "S1", "name": "DB1", "flags": config.FLAGS["show_ddl"], "reader": {"type": "batch", "redo-log": [folder], "log-archive-format": "log_%t_%s_%r.parquet"},
        "format": {"type": "json", "message": 2, "schema": 5}, "filter": {"table": [{"owner": "SHOP", "table": ".*"}, {"owner": "SYS", "table": ".*"}]},
    }
    writer = {"type": "file", "output": output, "new-line": 1}
    return json.dumps({"version": config.VERSION, "source": [source | over], "target": [{"alias": "T1", "source": "S1", "writer": writer}]})


def _statements(redo):
    """A DDL statement behind some of the updates."""
    some = redo.where("kind = 'UPDATE' AND scn % 97 = 5")
    return some.select(*tx.XID, *tx.ORDER, "ts", "obj", F.lit("SHOP").alias("owner"), F.lit("ORDERS").alias("name"), F.concat(F.lit('ALTER TABLE "ORDERS" ADD C'), F.col("scn").cast("string")).alias("sql_text"))


def run_to_file(spark, sf_dir):
    """Configuration, log files, dictionary, replay and file sink; the lines of the file by number."""
    redo = fixtures.imaged_log(spark, sf_dir)
    base = scratch.path(spark, "run")
    fixtures.write_logs(redo, f"{base}/logs")
    done = run.run(spark, configuration(f"{base}/logs", f"{base}/out/changes.json"), redo.schema, spark.sql(TABLES), _statements(redo))
    files = [f"file://{r.file}" if "://" not in r.file else r.file for r in done.files.collect()]
    return sinks.numbered_lines(spark, files).where("line <> ''").select("n", "line")


def replay_order(spark, sf_dir):
    """Messages as they are sent, with their place in global order and their positions."""
    redo = fixtures.imaged_log(spark, sf_dir)
    out = replay.whole(redo, spark.sql(TABLES), FormatOptions(), rules=[{"owner": "SHOP", "table": "ORDERS"}])
    return out.select("commit_scn", *tx.XID, "place", F.col("num").cast("long"), "c_scn", F.col("c_idx").cast("long"))


QUERIES = {f.__name__: f for f in (run_to_file, replay_order)}

_XID = "'0x' || lpad(lower(to_hex(usn)), 4, '0') || '.' || lpad(lower(to_hex(slt)), 3, '0') || '.' || lpad(lower(to_hex(sqn)), 8, '0')"
_LOG = fixtures.text(fixtures.LOG_IMAGES)
_BASE = _TX + f""",
images AS (SELECT usn, slt, sqn, scn, sub_scn, id, b_name, a_name, b_size, a_size FROM ({_LOG})),
times AS (SELECT usn, slt, sqn, CAST(floor(epoch(max(CASE WHEN kind = 'BEGIN' THEN ts END))) AS BIGINT) AS begin_s FROM redo GROUP BY usn, slt, sqn),
"""
ORACLE = {
    "replay_order": _BASE + """
c AS (SELECT usn, slt, sqn, commit_scn, begin_scn, scn, row_number() OVER (PARTITION BY usn, slt, sqn ORDER BY scn, sub_scn) - 1 AS num FROM live JOIN out_tx USING (usn, slt, sqn) WHERE obj = 0),
n AS (SELECT usn, slt, sqn, commit_scn, begin_scn, count(*) AS n FROM c GROUP BY ALL),
runs AS (SELECT *, sum(fresh) OVER (ORDER BY commit_scn, usn, slt, sqn) AS run FROM (SELECT *, CASE WHEN lag(begin_scn) OVER (ORDER BY commit_scn, usn, slt, sqn) = begin_scn THEN 0 ELSE 1 END AS fresh FROM n)),
firsts AS (SELECT *, coalesce(sum(n + 2) OVER (PARTITION BY run ORDER BY commit_scn, usn, slt, sqn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_idx FROM runs)
SELECT commit_scn, usn, slt, sqn, 'change' AS place, num, begin_scn AS c_scn, CAST(first_idx + num + 1 AS BIGINT) AS c_idx FROM c JOIN firsts USING (usn, slt, sqn, commit_scn, begin_scn)
UNION ALL SELECT commit_scn, usn, slt, sqn, 'begin', -1, begin_scn, CAST(first_idx AS BIGINT) FROM firsts
UNION ALL SELECT commit_scn, usn, slt, sqn, 'commit', -1, begin_scn, CAST(first_idx + n + 1 AS BIGINT) FROM firsts""",
    "run_to_file": _BASE + f"""
c AS (SELECT l.usn, l.slt, l.sqn, commit_scn, begin_scn, l.scn, l.sub_scn, l.obj, false AS is_ddl, CASE kind WHEN 'INSERT' THEN 'c' WHEN 'DELETE' THEN 'd' ELSE 'u' END AS op, id, b_name, a_name, b_size, a_size
  FROM live l JOIN out_tx USING (usn, slt, sqn) JOIN images i ON i.usn = l.usn AND i.slt = l.slt AND i.sqn = l.sqn AND i.scn = l.scn AND i.sub_scn = l.sub_scn WHERE l.obj IN (0, 1)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY commit_scn, usn, slt, sqn, scn, sub_scn) = 1 AS first_of_obj FROM c),
b AS (SELECT *, op <> 'u' AS alone, obj = 0 AS keyed FROM firsts),
j AS (
  SELECT *, '{{' || array_to_string(list_filter([CASE WHEN alone OR keyed THEN '"ID":"' || id || '"' END,
      CASE WHEN alone THEN '"NAME":"' || b_name || '"' WHEN b_name IS DISTINCT FROM a_name THEN '"NAME":' || coalesce('"' || b_name || '"', 'null') END,
      CASE WHEN alone OR b_size <> a_size THEN '"SIZE":"' || b_size || '"' END], lambda x: x IS NOT NULL), ',') || '}}' AS before,
    '{{' || array_to_string(list_filter([CASE WHEN alone OR keyed THEN '"ID":"' || id || '"' END,
      CASE WHEN alone THEN '"NAME":"' || a_name || '"' WHEN b_name IS DISTINCT FROM a_name THEN '"NAME":' || coalesce('"' || a_name || '"', 'null') END,
      CASE WHEN alone OR b_size <> a_size THEN '"SIZE":"' || a_size || '"' END], lambda x: x IS NOT NULL), ',') || '}}' AS after FROM b),
d AS (SELECT r.usn, r.slt, r.sqn, commit_scn, begin_scn, r.scn, r.sub_scn, r.obj, 'ALTER TABLE \\"ORDERS\\" ADD C' || r.scn AS sql_text
  FROM redo r JOIN out_tx USING (usn, slt, sqn) WHERE r.kind = 'UPDATE' AND r.scn % 97 = 5),
u AS (
  SELECT usn, slt, sqn, commit_scn, begin_scn, scn, sub_scn, is_ddl, '{{"op":"' || op || '","schema":{{"owner":"SHOP","table":"' || CASE obj WHEN 0 THEN 'ORDERS' ELSE 'CUSTOMER' END || '","obj":' || obj
    || CASE WHEN first_of_obj THEN ',"columns":[{{"name":"ID","type":"number","precision":10,"scale":0,"nullable":false}},{{"name":"NAME","type":"varchar2","length":30,"nullable":true}},{{"name":"SIZE","type":"number","precision":-1,"scale":0,"nullable":true}}]' ELSE '' END
    || '}},"num":@' || CASE WHEN op <> 'c' THEN ',"before":' || before ELSE '' END || CASE WHEN op <> 'd' THEN ',"after":' || after ELSE '' END || '}}' AS payload FROM j
  UNION ALL SELECT usn, slt, sqn, commit_scn, begin_scn, scn, sub_scn, true, '{{"op":"ddl","schema":{{"owner":"SHOP","table":"ORDERS","obj":' || obj || '}},"sql":"' || sql_text || '"}}' FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY usn, slt, sqn ORDER BY scn, sub_scn, is_ddl) - 1 AS num FROM u),
n AS (SELECT usn, slt, sqn, commit_scn, begin_scn, count(*) AS n FROM k GROUP BY ALL),
m AS (
  SELECT commit_scn, usn, slt, sqn, 1 AS place, num, '{{"c_scn":' || begin_scn || ',"c_idx":' || num + 1 || ',"xid":"' || {_XID} || '","payload":[' || replace(payload, '@', num::VARCHAR) || ']}}' AS line FROM k
  UNION ALL SELECT commit_scn, usn, slt, sqn, 0, -1, '{{"scn":' || begin_scn || ',"tm":' || begin_s * 1000000000 || ',"c_scn":' || begin_scn || ',"c_idx":0,"xid":"' || {_XID} || '","payload":[{{"op":"begin"}}]}}' FROM n JOIN times USING (usn, slt, sqn)
  UNION ALL SELECT commit_scn, usn, slt, sqn, 2, -1, '{{"c_scn":' || begin_scn || ',"c_idx":' || n + 1 || ',"xid":"' || {_XID} || '","payload":[{{"op":"commit"}}]}}' FROM n)
SELECT row_number() OVER (ORDER BY commit_scn, usn, slt, sqn, place, num) - 1 AS n, line FROM m""",
}
