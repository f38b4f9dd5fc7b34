"""A logical change log, row images and dictionary derived from the analytic tables.

Each fixture is one SQL text that Spark and any other engine can run, with ``{table}`` in the place of
its inputs, so both sides of a comparison start from the same rows.
"""

from __future__ import annotations

import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Change records of transactions: eight events of a user at a time. Three undo records of four name the record before them.
OPS = """
SELECT user_id, event_id, ts, event_id + 1 AS scn, 1 AS sub_scn, CAST(floor((event_id + 1) / 500) AS BIGINT) AS seq,
       CASE WHEN event_type = 'error' AND event_id % 4 <> 0 AND prev_id IS NOT NULL THEN prev_id % 3 ELSE event_id % 3 END AS obj, user_id % 10 + 1 AS usn, user_id % 34 AS slt,
       user_id * 1000 + CAST(floor(rn / 8) AS BIGINT) AS sqn,
       CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'view' THEN 'DELETE' WHEN 'error' THEN 'UNDO_LAST' ELSE 'UPDATE' END AS kind,
       CASE WHEN event_id % 4 = 0 THEN 'DELETE' WHEN prev_type = 'signup' THEN 'DELETE' WHEN prev_type = 'view' THEN 'INSERT' ELSE 'UPDATE' END AS undo_kind,
       100 + event_id % 77 AS size
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_id,
             lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_type FROM {events})
"""

#: The same with BEGIN (missing for some users) and COMMIT or ROLLBACK records.
REDO = f"""
WITH ops AS ({OPS}),
ends AS (
  SELECT usn, slt, sqn, user_id, min(scn) AS first_scn, max(scn) AS last_scn, min(ts) AS first_ts, max(ts) AS last_ts, max(CASE WHEN last_one = 1 AND kind = 'UNDO_LAST' THEN 1 ELSE 0 END) AS undone
  FROM (SELECT *, row_number() OVER (PARTITION BY usn, slt, sqn ORDER BY scn DESC) AS last_one FROM ops)
  GROUP BY usn, slt, sqn, user_id)
SELECT seq, scn, sub_scn, ts, usn, slt, sqn, kind, obj, undo_kind, size FROM ops
UNION ALL
SELECT CAST(floor(first_scn / 500) AS BIGINT), first_scn, 0, first_ts, usn, slt, sqn, 'BEGIN', NULL, NULL, 40 FROM ends WHERE user_id % 29 <> 0
UNION ALL
SELECT CAST(floor(last_scn / 500) AS BIGINT), last_scn, 2, last_ts, usn, slt, sqn, CASE WHEN undone = 1 THEN 'ROLLBACK' ELSE 'COMMIT' END, NULL, NULL, 40 FROM ends
"""

#: Ends that a log cut short lacks: the transactions that are open at its end.
UNENDED = "kind IN ('COMMIT', 'ROLLBACK') AND sqn % 11 = 4"

#: Versions of three tables; object 2 is never described.
DICTIONARY = """
SELECT CAST(obj AS BIGINT) AS obj, owner, name, CAST(valid_from AS BIGINT) AS valid_from, CAST(valid_to AS BIGINT) AS valid_to, columns_text
FROM (VALUES (0, 'SHOP', 'ORDERS', 0, NULL, 'ID,PRICE,PRIORITY'), (1, 'SHOP', 'CUSTOMER', 0, 400, 'ID,NAME'), (1, 'SHOP', 'CUSTOMER_V2', 400, NULL, 'ID,FULL_NAME,SEGMENT'))
     AS d(obj, owner, name, valid_from, valid_to, columns_text)
"""

#: Before and after images of orders; a null is an explicit null.
IMAGES = """
SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'DELETE' ELSE 'UPDATE' END AS op,
       CAST(o_orderkey AS {string}) AS b_id, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS {string}) AS b_price, o_orderpriority AS b_priority, o_orderstatus AS b_status,
       CAST(o_orderkey AS {string}) AS a_id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) + 1 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS {string}) AS a_price,
       CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_orderpriority END AS a_priority, o_orderstatus AS a_status
FROM {orders}
"""


def frame(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    return spark.sql(sql.replace("{string}", "STRING"), **read)


def text(sql: str) -> str:
    """The SQL for the comparison engine: inputs are views of their own names."""
    for t in ("events", "orders", "customer", "documents", "lineitem"):
        sql = sql.replace("{" + t + "}", t)
    return sql.replace("{string}", "VARCHAR")


def redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, REDO, "events")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, IMAGES, "orders")


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DICTIONARY)


#: Images of the log's changes: key, a name that may be null, and a size.
LOG_IMAGES = """
SELECT r.*, CAST(scn % 50 AS {string}) AS id, CASE WHEN scn % 3 <> 0 THEN 'n' || CAST(scn % 7 AS {string}) END AS b_name, CASE WHEN scn % 3 <> 1 THEN 'n' || CAST(scn % 5 AS {string}) END AS a_name,
       CAST(size AS {string}) AS b_size, CAST(CASE WHEN scn % 4 = 0 THEN size ELSE size + 1 END AS {string}) AS a_size
FROM (""" + REDO + ") r"


def imaged_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log with maps of before and after images."""
    rows = frame(spark, sf_dir, LOG_IMAGES, "events")
    image = lambda side: F.create_map(F.lit("ID"), F.col("id"), F.lit("NAME"), F.col(f"{side}_name"), F.lit("SIZE"), F.col(f"{side}_size"))
    return rows.withColumns({"before": image("b"), "after": image("a")}).drop("id", "b_name", "a_name", "b_size", "a_size")


def write_logs(redo: DataFrame, folder: str) -> None:
    """A Parquet file for each log sequence, named ``log_1_<sequence>_7.parquet``; a task writes one file at a time, batch by batch."""
    schema = redo.schema

    def run(batches):
        fs, top = pafs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        out, now = None, None
        for batch in batches:
            at = batch.schema.names.index("seq")
            for seq in pc.unique(batch.column(at)).to_pylist():
                if seq != now:
                    if out is not None:
                        out.close()
                    out, now = pq.ParquetWriter(f"{top}/log_1_{seq}_7.parquet", batch.schema, filesystem=fs), seq
                out.write_batch(batch.filter(pc.equal(batch.column(at), seq)))
            yield batch.slice(0, 0)
        if out is not None:
            out.close()

    redo.repartition("seq").sortWithinPartitions("seq").mapInArrow(run, schema).write.format("noop").mode("overwrite").save()
