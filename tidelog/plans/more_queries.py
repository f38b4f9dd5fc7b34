"""Typed messages, column visibility, containers and stop rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import dictionary, typed
from tidelog.operators import transactions as tx
from tidelog.plans import fixtures

_IMAGES = fixtures.text(fixtures.IMAGES)
_REDO = fixtures.text(fixtures.REDO)


def typed_messages(spark, sf_dir):
    df = fixtures.images(spark, sf_dir)
    m = lambda p: F.create_map(*(x for n in ("id", "price", "priority") for x in (F.lit(n), F.col(f"{p}_{n}"))))
    letter = F.when(F.col("op") == "INSERT", "c").when(F.col("op") == "DELETE", "d").otherwise("u")
    rows = df.select(F.col("id").alias("scn"), F.col("id").alias("c_scn"), F.lit(0).alias("c_idx"), F.lit(1).alias("usn"), F.lit(2).alias("slt"), F.col("id").alias("sqn"), letter.alias("op"), F.lit("SHOP").alias("owner"), F.lit("ORDERS").alias("name"), F.lit(7).alias("obj"), m("b").alias("before"), m("a").alias("after"))
    t = typed.messages(rows, {"id": "number", "price": "number", "priority": "varchar2"})
    pick = lambda side, k, kind: F.col(side)[k]["value"][kind]
    return t.select("scn", "xidn", F.col("op").cast("int"), F.col("schema.name").alias("name"), pick("after", 0, "int").alias("id"), pick("after", 1, "int").alias("price"), pick("after", 2, "string").alias("priority"), pick("before", 1, "int").alias("old_price"))


def visible_columns(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("col"), (F.col("c_custkey") % 3 == 0).alias("is_hidden"), (F.col("c_custkey") % 5 == 0).alias("is_guard"), (F.col("c_custkey") % 7 == 0).alias("is_nested"), (F.col("c_custkey") % 11 == 0).alias("is_unused")
    )
    return dictionary.visible_columns(c, show_guard=True).select("col")


def container_filter(spark, sf_dir):
    redo = fixtures.redo(spark, sf_dir).withColumn("con_id", F.col("usn") % 3)
    return tx.in_container(redo, 1).groupBy("con_id", "kind").agg(F.count("*").alias("n"))


def stop_after_log_switches(spark, sf_dir):
    """Records of the first five log files."""
    redo = fixtures.redo(spark, sf_dir)
    first = redo.select("seq").distinct().orderBy("seq").limit(5)
    return redo.join(F.broadcast(first), "seq", "left_semi").groupBy("seq").agg(F.count("*").alias("n"))


def open_at_end(spark, sf_dir):
    """Transactions still open at the end of a log that lacks the ends of some."""
    redo = fixtures.redo(spark, sf_dir).where(f"NOT ({fixtures.UNENDED})")
    return tx.classes(tx.transactions(redo)).where("fate = 'open'").select(*tx.XID, "n_changes", "bytes")


QUERIES = {f.__name__: f for f in (typed_messages, visible_columns, container_filter, stop_after_log_switches, open_at_end)}
ORACLE = {
    "typed_messages": f"""
SELECT id AS scn, 281474976710656 + 2 * 4294967296 + id AS xidn, CASE op WHEN 'INSERT' THEN 2 WHEN 'UPDATE' THEN 3 ELSE 4 END AS op, 'ORDERS' AS name,
       CASE WHEN op <> 'DELETE' THEN a_id::BIGINT END AS id, CASE WHEN op <> 'DELETE' THEN a_price::BIGINT END AS price, CASE WHEN op <> 'DELETE' THEN a_priority END AS priority, CASE WHEN op <> 'INSERT' THEN b_price::BIGINT END AS old_price
FROM ({_IMAGES})""",
    "visible_columns": "SELECT c_custkey AS col FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0",
    "container_filter": f"SELECT usn % 3 AS con_id, kind, count(*) AS n FROM ({_REDO}) WHERE usn % 3 = 1 GROUP BY 1, 2",
    "stop_after_log_switches": f"SELECT seq, count(*) AS n FROM ({_REDO}) WHERE seq < 5 GROUP BY seq",
    "open_at_end": f"""
SELECT usn, slt, sqn, count(CASE WHEN kind IN ('INSERT', 'UPDATE', 'DELETE') THEN 1 END) AS n_changes, CAST(sum(size) AS BIGINT) AS bytes
FROM ({_REDO}) WHERE NOT ({fixtures.UNENDED}) GROUP BY usn, slt, sqn HAVING count(CASE WHEN kind IN ('COMMIT', 'ROLLBACK') THEN 1 END) = 0""",
}
