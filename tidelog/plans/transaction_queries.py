"""Queries over transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import transactions as tx
from tidelog.plans import fixtures

_REDO = fixtures.text(fixtures.REDO)
_TX = f"""
WITH RECURSIVE redo AS ({_REDO}),
tx AS (
  SELECT usn, slt, sqn, min(CASE WHEN kind = 'BEGIN' THEN scn END) AS begin_scn, max(CASE WHEN kind IN ('COMMIT', 'ROLLBACK') THEN scn END) AS end_scn,
         max(CASE WHEN kind = 'COMMIT' THEN scn END) AS commit_scn, max(CASE WHEN kind IN ('COMMIT', 'ROLLBACK') THEN kind END) AS outcome,
         count(CASE WHEN kind IN ('INSERT', 'UPDATE', 'DELETE') THEN 1 END) AS n_changes, count(CASE WHEN kind = 'UNDO_LAST' THEN 1 END) AS n_undo,
         CAST(sum(size) AS BIGINT) AS bytes
  FROM redo GROUP BY usn, slt, sqn),
s AS (SELECT *, row_number() OVER (PARTITION BY usn, slt, sqn ORDER BY scn, sub_scn) AS rn FROM redo WHERE kind NOT IN ('BEGIN', 'COMMIT', 'ROLLBACK')),
f AS (
  SELECT DISTINCT usn, slt, sqn, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(rn BIGINT, kind VARCHAR, obj BIGINT)[]) AS stack, CAST(0 AS BIGINT) AS missed FROM s
  UNION ALL
  SELECT usn, slt, sqn, rn, CASE WHEN kind <> 'UNDO_LAST' THEN list_append(stack, {{'rn': rn, 'kind': kind, 'obj': obj}}) WHEN fits THEN stack[:len(stack) - 1] ELSE stack END,
         missed + CASE WHEN kind = 'UNDO_LAST' AND NOT fits THEN 1 ELSE 0 END
  FROM (SELECT s.usn, s.slt, s.sqn, s.rn, s.kind, s.obj, f.stack, f.missed,
               coalesce(len(f.stack) > 0 AND f.stack[-1].obj = s.obj AND s.undo_kind = CASE f.stack[-1].kind WHEN 'INSERT' THEN 'DELETE' WHEN 'DELETE' THEN 'INSERT' ELSE 'UPDATE' END, false) AS fits
        FROM f JOIN s ON s.usn = f.usn AND s.slt = f.slt AND s.sqn = f.sqn AND s.rn = f.rn + 1)),
ends AS (SELECT usn, slt, sqn, max(rn) AS rn FROM s GROUP BY usn, slt, sqn),
kept AS (SELECT usn, slt, sqn, missed, unnest(stack).rn AS rn FROM f JOIN ends USING (usn, slt, sqn, rn)),
live AS (SELECT s.*, kept.missed AS n_mismatch FROM s JOIN kept USING (usn, slt, sqn, rn)),
out_tx AS (SELECT * FROM tx WHERE outcome = 'COMMIT' AND begin_scn IS NOT NULL)
"""


def tx_committed_order(spark, sf_dir):
    placed = tx.committed_changes(fixtures.redo(spark, sf_dir))
    kinds = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k.lower()}") for k in tx.CHANGES]
    return placed.groupBy(*tx.XID, "begin_scn", "commit_scn").agg(*kinds, F.count("*").alias("n_messages")).orderBy("commit_scn", *tx.XID)


def tx_outcome_counts(spark, sf_dir):
    return tx.classes(tx.transactions(fixtures.redo(spark, sf_dir)), after_scn=200).groupBy("fate").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def partial_rollback_survivors(spark, sf_dir):
    return tx.survivors(fixtures.redo(spark, sf_dir)).select(*tx.XID, "scn", "kind", "obj")


def partial_rollback_checked(spark, sf_dir):
    return tx.survivors(fixtures.redo(spark, sf_dir)).select(*tx.XID, "scn", "sub_scn", "kind", "obj", "n_mismatch")


def message_num(spark, sf_dir):
    redo = fixtures.redo(spark, sf_dir)
    return tx.commit_order(tx.survivors(redo), tx.transactions(redo)).select(*tx.XID, "scn", "commit_scn", F.col("num").cast("long"))


def skip_xid_anti(spark, sf_dir):
    redo = fixtures.redo(spark, sf_dir)
    ids = tx.transactions(redo).where("sqn % 7 = 3")
    return tx.skip(redo, ids).groupBy("kind").agg(F.count("*").alias("n"))


def dump_xid_semi(spark, sf_dir):
    redo = fixtures.redo(spark, sf_dir)
    return tx.only(redo, tx.transactions(redo).where("sqn % 7 = 3")).select(*tx.XID, "scn", "sub_scn", "kind")


def tx_size_limit(spark, sf_dir):
    kept, large = tx.within_limit(fixtures.redo(spark, sf_dir), 1100)
    return kept.groupBy(*tx.XID).agg(F.sum("size").alias("bytes"), F.lit("kept").alias("fate")).unionByName(large.withColumn("fate", F.lit("skipped")))


def tx_split_by_size(spark, sf_dir):
    redo = fixtures.redo(spark, sf_dir).where(F.col("kind").isin(*tx.CHANGES))
    return tx.split(redo, 300).groupBy(*tx.XID, "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("scn").alias("first_scn"))


def position_numbering(spark, sf_dir):
    redo = fixtures.redo(spark, sf_dir)
    messages = redo.select("seq", (F.col("scn") * 4 + F.col("sub_scn")).alias("id"), F.floor(F.col("scn") / 3).alias("c_scn"), *tx.XID)
    messages = messages.groupBy("seq", "id").agg(F.min("c_scn").alias("c_scn"))
    return tx.positions(messages).select("seq", "id", "c_scn", "c_idx")


def stop_after_transactions(spark, sf_dir):
    return tx.first_n(tx.transactions(fixtures.redo(spark, sf_dir)), 25).select(*tx.XID, "commit_scn")


def undo_redo_pairs(spark, sf_dir):
    redo = fixtures.redo(spark, sf_dir).where(F.col("kind").isin(*tx.CHANGES))
    undo = redo.select("seq", "scn", F.lit(0).alias("sub_scn"), "ts", *tx.XID, F.lit("UNDO").alias("kind"), "obj", "undo_kind", "size")
    return tx.pair_vectors(redo.unionByName(undo)).select(*tx.XID, "scn", "redo_kind", "redo_obj")


def rollback_prefix_match(spark, sf_dir):
    all_tx = tx.transactions(fixtures.redo(spark, sf_dir))
    ends = all_tx.where("outcome = 'ROLLBACK'").select("usn", "slt", F.lit(0).cast("long").alias("sqn"), F.col("end_scn").alias("scn"))
    return tx.match_prefix(ends, all_tx)


def lob_child_to_parent(spark, sf_dir):
    redo = fixtures.redo(spark, sf_dir)
    ids = redo.select(*tx.XID).distinct()
    children = ids.where("sqn % 1000 = 1").select(*tx.XID, (F.col("sqn") - 1).alias("parent_sqn"))
    return tx.to_parent(redo, children).groupBy(*tx.XID).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        tx_committed_order, tx_outcome_counts, partial_rollback_survivors, partial_rollback_checked, message_num, skip_xid_anti, dump_xid_semi,
        tx_size_limit, tx_split_by_size, position_numbering, stop_after_transactions, undo_redo_pairs, rollback_prefix_match, lob_child_to_parent,
    )
}

ORACLE = {
    "tx_committed_order": _TX + """
SELECT usn, slt, sqn, begin_scn, commit_scn, count(CASE WHEN kind = 'INSERT' THEN 1 END) AS n_insert, count(CASE WHEN kind = 'UPDATE' THEN 1 END) AS n_update,
       count(CASE WHEN kind = 'DELETE' THEN 1 END) AS n_delete, count(*) AS n_messages
FROM live JOIN out_tx USING (usn, slt, sqn) GROUP BY ALL""",
    "tx_outcome_counts": _TX + """
SELECT CASE WHEN outcome IS NULL THEN 'open' WHEN outcome = 'ROLLBACK' THEN 'rollback' WHEN begin_scn IS NULL THEN 'partial' WHEN commit_scn <= 200 THEN 'skip' ELSE 'out' END AS fate,
       count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM tx GROUP BY 1""",
    "partial_rollback_checked": _TX + "SELECT usn, slt, sqn, scn, sub_scn, kind, obj, n_mismatch FROM live",
    "partial_rollback_survivors": _TX + "SELECT usn, slt, sqn, scn, kind, obj FROM live",
    "message_num": _TX + """
SELECT usn, slt, sqn, scn, commit_scn, row_number() OVER (PARTITION BY usn, slt, sqn ORDER BY scn, sub_scn) - 1 AS num FROM live JOIN out_tx USING (usn, slt, sqn)""",
    "skip_xid_anti": _TX + "SELECT kind, count(*) AS n FROM redo WHERE sqn % 7 <> 3 GROUP BY kind",
    "dump_xid_semi": _TX + "SELECT usn, slt, sqn, scn, sub_scn, kind FROM redo WHERE sqn % 7 = 3",
    "tx_size_limit": _TX + "SELECT usn, slt, sqn, bytes, CASE WHEN bytes >= 1100 THEN 'skipped' ELSE 'kept' END AS fate FROM tx",
    "tx_split_by_size": _TX + """,
c AS (SELECT *, row_number() OVER (PARTITION BY usn, slt, sqn ORDER BY scn, sub_scn) AS rn FROM redo WHERE kind IN ('INSERT', 'UPDATE', 'DELETE')),
g AS (
  SELECT usn, slt, sqn, rn, size, scn, CAST(size AS BIGINT) AS held, CAST(0 AS BIGINT) AS part FROM c WHERE rn = 1
  UNION ALL
  SELECT c.usn, c.slt, c.sqn, c.rn, c.size, c.scn, CASE WHEN g.held + c.size > 300 THEN c.size ELSE g.held + c.size END, CASE WHEN g.held + c.size > 300 THEN g.part + 1 ELSE g.part END
  FROM g JOIN c ON c.usn = g.usn AND c.slt = g.slt AND c.sqn = g.sqn AND c.rn = g.rn + 1)
SELECT usn, slt, sqn, part, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, min(scn) AS first_scn FROM g GROUP BY usn, slt, sqn, part""",
    "position_numbering": _TX + """,
m AS (SELECT seq, scn * 4 + sub_scn AS id, min(CAST(floor(scn / 3) AS BIGINT)) AS c_scn FROM redo GROUP BY 1, 2),
n AS (SELECT *, CASE WHEN lag(c_scn) OVER (ORDER BY id) = c_scn THEN 0 ELSE 1 END AS fresh FROM m),
r AS (SELECT *, sum(fresh) OVER (ORDER BY id) AS run FROM n)
SELECT seq, id, c_scn, row_number() OVER (PARTITION BY run ORDER BY id) - 1 AS c_idx FROM r""",
    "stop_after_transactions": _TX + "SELECT usn, slt, sqn, commit_scn FROM out_tx ORDER BY commit_scn, usn, slt, sqn LIMIT 25",
    "undo_redo_pairs": _TX + "SELECT usn, slt, sqn, scn, kind AS redo_kind, obj AS redo_obj FROM redo WHERE kind IN ('INSERT', 'UPDATE', 'DELETE')",
    "rollback_prefix_match": _TX + """
SELECT e.usn, e.slt, e.end_scn AS scn, arg_max(t.sqn, t.begin_scn * 100000000 + t.sqn) AS sqn
FROM (SELECT DISTINCT usn, slt, end_scn FROM tx WHERE outcome = 'ROLLBACK') e
LEFT JOIN tx t ON t.usn = e.usn AND t.slt = e.slt AND t.begin_scn <= e.end_scn AND coalesce(t.end_scn, e.end_scn) >= e.end_scn GROUP BY 1, 2, 3""",
    "lob_child_to_parent": _TX + "SELECT usn, slt, CASE WHEN sqn % 1000 = 1 THEN sqn - 1 ELSE sqn END AS sqn, count(*) AS n FROM redo GROUP BY 1, 2, 3",
}
