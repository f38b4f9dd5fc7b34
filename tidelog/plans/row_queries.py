"""Queries over row changes, images, conditions and the dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import condition, dictionary, diff, rows
from tidelog.operators import transactions as tx
from tidelog.plans import fixtures

_REDO = fixtures.text(fixtures.REDO)
_IMAGES = fixtures.text(fixtures.IMAGES)
_DICT = fixtures.text(fixtures.DICTIONARY)
_CHANGES = f"SELECT * FROM ({_REDO}) WHERE kind IN ('INSERT', 'UPDATE', 'DELETE')"
COLUMNS = ["id", "price", "priority", "status"]


def _pieces(spark, sf_dir):
    return fixtures.redo(spark, sf_dir).where(F.col("kind").isin(*tx.CHANGES)).withColumn("fb_last", F.col("scn") % 3 != 1)


def row_piece_islands(spark, sf_dir):
    return rows.islands(_pieces(spark, sf_dir)).select(*tx.XID, "scn", "row_no")


def dml_classify(spark, sf_dir):
    return rows.assemble(_pieces(spark, sf_dir))


def multi_row_explode(spark, sf_dir):
    vectors = _pieces(spark, sf_dir).withColumn("rows", F.transform(F.sequence(F.lit(1), (F.col("scn") % 4 + 1).cast("int")), lambda k: F.col("scn") * 10 + k))
    return rows.explode_rows(vectors).select(*tx.XID, "scn", F.col("slot_no").cast("long"), "row")


def split_column_merge(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    parts = c.select("c_custkey", F.posexplode(F.array(*(F.substring("c_name", 1 + 7 * k, 7) for k in range(3)))).alias("part", "value"))
    return rows.merge_parts(parts, ["c_custkey"])


def undo_block_merge(spark, sf_dir):
    place = F.when(F.col("scn") % 5 == 0, "HEAD").when(F.col("scn") % 5 == 1, "SINGLE").when(F.col("scn") % 5 == 4, "TAIL").otherwise("MID")
    return rows.merge_blocks(_pieces(spark, sf_dir).withColumn("place", place))


def _map(prefix: str, names=COLUMNS):
    return F.create_map(*(x for n in names for x in (F.lit(n), F.col(f"{prefix}_{n}"))))


def _with_images(spark, sf_dir):
    """Status is logged in the before-image of one order in six only, priority missing where the key is even."""
    df = fixtures.images(spark, sf_dir)
    before = F.map_filter(_map("b"), lambda k, v: (k != "status") | (F.col("id") % 6 == 0))
    return df.withColumn("before", before).withColumn("after", F.map_filter(_map("a"), lambda k, v: (k != "priority") | (F.col("id") % 2 == 1)))


def _update(spark, sf_dir, mode):
    df = _with_images(spark, sf_dir).where("op = 'UPDATE'")
    b, a = diff.update_images(F.col("before"), F.col("after"), ["id"], mode)
    return df.select("id", diff.text_of(b), diff.text_of(a)).toDF("id", "before", "after")


def update_changed_columns(spark, sf_dir):
    return _update(spark, sf_dir, 0)


def update_all_logged(spark, sf_dir):
    return _update(spark, sf_dir, 2)


def insert_nonnull_projection(spark, sf_dir):
    df = _with_images(spark, sf_dir).where("op = 'INSERT'")
    return df.select("id", *(diff.text_of(diff.one_image(F.col("after"), ["id"], COLUMNS, m)) for m in (0, 1))).toDF("id", "after", "full")


def delete_before_image(spark, sf_dir):
    df = _with_images(spark, sf_dir).where("op = 'DELETE'")
    return df.select("id", diff.text_of(diff.one_image(F.col("before"), ["id"], COLUMNS, 0))).toDF("id", "before")


def supplemental_fallback(spark, sf_dir):
    df = _with_images(spark, sf_dir)
    supp = F.map_filter(_map("b"), lambda k, v: F.array_contains(F.array(F.lit("status"), F.lit("priority")), k))
    return df.select("id", diff.text_of(diff.with_supplemental(F.col("after"), supp)).alias("image"))


def not_null_repair(spark, sf_dir):
    df = fixtures.images(spark, sf_dir)
    return df.select("id", diff.text_of(diff.repair_not_null(_map("a"), _map("b"), ["priority"])).alias("image"))


def guard_null_bitmap(spark, sf_dir):
    df = _with_images(spark, sf_dir)
    return df.select("id", diff.text_of(diff.null_guard(F.col("after"), COLUMNS, F.lit(0b0100).cast("long"))).alias("image"))


def tag_key(spark, sf_dir):
    return _with_images(spark, sf_dir).select("id", diff.tag(F.col("after"), ["id", "price"]).alias("pk"), diff.tag(F.col("after"), COLUMNS).alias("all_columns"))


def json_images(spark, sf_dir):
    """Absent keys are left out of the JSON, nulls are kept."""
    df = _with_images(spark, sf_dir).where("op = 'UPDATE'")
    _, a = diff.update_images(F.col("before"), F.col("after"), ["id"], 0)
    return df.select("id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(a)))).alias("after"))


CONDITIONS = {
    "plain": "[op] == 'd'",
    "both": "!([op] == 'd' && [login username] == 'Customer#000000003')",
    "left": "[op] == 'u' || [op] == 'c' && [client id] == 'BUILDING'",
    "missing": "[client info] == '' && [true]",
    "negated": "! [op] == 'u'",
}


def condition_op_user(spark, sf_dir):
    df = fixtures.images(spark, sf_dir)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey"), "c_name", "c_mktsegment")
    joined = df.join(c, F.col("id") % 1500 == F.col("c_custkey"), "left")
    letter = F.when(F.col("op") == "INSERT", "c").when(F.col("op") == "DELETE", "d").otherwise("u")
    attrs = F.create_map(F.lit("login username"), F.col("c_name"), F.lit("client id"), F.col("c_mktsegment"))
    rows_ = joined.withColumn("letter", letter).withColumn("attrs", attrs)
    return rows_.select("id", *(condition.compile_condition(t, F.col("letter"), F.col("attrs")).alias(n) for n, t in CONDITIONS.items()))


def dict_asof_resolve(spark, sf_dir):
    return dictionary.as_of(_pieces(spark, sf_dir).select(*tx.XID, "scn", "obj"), fixtures.dictionary(spark, sf_dir))


def dict_asof_sorted(spark, sf_dir):
    return dictionary.as_of_sorted(_pieces(spark, sf_dir).select(*tx.XID, "scn", "obj"), fixtures.dictionary(spark, sf_dir))


def schemaless_names(spark, sf_dir):
    got = dictionary.schemaless(dictionary.as_of(_pieces(spark, sf_dir).select("scn", "obj"), fixtures.dictionary(spark, sf_dir)))
    return got.groupBy("owner", "name").agg(F.count("*").alias("n"))


def dict_versions(spark, sf_dir):
    changes = fixtures.redo(spark, sf_dir).where("kind = 'DELETE' OR kind = 'INSERT'").select("obj", (F.col("usn") * 100 + F.col("slt")).alias("col"), "scn", "kind")
    changes = changes.withColumn("commit_scn", F.col("scn"))
    return dictionary.versions(changes, ["obj", "col"], gone=F.col("kind") == "DELETE").select("obj", "col", "valid_from", "valid_to")


RULES = [{"owner": "Customer#.*1", "table": "BUILDING|MACHINERY"}, {"owner": "Customer#.*[0-4]", "table": ".*E.*"}, {"owner": ".*", "table": "AUTO.*"}]


def _tables(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("obj"), F.col("c_name").alias("owner"), F.col("c_mktsegment").alias("name"))


def filter_owner_table_regex(spark, sf_dir):
    return dictionary.apply_rules(_tables(spark, sf_dir), RULES[:1]).select("obj")


def filter_first_rule_wins(spark, sf_dir):
    return dictionary.apply_rules(_tables(spark, sf_dir), RULES).select("obj", "rule_no")


def table_exclusions(spark, sf_dir):
    k = F.col("obj")
    t = _tables(spark, sf_dir).select(
        "obj", F.when(k % 7 == 6, 4).otherwise(2).alias("type"), F.when(k % 5 == 1, 128).when(k % 5 == 2, 2).otherwise(0).cast("long").alias("obj_flags"),
        F.when(k % 11 == 3, 1).when(k % 11 == 4, 64).when(k % 11 == 5, 8192).when(k % 11 == 7, 32).when(k % 11 == 9, None).otherwise(0).cast("long").alias("property"),
        F.lit(0).cast("long").alias("tab_flags"), (k % 3 == 0).alias("compressed"),
    )
    return dictionary.exclusions(t).select("obj", "excluded")


def dict_schema_diff(spark, sf_dir):
    left = _tables(spark, sf_dir).where("obj % 10 <> 3")
    right = _tables(spark, sf_dir).where("obj % 10 <> 4").withColumn("name", F.when(F.col("obj") % 10 == 5, "CHANGED").otherwise(F.col("name")))
    return dictionary.difference(left, right, ["obj"])


def orphan_prune(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 3 = 0")
    return dictionary.without_orphans(li, o, ["o_orderkey"]).groupBy("o_orderkey").agg(F.count("*").alias("n"))


def table_column_maps(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    cols = tables.select("obj", F.posexplode(F.array(*map(F.lit, ["ID", "NAME", "KIND", "NOTE"]))).alias("p", "name")).select("obj", (F.col("p") + 1).alias("col"), (F.col("p") + 1).alias("int_col"), "name").where("(obj + col) % 5 <> 0")
    cons = tables.select("obj", F.lit("P").alias("type"), F.explode(F.array(F.lit(1), F.lit(3))).alias("int_col"))
    maps = dictionary.tag_columns(dictionary.override_key(dictionary.table_maps(tables, cols, cons), None), "[pk]")
    over = dictionary.override_key(maps.drop("missing"), ["NAME", "KIND"])
    text = lambda c: F.array_join(c, ",")
    return maps.select("obj", text("cols").alias("cols"), text("tag").alias("tag")).join(over.select("obj", text("key").alias("key"), text("missing").alias("missing")), "obj")


def partition_lookup(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    parts = tables.where("obj % 4 = 0").select((F.col("obj") + 1_000_000).alias("obj"), F.col("obj").alias("base_obj"))
    return dictionary.with_partitions(tables, parts).select("part_obj", "obj", "owner")


def lob_lookup(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    lobs = tables.where("obj % 3 = 0").select((F.col("obj") + 2_000_000).alias("lob_obj"), "obj")
    frags = lobs.where("lob_obj % 2 = 0").select((F.col("lob_obj") + 1_000_000).alias("frag_obj"), F.col("lob_obj").alias("parent_obj"))
    return dictionary.lob_tables(lobs, frags, tables.where("obj % 2 = 0"))


QUERIES = {
    f.__name__: f
    for f in (
        row_piece_islands, dml_classify, multi_row_explode, split_column_merge, undo_block_merge, update_changed_columns, update_all_logged,
        insert_nonnull_projection, delete_before_image, supplemental_fallback, not_null_repair, guard_null_bitmap, tag_key, json_images,
        condition_op_user, dict_asof_resolve, dict_asof_sorted, schemaless_names, dict_versions, filter_owner_table_regex, filter_first_rule_wins,
        table_exclusions, dict_schema_diff, orphan_prune, table_column_maps, partition_lookup, lob_lookup,
    )
}


def _text(parts: dict[str, tuple[str, str]]) -> str:
    """SQL of ``diff.text_of``: name to (is shown, value)."""
    shown = [f"CASE WHEN {show} THEN CASE WHEN {v} IS NULL THEN '{n}' ELSE '{n}=' || {v} END END" for n, (show, v) in sorted(parts.items())]
    return f"concat_ws(';', {', '.join(shown)})"


_BEFORE = {"id": ("true", "b_id"), "price": ("true", "b_price"), "priority": ("true", "b_priority"), "status": ("id % 6 = 0", "b_status")}
_AFTER = {"id": ("true", "a_id"), "price": ("true", "a_price"), "priority": ("id % 2 = 1", "a_priority"), "status": ("true", "a_status")}


def _both(mode: int, side: str) -> str:
    out = {}
    for n in COLUMNS:
        (in_b, b), (in_a, a) = _BEFORE[n], _AFTER[n]
        same = f"(({in_b}) AND ({in_a}) AND {b} IS NOT DISTINCT FROM {a})"
        bare = f"((({in_b}) AND NOT ({in_a}) AND {b} IS NULL) OR (({in_a}) AND NOT ({in_b}) AND {a} IS NULL))"
        show = "true" if n == "id" or mode == 2 else f"NOT ({same} OR {bare})"
        out[n] = (show, f"CASE WHEN {in_b} THEN {b} END" if side == "b" else f"CASE WHEN {in_a} THEN {a} END")
    return _text(out)


def _update_sql(mode: int) -> str:
    return f"SELECT id, {_both(mode, 'b')} AS before, {_both(mode, 'a')} AS after FROM ({_IMAGES}) WHERE op = 'UPDATE'"


_ISLANDS = f"""
WITH p AS (SELECT *, scn % 3 <> 1 AS fb_last FROM ({_CHANGES})),
l AS (SELECT *, coalesce(lag(fb_last::INT) OVER w, 0) AS ended FROM p WINDOW w AS (PARTITION BY usn, slt, sqn ORDER BY scn, sub_scn)),
r AS (SELECT *, CAST(sum(ended) OVER (PARTITION BY usn, slt, sqn ORDER BY scn, sub_scn) AS BIGINT) AS row_no FROM l)
"""
_RULE = lambda r: f"(regexp_full_match(c_name, '{r['owner']}') AND regexp_full_match(c_mktsegment, '{r['table']}'))"
_ASOF = f"SELECT p.*, owner, name, columns_text FROM ({_CHANGES}) p LEFT JOIN ({_DICT}) d ON p.obj = d.obj AND scn >= valid_from AND (valid_to IS NULL OR scn < valid_to)"
_ASOF_OUT = f"SELECT usn, slt, sqn, scn, obj, owner, name, columns_text FROM ({_ASOF})"
_T = "(SELECT c_custkey AS obj, c_name AS owner, c_mktsegment AS name FROM customer)"
ORACLE = {
    "row_piece_islands": _ISLANDS + "SELECT usn, slt, sqn, scn, row_no FROM r",
    "dml_classify": _ISLANDS + """
SELECT usn, slt, sqn, row_no, CASE WHEN count(DISTINCT kind) > 1 THEN 'u' WHEN min(kind) = 'INSERT' THEN 'c' WHEN min(kind) = 'DELETE' THEN 'd' ELSE 'u' END AS op,
       min(scn) AS scn, count(*) AS n_pieces, CAST(sum(size) AS BIGINT) AS bytes, arg_min(obj, scn) AS obj FROM r GROUP BY usn, slt, sqn, row_no""",
    "multi_row_explode": f"SELECT usn, slt, sqn, scn, k AS slot_no, scn * 10 + k + 1 AS row FROM ({_CHANGES}), range(4) t(k) WHERE k <= scn % 4",
    "split_column_merge": "SELECT c_custkey, c_name AS value, CAST(3 AS BIGINT) AS n_parts FROM customer",
    "undo_block_merge": f"""
WITH p AS (SELECT *, CAST(sum(CASE WHEN scn % 5 IN (0, 1) THEN 1 ELSE 0 END) OVER (PARTITION BY usn, slt, sqn ORDER BY scn, sub_scn) AS BIGINT) AS run FROM ({_CHANGES}))
SELECT usn, slt, sqn, run, min(scn) AS scn, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n_blocks FROM p GROUP BY ALL""",
    "update_changed_columns": _update_sql(0),
    "update_all_logged": _update_sql(2),
    "insert_nonnull_projection": f"SELECT id, {_text({n: (f'({s}) AND {v} IS NOT NULL', v) for n, (s, v) in _AFTER.items()})} AS after, {_text({n: ('true', f'CASE WHEN {s} THEN {v} END') for n, (s, v) in _AFTER.items()})} AS full FROM ({_IMAGES}) WHERE op = 'INSERT'",
    "delete_before_image": f"SELECT id, {_text({n: (f'({s}) AND {v} IS NOT NULL', v) for n, (s, v) in _BEFORE.items()})} AS before FROM ({_IMAGES}) WHERE op = 'DELETE'",
    "supplemental_fallback": f"SELECT id, {_text({'id': ('true', 'a_id'), 'price': ('true', 'a_price'), 'priority': ('true', 'CASE WHEN id % 2 = 1 THEN coalesce(a_priority, b_priority) ELSE b_priority END'), 'status': ('true', 'coalesce(a_status, b_status)')})} AS image FROM ({_IMAGES})",
    "not_null_repair": f"SELECT id, {_text({'id': ('true', 'a_id'), 'price': ('true', 'a_price'), 'priority': ('true', 'coalesce(a_priority, b_priority)'), 'status': ('true', 'a_status')})} AS image FROM ({_IMAGES})",
    "guard_null_bitmap": f"SELECT id, {_text({**_AFTER, 'priority': ('true', 'CASE WHEN id % 2 = 1 THEN a_priority END')})} AS image FROM ({_IMAGES})",
    "tag_key": f"SELECT id, a_id || '.' || a_price AS pk, a_id || '.' || a_price || '.' || CASE WHEN id % 2 = 1 THEN coalesce(a_priority, '') ELSE '' END || '.' || coalesce(a_status, '') AS all_columns FROM ({_IMAGES})",
    "json_images": "SELECT id, '{' || concat_ws(',', " + ", ".join(
        f"CASE WHEN {'true' if n == 'id' else _shown} THEN '\"{n}\":' || coalesce('\"' || {v} || '\"', 'null') END"
        for n, _shown, v in (
            ("id", "true", "a_id"),
            ("price", "b_price IS DISTINCT FROM a_price", "a_price"),
            ("priority", "NOT ((id % 2 = 1 AND b_priority IS NOT DISTINCT FROM a_priority) OR (id % 2 = 0 AND b_priority IS NULL))", "CASE WHEN id % 2 = 1 THEN a_priority END"),
            ("status", "NOT ((id % 6 = 0 AND b_status IS NOT DISTINCT FROM a_status) OR (id % 6 <> 0 AND a_status IS NULL))", "a_status"),
        )
    ) + f") || '}}' AS after FROM ({_IMAGES}) WHERE op = 'UPDATE'",
    "condition_op_user": f"""
SELECT id, letter = 'd' AS plain, NOT (letter = 'd' AND coalesce(c_name, '') = 'Customer#000000003') AS both,
       (letter = 'u' OR letter = 'c') AND coalesce(c_mktsegment, '') = 'BUILDING' AS left, true AS missing, NOT letter = 'u' AS negated
FROM (SELECT id, CASE op WHEN 'INSERT' THEN 'c' WHEN 'DELETE' THEN 'd' ELSE 'u' END AS letter FROM ({_IMAGES})) LEFT JOIN customer ON id % 1500 = c_custkey""",
    "dict_asof_resolve": _ASOF_OUT,
    "dict_asof_sorted": _ASOF_OUT,
    "schemaless_names": f"SELECT owner, coalesce(name, 'OBJ_' || obj) AS name, count(*) AS n FROM ({_ASOF}) GROUP BY 1, 2",
    "dict_versions": f"""
SELECT obj, col, scn AS valid_from, valid_to FROM (
  SELECT obj, usn * 100 + slt AS col, scn, kind, lead(scn) OVER (PARTITION BY obj, usn * 100 + slt ORDER BY scn) AS valid_to FROM ({_CHANGES}) WHERE kind IN ('INSERT', 'DELETE')) WHERE kind = 'INSERT'""",
    "filter_owner_table_regex": f"SELECT c_custkey AS obj FROM customer WHERE {_RULE(RULES[0])}",
    "filter_first_rule_wins": f"SELECT * FROM (SELECT c_custkey AS obj, CASE WHEN {_RULE(RULES[0])} THEN 0 WHEN {_RULE(RULES[1])} THEN 1 WHEN {_RULE(RULES[2])} THEN 2 END AS rule_no FROM customer) WHERE rule_no IS NOT NULL",
    "table_exclusions": """
SELECT c_custkey AS obj, CASE WHEN c_custkey % 5 = 1 THEN 'dropped' WHEN c_custkey % 7 = 6 THEN 'not a table' WHEN c_custkey % 11 = 9 THEN 'no table entry' WHEN c_custkey % 11 = 3 THEN 'binary'
  WHEN c_custkey % 11 = 4 THEN 'index organized' WHEN c_custkey % 5 = 2 THEN 'temporary' WHEN c_custkey % 11 = 5 THEN 'nested' WHEN c_custkey % 3 = 0 AND c_custkey % 11 <> 7 THEN 'compressed' END AS excluded FROM customer""",
    "dict_schema_diff": "SELECT c_custkey AS obj, CASE c_custkey % 10 WHEN 3 THEN 'right' WHEN 4 THEN 'left' ELSE 'both' END AS side FROM customer WHERE c_custkey % 10 IN (3, 4, 5)",
    "orphan_prune": "SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1",
    "table_column_maps": f"""
WITH c AS (SELECT obj, p AS col, n FROM {_T}, (VALUES (1, 'ID'), (2, 'NAME'), (3, 'KIND'), (4, 'NOTE')) v(p, n) WHERE (obj + p) % 5 <> 0)
SELECT obj, string_agg(n, ',' ORDER BY col) AS cols, coalesce(string_agg(n, ',' ORDER BY col) FILTER (col IN (1, 3)), '') AS tag, coalesce(string_agg(n, ',' ORDER BY col) FILTER (n IN ('NAME', 'KIND')), '') AS key,
       concat_ws(',', CASE WHEN NOT bool_or(n = 'NAME') THEN 'NAME' END, CASE WHEN NOT bool_or(n = 'KIND') THEN 'KIND' END) AS missing FROM c GROUP BY obj""",
    "partition_lookup": f"SELECT obj AS part_obj, obj, owner FROM {_T} UNION ALL SELECT obj + 1000000, obj, owner FROM {_T} WHERE obj % 4 = 0",
    "lob_lookup": f"""
SELECT obj + 2000000 AS lob_obj, obj, CASE WHEN obj % 2 = 0 THEN owner END AS owner, CASE WHEN obj % 2 = 0 THEN name END AS name FROM {_T} WHERE obj % 3 = 0
UNION ALL SELECT obj + 3000000, obj, owner, name FROM {_T} WHERE obj % 6 = 0""",
}
