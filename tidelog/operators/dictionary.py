"""The data dictionary over time, and records resolved against it.

A version is valid from the commit of the transaction that made it (not from the record's own
number) until the next one. Rows: ``obj`` and whatever describes it, ``valid_from``, ``valid_to`` (null: open).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Versions up to this many are broadcast; beyond, one sorted union answers instead.
BROADCAST_ROWS = 500_000


def versions(changes: DataFrame, key: list[str], scn_col: str = "commit_scn", gone: Column | None = None) -> DataFrame:
    """Changes of dictionary rows to versions; rows that ``gone`` marks only end the one before."""
    order = Window.partitionBy(*key).orderBy(scn_col)
    rows = changes.withColumn("valid_from", F.col(scn_col)).withColumn("valid_to", F.lead(scn_col).over(order))
    return rows.where(~gone) if gone is not None else rows


def small(dictionary: DataFrame) -> bool:
    """Whether there are few enough versions to broadcast. Reads no more than that many rows."""
    return dictionary.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def as_of(records: DataFrame, dictionary: DataFrame, key: str = "obj", scn_col: str = "scn", columns: list[str] | None = None) -> DataFrame:
    """Every record with the columns of the version valid at its number (null where there is none).

    Versions of a key must not overlap; ``overlaps`` finds those that do.
    """
    columns = columns or [c for c in dictionary.columns if c not in (key, "valid_from", "valid_to")]
    if small(dictionary):
        d = dictionary.select(F.col(key).alias("_key"), "valid_from", "valid_to", *columns)
        hit = (F.col(key) == F.col("_key")) & (F.col(scn_col) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(scn_col) < F.col("valid_to")))
        return records.join(F.broadcast(d), hit, "left").drop("_key", "valid_from", "valid_to")
    return as_of_sorted(records, dictionary, key, scn_col, columns)


def overlaps(dictionary: DataFrame, key: str = "obj") -> DataFrame:
    """Versions that begin before the one before them ends."""
    order = Window.partitionBy(key).orderBy("valid_from")
    rows = dictionary.withColumn("_end", F.lag(F.coalesce("valid_to", F.lit(2**63 - 1))).over(order))
    return rows.where(F.col("_end") > F.col("valid_from")).drop("_end")


#: Buckets of a number range that a table's records are dealt into by ``as_of_sorted``.
AS_OF_RANGES = 256


def as_of_sorted(records: DataFrame, dictionary: DataFrame, key: str = "obj", scn_col: str = "scn", columns: list[str] | None = None) -> DataFrame:
    """The same by one shuffle: versions and records are sorted together and the last version is carried on.

    Records are dealt by key and range of their number, so a hot table is many tasks; each version also goes to the ranges that
    it reaches into, so nothing has to be carried from one range to the next.
    """
    columns = columns or [c for c in dictionary.columns if c not in (key, "valid_from", "valid_to")]
    version = F.struct("valid_from", "valid_to", *columns)
    kind = dictionary.select("valid_from", "valid_to", *columns).schema
    ends = records.agg(F.min(scn_col).alias("low"), F.max(scn_col).alias("high")).first()
    low, width = ends["low"] or 0, max(1, ((ends["high"] or 0) - (ends["low"] or 0)) // AS_OF_RANGES + 1)
    range_of = lambda c: F.floor((c - low) / width).cast("int")
    first = F.greatest(F.lit(0), range_of(F.col("valid_from")))
    last = F.least(F.lit(AS_OF_RANGES - 1), range_of(F.coalesce("valid_to", F.lit(ends["high"] or 0))))
    reach = F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))
    d = dictionary.select(F.col(key).alias("_key"), reach.alias("_range"), F.col("valid_from").alias("_at"), F.lit(0).alias("_side"), version.alias("_version"), F.lit(None).cast(records.schema).alias("_row"))
    r = records.select(F.col(key).alias("_key"), range_of(F.col(scn_col)).alias("_range"), F.col(scn_col).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_version"), F.struct(*records.columns).alias("_row"))
    order = Window.partitionBy("_key", "_range").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = d.unionByName(r).withColumn("_last", F.last("_version", ignorenulls=True).over(order)).where("_side = 1")
    live = F.col("_last.valid_to").isNull() | (F.col("_at") < F.col("_last.valid_to"))
    return both.select("_row.*", *(F.when(live, F.col(f"_last.{c}")).alias(c) for c in columns))


def with_partitions(objects: DataFrame, partitions: DataFrame) -> DataFrame:
    """Objects and their partitions (``obj, base_obj``), each leading to the table's row."""
    inner = partitions.select(F.col("obj").alias("part_obj"), F.col("base_obj").alias("obj")).join(objects, "obj")
    return objects.withColumn("part_obj", F.col("obj")).unionByName(inner)


def lob_tables(lobs: DataFrame, fragments: DataFrame, tables: DataFrame) -> DataFrame:
    """(lob_obj, obj, owner, name): a data object of a large object, or of its fragment, to its table."""
    own = lobs.select("lob_obj", "obj")
    parts = fragments.select(F.col("frag_obj").alias("lob_obj"), F.col("parent_obj").alias("_parent")).join(lobs.select(F.col("lob_obj").alias("_parent"), "obj"), "_parent").select("lob_obj", "obj")
    return own.unionByName(parts).join(tables.select("obj", "owner", "name"), "obj", "left")


def schemaless(records: DataFrame, obj_col: str = "obj", owner_col: str = "owner", name_col: str = "name") -> DataFrame:
    """Unknown objects get ``OBJ_<n>`` for a name."""
    return records.withColumn(name_col, F.coalesce(name_col, F.concat(F.lit("OBJ_"), F.col(obj_col).cast("string"))))


def column_name(name: Column, number: Column) -> Column:
    """Unknown columns get ``COL_<n>``."""
    return F.coalesce(name, F.concat(F.lit("COL_"), number.cast("string")))


def apply_rules(tables: DataFrame, rules: list[dict]) -> DataFrame:
    """Tables that a rule names, each with its first rule; patterns must match whole names."""
    if not rules:
        return tables.withColumn("rule_no", F.lit(None).cast("int")).where(F.lit(False))
    rule = F.lit(None).cast("int")
    for k in range(len(rules) - 1, -1, -1):
        hit = F.col("owner").rlike(f"^(?:{rules[k]['owner']})$") & F.col("name").rlike(f"^(?:{rules[k]['table']})$")
        rule = F.when(hit, F.lit(k)).otherwise(rule)
    return tables.withColumn("rule_no", rule).where("rule_no IS NOT NULL")


def bit(value: Column, k: int) -> Column:
    return F.shiftright(value, k).bitwiseAND(F.lit(1)) == 1


#: Bits of an object's flags and of a table's property and flags, and the type number of a table.
TABLE_TYPE = 2
OBJECT_BITS = {"temporary": 1, "secondary": 4, "in_memory_temp": 5, "dropped": 7}
PROPERTY_BITS = {"binary": 0, "partitioned": 5, "iot_only": 6, "iot_overflow": 9, "nested": 13}
FLAG_BITS = {"iot_mapping": 29}


def exclusions(tables: DataFrame) -> DataFrame:
    """Why a table is left out (null: it isn't), of ``type, obj_flags, property, tab_flags, compressed``."""
    o = lambda n: bit(F.col("obj_flags"), OBJECT_BITS[n])
    p = lambda n: bit(F.col("property"), PROPERTY_BITS[n])
    why = (
        F.when(o("dropped"), "dropped")
        .when(F.col("type") != TABLE_TYPE, "not a table")
        .when(F.col("property").isNull(), "no table entry")
        .when(p("binary"), "binary")
        .when(p("iot_only") | p("iot_overflow") | bit(F.col("tab_flags"), FLAG_BITS["iot_mapping"]), "index organized")
        .when(o("temporary") | o("secondary") | o("in_memory_temp"), "temporary")
        .when(p("nested"), "nested")
        .when(F.coalesce("compressed", F.lit(False)) & ~p("partitioned"), "compressed")
    )
    return tables.withColumn("excluded", why)


def visible_columns(columns: DataFrame, show_hidden: bool = False, show_guard: bool = False, show_nested: bool = False, show_unused: bool = False) -> DataFrame:
    """Columns without those flagged hidden, guard, nested or unused, unless they are asked for."""
    for flag, show in (("is_hidden", show_hidden), ("is_guard", show_guard), ("is_nested", show_nested), ("is_unused", show_unused)):
        if not show:
            columns = columns.where(~F.col(flag))
    return columns


def table_maps(tables: DataFrame, columns: DataFrame, constraints: DataFrame, lobs: DataFrame | None = None) -> DataFrame:
    """A row for each table with its columns in order (up to a few thousand) and the columns of its primary key.

    With ``lobs`` (``obj, int_col, lob_obj``) also the data objects of its large objects, and with ``is_guard`` in the columns its guards.
    """
    keys = constraints.where("type = 'P'").select("obj", "int_col").distinct().withColumn("is_key", F.lit(True))
    marked = columns.join(keys, ["obj", "int_col"], "left").withColumn("is_key", F.coalesce("is_key", F.lit(False)))
    guard = F.coalesce("is_guard", F.lit(False)) if "is_guard" in columns.columns else F.lit(False)
    lists = marked.groupBy("obj").agg(F.array_sort(F.collect_list(F.struct("col", F.col("name").alias("column"), "is_key", guard.alias("is_guard")))).alias("cols"))
    out = tables.join(lists, "obj", "left")
    named = lambda flag: F.transform(F.filter("cols", lambda c: c[flag]), lambda c: c["column"])
    out = out.withColumns({"key": named("is_key"), "guards": named("is_guard"), "cols": F.transform("cols", lambda c: c["column"])})
    if lobs is not None:
        held = lobs.groupBy("obj").agg(F.array_sort(F.collect_list("lob_obj")).alias("lobs"))
        out = out.join(held, "obj", "left").withColumn("lobs", F.coalesce("lobs", F.array().cast("array<bigint>")))
    return out


def snapshot_columns(owners: DataFrame, objects: DataFrame, columns: DataFrame, lobs: DataFrame) -> DataFrame:
    """Columns of the tables of some owners, with owner, table and the data object of a large object: the joins of a dictionary snapshot."""
    tables = objects.join(owners, "user_id").select("owner", "obj", F.col("name").alias("table_name"))
    return tables.join(columns, "obj").join(lobs.select("obj", "int_col", "lob_obj"), ["obj", "int_col"], "left")


def named(records: DataFrame, tables: DataFrame, uncommitted: DataFrame, owners: DataFrame) -> DataFrame:
    """``records`` with owner and name of their table: a known one's, or, by two steps, that of a row not committed yet.

    ``tables`` has ``obj, owner, name``; ``uncommitted`` has ``obj, user_id, name``; an unknown owner leaves both null.
    """
    new = uncommitted.join(owners, "user_id").select(F.col("obj"), F.col("owner").alias("_owner"), F.col("name").alias("_name"))
    out = records.join(tables.select("obj", "owner", "name"), "obj", "left").join(new, "obj", "left")
    return out.withColumns({"owner": F.coalesce("owner", "_owner"), "name": F.coalesce("name", "_name")}).drop("_owner", "_name")


def override_key(maps: DataFrame, key: list[str] | None) -> DataFrame:
    """The rule's key instead of the primary key; ``missing`` lists names that the table doesn't have (``check_keys`` refuses them)."""
    if not key:
        return maps.withColumn("missing", F.array().cast("array<string>"))
    wanted = F.array(*map(F.lit, key))
    return maps.withColumn("missing", F.array_except(wanted, "cols")).withColumn("key", F.filter("cols", lambda c: F.array_contains(wanted, c)))


class KeyColumnError(ValueError):
    """A rule's key names a column that a table doesn't have."""


def check_keys(maps: DataFrame) -> DataFrame:
    """``maps``, if no rule's key names a column that its table doesn't have. One row a table is read."""
    wrong = maps.where(F.size("missing") > 0).select("owner", "name", F.array_join("missing", ", ").alias("missing")).limit(1).collect()
    if wrong:
        raise KeyColumnError(f"table {wrong[0]['owner']}.{wrong[0]['name']} has no column {wrong[0]['missing']}, which its rule's key names")
    return maps


def tag_columns(maps: DataFrame, tag: str | None) -> DataFrame:
    """``[pk]``, ``[all]`` or names in order."""
    if not tag:
        return maps.withColumn("tag", F.array().cast("array<string>"))
    if tag == "[pk]":
        return maps.withColumn("tag", F.col("key"))
    if tag == "[all]":
        return maps.withColumn("tag", F.col("cols"))
    return maps.withColumn("tag", F.array(*(F.lit(c.strip()) for c in tag.split(","))))


def difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows that differ between two dictionaries: ``side`` is left, right or both (changed)."""
    rest = [c for c in left.columns if c not in key]
    x = left.select(*key, F.struct(*rest).alias("l"))
    y = right.select(*key, F.struct(*rest).alias("r"))
    both = x.join(y, key, "full_outer").where(~F.col("l").eqNullSafe(F.col("r")))
    return both.select(*key, F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("both").alias("side"))


def without_orphans(children: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    return children.join(parents.select(*key).distinct(), key, "left_semi")
