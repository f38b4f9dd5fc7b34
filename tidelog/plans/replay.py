"""Batch replay: an ordered change log to messages, as one lazy plan.

One shuffle (by transaction; a second one where global commit order is asked for) and one broadcast (the
dictionary, size checked). Records of all tables go through the stack, since an undo record takes back the last
change of its transaction whatever tables are shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import formats
from tidelog.operators import condition, dictionary, diff, messages
from tidelog.operators import transactions as tx
from tidelog.plans import scratch

#: Where a message stands in its transaction.
PLACES = {"begin": 0, "change": 1, "commit": 2}
#: Order of messages: commits, and in a transaction its begin, changes by number, and commit.
MESSAGE_ORDER = ["commit_scn", *tx.XID, "at", "num"]


def _listed(text: Column) -> Column:
    """Names by comma as an array; none for null and empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: x != "")


def named_tables(versions: DataFrame, rules: list[dict], hide_system: bool = True) -> DataFrame:
    """The dictionary's versions that a rule shows, with ``columns`` and ``keys`` as arrays.

    A rule's key replaces the primary key (``key_text``); a key column that the table doesn't have is an error. Tables marked
    ``is_system`` stay in the dictionary but not in the output.
    """
    named = dictionary.apply_rules(versions, rules)
    if hide_system and "is_system" in named.columns:
        named = named.where(~F.coalesce("is_system", F.lit(False)))
    primary = F.col("key_text") if "key_text" in named.columns else F.lit(None).cast("string")
    key = primary
    for k, rule in enumerate(rules):
        if rule.get("key"):
            key = F.when(F.col("rule_no") == k, ",".join(x.strip() for x in rule["key"].split(","))).otherwise(key)
    named = named.withColumns({"columns": _listed(F.col("columns_text")), "keys": _listed(key)})
    own = F.array().cast("array<string>")
    if any(rule.get("key") for rule in rules):
        by_rule = F.coalesce(*(F.when(F.col("rule_no") == k, F.lit(bool(rule.get("key")))) for k, rule in enumerate(rules)), F.lit(False))
        dictionary.check_keys(named.withColumn("missing", F.when(by_rule, F.array_except("keys", "columns")).otherwise(own)))
    return named


def changes(redo: DataFrame, versions: DataFrame, options: messages.FormatOptions, rules: list[dict] | None = None, skip_xid: DataFrame | None = None, max_bytes: int = 0, after_scn: int = 0, schemaless: bool = False, hide_system: bool = True) -> DataFrame:
    """Shown changes of committed transactions with the columns that messages are made of.

    ``redo`` has ``before`` and ``after`` maps (and, where known, ``attrs``, ``thread``, ``rid`` and ``offset``); ``versions`` is the
    dictionary with ``owner, name, columns_text`` (names by comma) and, where known, ``key_text``, ``types`` (array of name, type,
    length, precision, scale, nullable) and ``is_system``.
    """
    rules = rules if rules is not None else [{"owner": ".*", "table": ".*"}]
    if skip_xid is not None:
        redo = tx.skip(redo, skip_xid)
    if max_bytes:
        redo, _ = tx.within_limit(redo, max_bytes)
    # A version's rule depends on the names at that time, so the record is resolved before rules apply to it.
    named = named_tables(versions, rules, hide_system)
    placed = tx.committed_changes(redo, after_scn or None)
    placed = dictionary.as_of(placed, named, columns=[c for c in named.columns if c not in ("obj", "valid_from", "valid_to")])
    placed = dictionary.schemaless(placed) if schemaless else placed.where("name IS NOT NULL")
    letter = F.when(F.col("kind") == "INSERT", "c").when(F.col("kind") == "DELETE", "d").otherwise("u")
    attrs = F.coalesce("attrs", diff.empty()) if "attrs" in placed.columns else diff.empty()
    shown = F.lit(True)
    for k, rule in enumerate(rules):
        if rule.get("condition"):
            shown = shown & ((F.coalesce("rule_no", F.lit(-1)) != k) | condition.compile_condition(rule["condition"], letter, attrs))
    placed = placed.where(shown)
    empty = F.array().cast("array<string>")
    keys, columns = F.coalesce("keys", empty), F.coalesce("columns", empty)
    before, after = F.coalesce("before", diff.empty()), F.coalesce("after", diff.empty())
    both = diff.changed(diff.pairs(before, after), keys, options.column)
    one = lambda image: image if options.column >= 2 else diff.one_image(image, keys, columns, options.column)
    before = F.when(letter == "d", one(before)).when(letter == "u", diff.side(both, "b"))
    after = F.when(letter == "c", one(after)).when(letter == "u", diff.side(both, "a"))
    if "types" in placed.columns:
        types = F.map_from_entries(F.transform(F.coalesce("types", F.array().cast(placed.schema["types"].dataType)), lambda c: F.struct(c["name"], c["type"].cast("int"))))
        if not options.unknown_type:
            before, after = diff.hide_unsupported(before, types, after=False), diff.hide_unsupported(after, types, after=True)
        block = messages.columns_json(F.col("types"))
    else:
        block = F.to_json("columns")
    had = lambda name, other: F.col(name) if name in redo.columns else other
    return placed.withColumns({
        "op": letter, "ts_s": formats.seconds_of(F.col("ts")), "begin_s": formats.seconds_of(F.col("begin_ts")), "commit_s": formats.seconds_of(F.col("end_ts")),
        "user": F.element_at(attrs, "login username"), "thread": had("thread", F.lit(1)), "rid": had("rid", F.lit("")), "attrs_json": F.to_json(attrs),
        "before_json": messages.image_json(before), "after_json": messages.image_json(after), "columns_json": block, "offset": had("offset", F.col("scn")),
    })


def _with_first(placed: DataFrame, versions: DataFrame, options: messages.FormatOptions, schemaless: bool) -> DataFrame:
    if options.schema & 1 and not options.schema & 2:
        # Tables that have a version are as few as the versions; unknown ones may be any number.
        return messages.first_of_obj(placed, ["commit_scn", *tx.XID, "num"], bounded=not schemaless and dictionary.small(versions))
    return placed.withColumn("first_of_obj", F.lit(True))


def replay(redo: DataFrame, versions: DataFrame, options: messages.FormatOptions, rules: list[dict] | None = None, skip_xid: DataFrame | None = None, max_bytes: int = 0, after_scn: int = 0, schemaless: bool = False) -> DataFrame:
    """Messages of changes ``(commit_scn, usn, slt, sqn, num, owner, name, op, body)``, numbered inside their transaction."""
    placed = changes(redo, versions, options, rules, skip_xid, max_bytes, after_scn, schemaless)
    placed = placed.withColumns({"c_scn": F.col("begin_scn"), "c_idx": F.col("num") + 1})
    return messages.dml(_with_first(placed, versions, options, schemaless), options).select("commit_scn", *tx.XID, "num", "owner", "name", "op", "body")


def whole(redo: DataFrame, versions: DataFrame, options: messages.FormatOptions, ddl: DataFrame | None = None, begin: bool = True, commit: bool = True, **rest) -> DataFrame:
    """All messages of transactions, with begin, commit and DDL: ``(commit_scn, usn, slt, sqn, at, num, place, seq, c_scn, c_idx, body)``.

    ``MESSAGE_ORDER`` sorts them as they are sent. Numbers count the shown changes, positions all messages, as ``message_positions``
    says. ``ddl`` has statements (``usn, slt, sqn, scn, sub_scn, ts, obj, owner, name, sql_text``), which stand among the changes of
    their transaction. A transaction that shows nothing sends nothing. Changes are written to the shared folder once, as all kinds of
    messages read them.
    """
    placed = changes(redo, versions, options, **rest)
    schemaless = rest.get("schemaless", False)
    line = _with_first(placed, versions, options, schemaless).withColumn("is_ddl", F.lit(False))
    if ddl is not None:
        done = tx.emitted(tx.transactions(redo)).select(*tx.XID, "begin_scn", "commit_scn", "begin_ts", "end_ts")
        seconds = {"ts_s": formats.seconds_of(F.col("ts")), "begin_s": formats.seconds_of(F.col("begin_ts")), "commit_s": formats.seconds_of(F.col("end_ts"))}
        told = ddl.join(done, tx.XID).withColumns({**seconds, "is_ddl": F.lit(True)})
        line = line.unionByName(told, allowMissingColumns=True)
    order = Window.partitionBy(*tx.XID).orderBy(*tx.ORDER, "is_ddl")
    line = scratch.written(line.withColumn("num", F.row_number().over(order) - 1), "changes")
    ends = redo.where("kind = 'COMMIT'").groupBy(*tx.XID).agg(F.max("seq").alias("seq"))
    extra = int(begin) + int(commit)
    shown = line.groupBy(*tx.XID, "begin_scn", "commit_scn", "begin_s", "commit_s").agg(F.count("*").alias("n_changes"), F.first("user", ignorenulls=True).alias("user"), F.first("thread", ignorenulls=True).alias("thread"))
    shown = tx.message_positions(shown.join(ends, tx.XID).withColumn("n", F.col("n_changes") + extra))
    line = line.join(shown.select(*tx.XID, "seq" if "seq" not in line.columns else F.col("seq").alias("_seq"), "first_idx"), tx.XID)
    line = line.withColumns({"seq": F.col("_seq") if "_seq" in line.columns else F.col("seq"), "c_scn": F.col("begin_scn"), "c_idx": F.col("first_idx") + F.col("num") + int(begin)})
    keep = ["commit_scn", *tx.XID, "at", "num", "place", "seq", "c_scn", "c_idx", "body"]
    put = lambda df, place, at: df.withColumns({"place": F.lit(place), "at": F.lit(PLACES[at])}).select(*keep)
    out = put(messages.dml(line.where("NOT is_ddl"), options), "change", "change")
    if ddl is not None:
        out = out.unionByName(put(messages.ddl(line.where("is_ddl"), options), "ddl", "change"))
    around = shown.withColumns({"c_scn": F.col("begin_scn"), "thread": F.coalesce("thread", F.lit(1))})
    if begin:
        rows = around.withColumns({"scn": F.col("begin_scn"), "ts_s": F.col("begin_s"), "num": F.lit(-1), "c_idx": F.col("first_idx")})
        out = out.unionByName(put(messages.around(rows, options, "begin"), "begin", "begin"))
    if commit:
        rows = around.withColumns({"scn": F.col("commit_scn"), "ts_s": F.col("commit_s"), "num": F.lit(-1), "c_idx": F.col("first_idx") + F.col("n") - 1})
        out = out.unionByName(put(messages.around(rows, options, "commit"), "commit", "commit"))
    return out
