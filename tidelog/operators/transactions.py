"""Transactions out of an ordered change log.

``redo`` has the transaction id (``usn, slt, sqn``), its order key (``scn, sub_scn``), ``kind`` (BEGIN, COMMIT,
ROLLBACK, UNDO_LAST or a change), ``obj``, ``size`` and ``ts``. One hash partitioning by transaction id
serves grouping and windows alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

XID = ["usn", "slt", "sqn"]
ORDER = ["scn", "sub_scn"]
#: Where two records share a change number and sub-number, the place in the log decides, if the log says it.
PLACE = ["block", "page_offset"]
CHANGES = ("INSERT", "UPDATE", "DELETE")
#: Which record undoes which change.
INVERSE = {"INSERT": "DELETE", "DELETE": "INSERT", "UPDATE": "UPDATE"}


def order_of(rows: DataFrame) -> list[str]:
    """The columns that order records."""
    return [*ORDER, *(c for c in PLACE if c in rows.columns)]


def _at(kinds, column: str) -> F.Column:
    return F.when(F.col("kind").isin(*kinds), F.col(column))


def transactions(redo: DataFrame) -> DataFrame:
    """One row for each transaction: begin, end, outcome, counts and bytes. Partial sums go over the wire."""
    is_end = ("COMMIT", "ROLLBACK")
    return redo.groupBy(*XID).agg(
        F.min(_at(["BEGIN"], "scn")).alias("begin_scn"),
        F.max(_at(is_end, "scn")).alias("end_scn"),
        F.max(_at(["COMMIT"], "scn")).alias("commit_scn"),
        F.min(_at(["BEGIN"], "ts")).alias("begin_ts"),
        F.max(_at(is_end, "ts")).alias("end_ts"),
        F.max(F.when(F.col("kind").isin(*is_end), F.col("kind"))).alias("outcome"),
        F.count(F.when(F.col("kind").isin(*CHANGES), 1)).alias("n_changes"),
        F.count(F.when(F.col("kind") == "UNDO_LAST", 1)).alias("n_undo"),
        F.sum("size").alias("bytes"),
    )


def emitted(tx: DataFrame) -> DataFrame:
    """Committed transactions whose begin was seen."""
    return tx.where((F.col("outcome") == "COMMIT") & F.col("begin_scn").isNotNull())


def classes(tx: DataFrame, after_scn: int = 0) -> DataFrame:
    """Each transaction's fate: open, rolled back, partial (no begin), done before, or out."""
    fate = (
        F.when(F.col("outcome").isNull(), "open")
        .when(F.col("outcome") == "ROLLBACK", "rollback")
        .when(F.col("begin_scn").isNull(), "partial")
        .when(F.col("commit_scn") <= after_scn, "skip")
        .otherwise("out")
    )
    return tx.withColumn("fate", fate)


def _stacked(rows: DataFrame) -> DataFrame:
    """``rows`` with what a stack of changes makes of them, by windows over one partitioning by transaction.

    ``_depth`` is the running sum of +1 and -1, lifted where an undo finds nothing; a change is live if no later depth of
    its transaction falls below its own. An undo must be the inverse of the change that it takes back, and name its object:
    that change is the one before it at the same depth. Where one doesn't match (``_bad`` of the whole transaction), depths
    after it don't hold, and ``_folded`` answers. ``n_mismatch`` counts undos that found nothing, if all others match.
    """
    order = Window.partitionBy(*XID).orderBy(*order_of(rows))
    so_far, rest, whole = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(*XID)
    change, undo = F.col("kind").isin(*CHANGES), F.col("kind") == "UNDO_LAST"
    rows = rows.withColumn("_sum", F.sum(F.when(change, 1).when(undo, -1).otherwise(0)).over(so_far))
    rows = rows.withColumn("_depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(so_far)))
    rows = rows.withColumns({"_low": F.min("_depth").over(rest), "_level": F.when(change, F.col("_depth")).when(undo, F.coalesce(F.lag("_depth").over(order), F.lit(0))).otherwise(-1)})
    last = F.lag(F.struct("kind", "obj")).over(Window.partitionBy(*XID, "_level").orderBy(*order_of(rows)))
    taken = F.create_map(*(F.lit(x) for pair in INVERSE.items() for x in pair))[last["kind"]]
    wrong = undo & (F.col("_level") > 0) & ~(taken.eqNullSafe(F.col("undo_kind")) & last["obj"].eqNullSafe(F.col("obj")))
    rows = rows.withColumn("_wrong", wrong)
    return rows.withColumns({"_bad": F.max("_wrong").over(whole), "n_mismatch": F.count(F.when(undo & (F.col("_level") == 0), 1)).over(whole)})


_HELP = ["_sum", "_depth", "_low", "_level", "_wrong", "_bad"]


def _folded(rows: DataFrame) -> DataFrame:
    """(XID, order, n_mismatch) of the changes that stay in transactions with an undo that matches nothing.

    Such a transaction is an anomaly of the log. Its records are folded over one stack in one row, which holds some 60 bytes
    a record and nothing of the images, so some ten million records of one transaction are the limit here.
    """
    item = F.struct(*order_of(rows), "kind", "obj", "undo_kind")
    listed = rows.where(F.col("kind").isin(*CHANGES, "UNDO_LAST")).groupBy(*XID).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    inverse = F.create_map(*(F.lit(x) for pair in INVERSE.items() for x in pair))
    state = F.struct(F.array().cast("array<int>").alias("stack"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("missed"))

    def step(acc, x):
        top = F.get("_items", F.element_at(acc["stack"], -1))
        undo = x["kind"] == "UNDO_LAST"
        fits = (F.size(acc["stack"]) > 0) & inverse[top["kind"]].eqNullSafe(x["undo_kind"]) & top["obj"].eqNullSafe(x["obj"])
        stack = F.when(~undo, F.concat(acc["stack"], F.array(acc["at"]))).when(fits, F.slice(acc["stack"], 1, F.size(acc["stack"]) - 1)).otherwise(acc["stack"])
        return F.struct(stack.alias("stack"), (acc["at"] + 1).alias("at"), (acc["missed"] + (undo & ~fits).cast("long")).alias("missed"))

    done = listed.select(*XID, "_items", F.aggregate("_items", state, step).alias("_end"))
    kept = done.select(*XID, F.explode(F.transform("_end.stack", lambda k: F.get("_items", k))).alias("_x"), F.col("_end.missed").alias("n_mismatch"))
    return kept.select(*XID, *(F.col(f"_x.{c}").alias(c) for c in order_of(rows)), "n_mismatch")


def _live(rows: DataFrame, num: bool = False) -> DataFrame:
    """The changes of ``_stacked`` rows that stay, with ``n_mismatch`` and, if asked for, ``num`` in the transaction."""
    order = Window.partitionBy(*XID).orderBy(*order_of(rows))
    good = rows.where(~F.col("_bad") & F.col("kind").isin(*CHANGES) & (F.col("_low") >= F.col("_depth"))).drop(*_HELP)
    bad = rows.where("_bad").drop("n_mismatch").join(_folded(rows.where("_bad")), [*XID, *order_of(rows)]).drop(*_HELP)
    if num:
        good, bad = (x.withColumn("num", F.row_number().over(order) - 1) for x in (good, bad))
    return good.unionByName(bad)


def survivors(redo: DataFrame) -> DataFrame:
    """Changes that no savepoint rollback took back, with ``n_mismatch`` of their transaction.

    An undo record takes back the last change if it is its inverse (``undo_kind``) and names its object; one that isn't
    takes nothing back and is counted.
    """
    return _live(_stacked(redo.where(F.col("kind").isin(*CHANGES, "UNDO_LAST"))))


def commit_order(changes: DataFrame, tx: DataFrame) -> DataFrame:
    """Changes of emitted transactions with their place: ``commit_scn``, then ``num`` from 0."""
    order = Window.partitionBy(*XID).orderBy(*order_of(changes))
    # Every change of a committed transaction is needed; both sides hash on the same key.
    joined = changes.join(emitted(tx).select(*XID, "begin_scn", "commit_scn", "begin_ts", "end_ts"), XID)
    return joined.withColumn("num", F.row_number().over(order) - 1)


def committed_changes(redo: DataFrame, after_scn: int | None = None) -> DataFrame:
    """Surviving changes of emitted transactions with begin, commit, ``n_mismatch`` and ``num``.

    The same as ``commit_order(survivors(redo), transactions(redo))``, but the transaction's own columns
    come from frames over the sorted partition, so one shuffle serves all transactions whose undos match.
    """
    order = Window.partitionBy(*XID).orderBy(*order_of(redo))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = redo.withColumns({
        "begin_scn": F.min(_at(["BEGIN"], "scn")).over(whole),
        "commit_scn": F.max(_at(["COMMIT"], "scn")).over(whole),
        "_undone": F.max(F.when(F.col("kind") == "ROLLBACK", 1)).over(whole),
        "begin_ts": F.min(_at(["BEGIN"], "ts")).over(whole),
        "end_ts": F.max(_at(["COMMIT", "ROLLBACK"], "ts")).over(whole),
    })
    rows = rows.where("begin_scn IS NOT NULL AND commit_scn IS NOT NULL AND _undone IS NULL").drop("_undone")
    if after_scn is not None:
        rows = rows.where(F.col("commit_scn") > after_scn)
    return _live(_stacked(rows), num=True)


def ordered(changes: DataFrame) -> DataFrame:
    """Global commit order, by range partitions."""
    return changes.orderBy("commit_scn", *XID, "num")


def within_limit(redo: DataFrame, most_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(records of transactions up to the size, ids of larger ones)."""
    size = redo.groupBy(*XID).agg(F.sum("size").alias("bytes"))
    large = size.where(F.col("bytes") >= most_bytes)
    return redo.join(large.select(*XID), XID, "left_anti"), large


def skip(redo: DataFrame, ids: DataFrame) -> DataFrame:
    """Records without the transactions listed."""
    return redo.join(ids.select(*XID), XID, "left_anti")


def only(redo: DataFrame, ids: DataFrame) -> DataFrame:
    """Records of the transactions listed."""
    return redo.join(ids.select(*XID), XID, "left_semi")


def in_container(redo: DataFrame, con_id: int | None, column: str = "con_id") -> DataFrame:
    return redo if con_id is None else redo.where(F.col(column) == con_id)


def pair_vectors(redo: DataFrame) -> DataFrame:
    """An undo vector and the change that follows it in its record, as one row."""
    order = Window.partitionBy(*XID, "scn").orderBy("sub_scn")
    nxt = lambda c: F.lead(c).over(order)
    rows = redo.withColumns({"redo_kind": nxt("kind"), "redo_obj": nxt("obj"), "redo_sub_scn": nxt("sub_scn")})
    return rows.where((F.col("kind") == "UNDO") & F.col("redo_kind").isNotNull())


#: Ranges of change numbers that ``match_prefix`` deals transactions and ends into.
SLOT_RANGES = 4096


def match_prefix(ends: DataFrame, tx: DataFrame) -> DataFrame:
    """Ends with sequence 0 go to the transaction of the same slot that was open then (the last begun).

    Transactions are dealt into the ranges of change numbers that they span, an end into its own, and both meet by slot and range:
    an end sees the transactions of its slot around it, not all of them, and a slot is as many keys as there are ranges.
    """
    e = ends.where("sqn = 0").select(F.col("usn").alias("e_usn"), F.col("slt").alias("e_slt"), F.col("scn").alias("e_scn")).distinct()
    span = tx.agg(F.min("begin_scn").alias("low"), F.max(F.greatest("begin_scn", F.coalesce("end_scn", "begin_scn"))).alias("high")).first()
    low, high = span["low"] or 0, span["high"] or 0
    width = max(1, (high - low) // SLOT_RANGES + 1)
    # Ends before the first begin or after the last known number fall into the outer ranges.
    range_of = lambda c: F.floor((F.greatest(F.lit(low), F.least(F.lit(high), c)) - low) / width)
    open_tx = tx.where("begin_scn IS NOT NULL").withColumn("range", F.explode(F.sequence(range_of(F.col("begin_scn")), range_of(F.coalesce(F.greatest("begin_scn", "end_scn"), F.lit(high))))))
    hit = (F.col("usn") == F.col("e_usn")) & (F.col("slt") == F.col("e_slt")) & (F.col("range") == F.col("e_range"))
    hit &= (F.col("begin_scn") <= F.col("e_scn")) & (F.coalesce("end_scn", F.col("e_scn")) >= F.col("e_scn"))
    found = e.withColumn("e_range", range_of(F.col("e_scn"))).join(open_tx, hit, "left")
    best = F.max_by(F.struct("sqn", "begin_scn"), F.struct("begin_scn", "sqn"))
    return found.groupBy(F.col("e_usn").alias("usn"), F.col("e_slt").alias("slt"), F.col("e_scn").alias("scn")).agg(best["sqn"].alias("sqn"))


def to_parent(redo: DataFrame, children: DataFrame) -> DataFrame:
    """Records of a large-object child transaction move to its parent (``children``: sqn, parent_sqn)."""
    out = redo.join(children, ["usn", "slt", "sqn"], "left")
    return out.withColumn("sqn", F.coalesce("parent_sqn", "sqn")).drop("parent_sqn")


def split(changes: DataFrame, most_bytes: int) -> DataFrame:
    """``part`` of a transaction that would be too large for one message: a part ends where the next change could pass the limit.

    Sums restart at each cut, so cuts are found by a fold over the sizes of a transaction (some 30 bytes a change in one row).
    """
    order = Window.partitionBy(*XID).orderBy(*order_of(changes))
    rows = changes.withColumn("_n", F.row_number().over(order))
    listed = rows.groupBy(*XID).agg(F.array_sort(F.collect_list(F.struct("_n", F.col("size").cast("long").alias("size")))).alias("_sizes"))
    state = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("cuts"))

    def step(acc, x):
        full = (acc["sum"] > 0) & (acc["sum"] + x["size"] > most_bytes)
        return F.struct(F.when(full, x["size"]).otherwise(acc["sum"] + x["size"]).alias("sum"), F.when(full, F.concat(acc["cuts"], F.array(x["_n"]))).otherwise(acc["cuts"]).alias("cuts"))

    cuts = listed.select(*XID, F.aggregate("_sizes", state, step)["cuts"].alias("_cuts"))
    part = F.size(F.filter("_cuts", lambda c: c <= F.col("_n"))).cast("long")
    return rows.join(cuts, XID).withColumn("part", part).drop("_n", "_cuts")


def positions(messages: DataFrame) -> DataFrame:
    """``c_idx``: the count of messages since ``c_scn`` last changed, in order of ``id``.

    Runs are found inside ``seq`` (a log file) and carried over file borders by one row a file, so no
    task sees more than a file.
    """
    order = Window.partitionBy("seq").orderBy("id")
    rows = messages.withColumn("_new", F.coalesce((F.lag("c_scn").over(order) != F.col("c_scn")).cast("int"), F.lit(0)))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy("seq", "_run").orderBy("id")) - 1)
    files = rows.groupBy("seq").agg(
        F.min_by("c_scn", "id").alias("first"), F.max_by("c_scn", "id").alias("last"), F.max("_run").alias("runs"), F.max_by("_in", "id").alias("tail")
    )
    # One row a file from here on; a file that is one run and goes on the run before adds to it.
    line = Window.orderBy("seq")
    goes_on = (F.lag("last").over(line) == F.col("first")) & F.lag("last").over(line).isNotNull()
    files = files.withColumn("goes_on", F.coalesce(goes_on, F.lit(False)))
    files = files.withColumn("block", F.sum(F.when(F.col("goes_on") & (F.col("runs") == 0), 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    files = files.withColumn("held", F.sum(F.col("tail") + 1).over(inside))
    files = files.withColumn("carry", F.when(F.col("goes_on"), F.lag("held").over(line)).otherwise(0)).select("seq", "carry")
    out = rows.join(files, "seq")
    return out.withColumn("c_idx", (F.col("_in") + F.when(F.col("_run") == 0, F.col("carry")).otherwise(0)).cast("long")).drop("_new", "_run", "_in", "carry")


def message_positions(tx: DataFrame) -> DataFrame:
    """``first_idx`` of each transaction (``seq`` of its commit, ``begin_scn``, ``commit_scn``, ``n`` messages) in commit order.

    ``c_scn`` of a message is its transaction's begin; ``c_idx`` counts on while the next transaction begins at the same number.
    Runs are found inside ``seq`` and carried over by one row a file, as in ``positions``.
    """
    order = Window.partitionBy("seq").orderBy("commit_scn", *XID)
    rows = tx.withColumn("_new", F.coalesce((F.lag("begin_scn").over(order) != F.col("begin_scn")).cast("int"), F.lit(0)))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy("seq", "_run").orderBy("commit_scn", *XID).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("n").over(before), F.lit(0)))
    at = F.struct("commit_scn", *XID)
    files = rows.groupBy("seq").agg(F.min_by("begin_scn", at).alias("first"), F.max_by("begin_scn", at).alias("last"), F.max("_run").alias("runs"), F.max_by(F.col("_in") + F.col("n"), at).alias("tail"))
    line = Window.orderBy("seq")  # a row a file from here on
    goes_on = F.coalesce(F.lag("last").over(line) == F.col("first"), F.lit(False))
    files = files.withColumn("goes_on", goes_on)
    files = files.withColumn("block", F.sum(F.when(F.col("goes_on") & (F.col("runs") == 0), 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    files = files.withColumn("held", F.sum("tail").over(Window.partitionBy("block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    # A file of several runs that goes on the last one's run adds only its first run to that; what it holds for the next is its own tail.
    files = files.withColumn("carry", F.when(F.col("goes_on"), F.lag("held").over(line)).otherwise(0)).select("seq", "carry")
    out = rows.join(files, "seq")
    return out.withColumn("first_idx", F.col("_in") + F.when(F.col("_run") == 0, F.col("carry")).otherwise(0)).drop("_new", "_run", "_in", "carry")


def first_n(tx: DataFrame, n: int) -> DataFrame:
    """The first ``n`` emitted transactions in commit order (a stop rule, so the limit is the feature)."""
    return emitted(tx).orderBy("commit_scn", *XID).limit(n)
