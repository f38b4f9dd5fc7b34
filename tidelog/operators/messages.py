"""Output messages: header, schema block, payload, and what surrounds a transaction."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import formats, ids
from tidelog.operators.transactions import XID


@dataclass
class FormatOptions:
    """Options of the text format, by the names of the configuration; all default to 0."""

    db: int = 0
    attributes: int = 0
    interval_dts: int = 0
    interval_ytm: int = 0
    message: int = 0
    rid: int = 0
    redo_thread: int = 0
    xid: int = 0
    timestamp: int = 0
    timestamp_metadata: int = 0
    timestamp_tz: int = 0
    timestamp_type: int = 0
    char: int = 0
    scn: int = 0
    scn_type: int = 0
    unknown: int = 0
    schema: int = 0
    column: int = 0
    unknown_type: int = 0
    user_type: int = 0
    database: str = ""
    extra: dict = field(default_factory=dict)

    @classmethod
    def debezium(cls, **over) -> FormatOptions:
        """The preset that Debezium consumers expect; later options override it."""
        preset = {
            "column": 2, "db": 3, "interval_dts": 9, "interval_ytm": 4, "message": 2, "redo_thread": 1, "rid": 1, "schema": 7,
            "scn_type": 14, "timestamp_type": 14, "timestamp_metadata": 2, "user_type": 15, "xid": 3,
        }
        return cls(**{**preset, **over})


def _quote(text: Column) -> Column:
    """A JSON string, by the engine's own encoder; a null text is a JSON null."""
    return F.when(text.isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.struct(text.alias("v"))), r'^\{"v":|\}$', ""))


class JsonObject:
    """Ordered members, some of them conditional, as one column of JSON text."""

    def __init__(self):
        self.parts: list[Column] = []

    def add(self, name: str, value: Column, text: bool = True, when: Column | None = None, plain: bool = False) -> JsonObject:
        """``plain`` texts hold nothing that JSON escapes, so quotes around them are enough."""
        quoted = F.concat(F.lit('"'), value, F.lit('"')) if plain else _quote(value)
        body = F.concat(F.lit(f'"{name}":'), quoted if text else value.cast("string"))
        self.parts.append(F.when(when, body) if when is not None else body)
        return self

    def column(self) -> Column:
        return F.concat(F.lit("{"), F.concat_ws(",", *self.parts), F.lit("}"))


def image_json(image: Column) -> Column:
    """Names in order; nulls kept, absent names left out."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(image))))


def header(options: FormatOptions, kind: str) -> JsonObject:
    """The members that lead a message, of columns scn, begin_scn, commit_scn, ts_s, begin_s, commit_s, c_scn, c_idx, xid parts, user, thread.

    ``kind`` is begin, dml, commit, ddl or chkpt; the first message of a transaction always has number and time.
    """
    out = JsonObject()
    first = kind in ("begin", "chkpt")
    scn = F.col("commit_scn") if options.scn_type & 1 and kind != "chkpt" else F.col("scn")
    hexed = options.scn == 1
    names = {"scn": scn, "b_scn": F.col("begin_scn"), "e_scn": F.col("commit_scn")}
    for name, value, show in (("scn", names["scn"], first or options.scn_type & 4), ("b_scn", names["b_scn"], options.scn_type & 2 and kind != "chkpt"), ("e_scn", names["e_scn"], options.scn_type & 8 and kind != "chkpt")):
        if show:
            out.add(name + "s" if hexed else name, ids.scn_text(value, 1 if hexed else 0), text=hexed, plain=True)
    mode = options.timestamp_metadata
    text = formats.is_text(mode)
    ts = F.col("commit_s") if options.timestamp_type & 1 and kind != "chkpt" else F.col("ts_s")
    for name, value, show in (("tm", ts, first or options.timestamp_type & 4), ("b_tm", F.col("begin_s"), options.timestamp_type & 2 and kind != "chkpt"), ("e_tm", F.col("commit_s"), options.timestamp_type & 8 and kind != "chkpt")):
        if show:
            out.add(name + "s" if text else name, formats.timestamp(value, F.lit(0).cast("long"), mode), text=text, plain=True)
    out.add("c_scn", F.col("c_scn"), text=False).add("c_idx", F.col("c_idx"), text=False)
    if kind != "chkpt":
        out.add("xidn" if options.xid == 2 else "xid", ids.xid_text(F.col("usn"), F.col("slt"), F.col("sqn"), options.xid), text=options.xid != 2, plain=True)
    if options.db & (2 if kind == "ddl" else 1):
        out.add("db", F.lit(json.dumps(options.database)), text=False)
    if options.user_type & {"begin": 1, "dml": 2, "commit": 4, "ddl": 8, "chkpt": 0}[kind]:
        out.add("usr", F.coalesce("user", F.lit("")))
    if options.redo_thread:
        out.add("rth", F.col("thread"), text=False)
    return out


def schema_block(options: FormatOptions) -> Column:
    """``{"owner","table"[,"obj"][,"columns"]}``; columns once for each table unless repeated (needs ``first_of_obj``)."""
    out = JsonObject().add("owner", F.col("owner")).add("table", F.col("name"))
    if options.schema & 4:
        out.add("obj", F.col("obj"), text=False)
    if options.schema & 1:
        show = F.col("columns_json").isNotNull()
        if not options.schema & 2:
            show = show & F.col("first_of_obj")
        out.add("columns", F.col("columns_json"), text=False, when=show)
    return out.column()


#: Type numbers of columns, their names in a schema block, and what is said of them besides.
COLUMN_TYPES = {
    1: ("varchar2", "length"), 2: ("number", "precision"), 8: ("long", ""), 12: ("date", ""), 23: ("raw", "length"), 24: ("long raw", ""), 96: ("char", "length"),
    100: ("binary_float", ""), 101: ("binary_double", ""), 112: ("clob", ""), 113: ("blob", ""), 180: ("timestamp", "length"), 181: ("timestamp with time zone", "length"),
    182: ("interval year to month", "length"), 183: ("interval day to second", "length"), 208: ("urowid", "length"), 231: ("timestamp with local time zone", "length"),
}


def columns_json(columns: Column) -> Column:
    """The columns of a schema block, of an array of (name, type, length, precision, scale, nullable) in order."""

    def one(c: Column) -> Column:
        name, more = F.lit("unknown"), F.lit("")
        for number, (text, kind) in COLUMN_TYPES.items():
            name = F.when(c["type"] == number, text).otherwise(name)
            if kind == "length":
                more = F.when(c["type"] == number, F.concat(F.lit(',"length":'), c["length"].cast("string"))).otherwise(more)
            elif kind == "precision":
                more = F.when(c["type"] == number, F.concat(F.lit(',"precision":'), c["precision"].cast("string"), F.lit(',"scale":'), c["scale"].cast("string"))).otherwise(more)
        return F.concat(F.lit('{"name":'), _quote(c["name"]), F.lit(',"type":"'), name, F.lit('"'), F.coalesce(more, F.lit("")), F.lit(',"nullable":'), c["nullable"].cast("string"), F.lit("}"))

    return F.concat(F.lit("["), F.array_join(F.transform(columns, one), ","), F.lit("]"))


def first_of_obj(changes: DataFrame, order: list[str], bounded: bool = False) -> DataFrame:
    """``first_of_obj``: whether a message is the first of its table by ``order``, which must tell messages apart.

    One row a table is aggregated and joined (a null table counts as one). With ``bounded`` the caller knows that there are no
    more tables than may be broadcast, and the messages aren't shuffled.
    """
    firsts = changes.groupBy(F.col("obj").alias("_obj")).agg(F.min(F.struct(*order)).alias("_first"))
    joined = changes.join(F.broadcast(firsts) if bounded else firsts, F.col("obj").eqNullSafe(F.col("_obj")))
    return joined.withColumn("first_of_obj", F.struct(*order).eqNullSafe(F.col("_first"))).drop("_first", "_obj")


def dml(changes: DataFrame, options: FormatOptions) -> DataFrame:
    """``body`` of row changes: op, schema, num, row id, before and after (JSON text columns or null)."""
    payload = JsonObject().add("op", F.col("op"), plain=True)
    if options.message & 16:
        payload.add("offset", F.col("offset"), text=False)
    payload.add("schema", schema_block(options), text=False)
    if options.message & 2:
        payload.add("num", F.col("num"), text=False)
    if options.rid:
        payload.add("rid", F.col("rid"), plain=True)
    payload.add("before", F.col("before_json"), text=False, when=F.col("before_json").isNotNull() & (F.col("op") != "c"))
    payload.add("after", F.col("after_json"), text=False, when=F.col("after_json").isNotNull() & (F.col("op") != "d"))
    if options.attributes & 2:
        payload.add("attrs", F.col("attrs_json"), text=False, when=F.col("attrs_json").isNotNull())
    changes = changes.withColumn("payload", payload.column())
    if options.message & 1:
        return changes
    return changes.withColumn("body", header(options, "dml").add("payload", F.concat(F.lit("["), "payload", F.lit("]")), text=False).column())


def around(tx: DataFrame, options: FormatOptions, kind: str) -> DataFrame:
    """Begin or commit messages (columns of the header)."""
    return tx.withColumn("body", header(options, kind).add("payload", F.lit(f'[{{"op":"{kind}"}}]'), text=False).column())


def checkpoints(lwns: DataFrame, options: FormatOptions) -> DataFrame:
    """Checkpoint messages of ``seq, offset`` with header columns; ``redo`` marks a log switch."""
    payload = JsonObject().add("op", F.lit("chkpt")).add("seq", F.col("seq"), text=False).add("offset", F.col("offset"), text=False).add("redo", F.lit("true"), text=False, when=F.col("redo"))
    return lwns.withColumn("body", header(options, "chkpt").add("payload", F.concat(F.lit("["), payload.column(), F.lit("]")), text=False).column())


def ddl(rows: DataFrame, options: FormatOptions) -> DataFrame:
    payload = JsonObject().add("op", F.lit("ddl")).add("schema", schema_block(options), text=False).add("sql", F.col("sql_text"))
    return rows.withColumn("body", header(options, "ddl").add("payload", F.concat(F.lit("["), payload.column(), F.lit("]")), text=False).column())


def one_message(changes: DataFrame, options: FormatOptions) -> DataFrame:
    """One message for a transaction: its payloads in order of ``num`` (split large ones first, see ``transactions.split``)."""
    keys = [*XID, "begin_scn", "commit_scn", "begin_s", "commit_s"]
    extra = [c for c in ("part", "user", "thread") if c in changes.columns]
    payloads = F.array_sort(F.collect_list(F.struct("num", "payload")))
    tx = changes.groupBy(*keys, *extra).agg(F.array_join(F.transform(payloads, lambda p: p["payload"]), ",").alias("payloads"), F.count("*").alias("n_changes"))
    tx = tx.withColumns({"scn": F.col("begin_scn"), "ts_s": F.col("begin_s"), "c_scn": F.col("begin_scn"), "c_idx": F.lit(0)})
    return tx.withColumn("body", header(options, "begin").add("payload", F.concat(F.lit("["), "payloads", F.lit("]")), text=False).column())


#: Type codes of DDL statements.
DDL_CLASSES = {"create": (1, 4, 9), "truncate": (85,), "drop": (8, 12), "alter": (15, 11), "purge": (198,)}


def ddl_class(code: Column) -> Column:
    out = F.lit("other")
    for name, codes in DDL_CLASSES.items():
        out = F.when(code.isin(*codes), name).otherwise(out)
    return out


def ddl_text(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Statement text of numbered chunks; chunk 1 is the schema's name. A statement counts once all chunks are there."""
    ordered = F.array_sort(F.collect_list(F.struct("seq_no", "chunk")))
    out = chunks.groupBy(*keys).agg(ordered.alias("c"), F.max("n_chunks").alias("n_chunks"))
    whole = out.where(F.size("c") == F.col("n_chunks"))
    return whole.select(*keys, F.element_at("c", 1)["chunk"].alias("schema_name"), F.array_join(F.transform(F.filter("c", lambda x: x["seq_no"] > 1), lambda x: x["chunk"]), "").alias("sql_text"))


def attributes(pieces: DataFrame) -> DataFrame:
    """The session attributes of each transaction: of repeated names the last wins; names are a known few."""
    last = pieces.groupBy(*XID, "name").agg(F.max_by("value", "pos").alias("value"))
    return last.groupBy(*XID).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("attrs"))


def message_order(messages: DataFrame) -> DataFrame:
    order = Window.partitionBy(*XID).orderBy("scn", "place")
    return messages.withColumn("num", F.row_number().over(order) - 1)
