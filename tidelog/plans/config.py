"""The JSON configuration: sections, types, bounds and defaults, checked before anything runs."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from tidelog.operators.messages import FormatOptions

VERSION = "1.9.0"


class ConfigError(ValueError):
    """A configuration that can't be used; the message names the key and what it may be."""


@dataclass(frozen=True)
class Number:
    default: int | None = 0
    low: int = 0
    high: int = 2**64 - 1

    def check(self, key: str, value):
        if isinstance(value, bool) or not isinstance(value, int) or not self.low <= value <= self.high:
            raise ConfigError(f"{key}: {value!r}, expected a whole number from {self.low} to {self.high}")
        return value


@dataclass(frozen=True)
class Text:
    default: str | None = ""
    one_of: tuple[str, ...] = ()
    form: str = ""
    most: int = 2048

    def check(self, key: str, value):
        if not isinstance(value, str) or len(value) > self.most:
            raise ConfigError(f"{key}: {value!r}, expected a text of up to {self.most} characters")
        if self.one_of and value not in self.one_of:
            raise ConfigError(f"{key}: {value!r}, expected one of {', '.join(self.one_of)}")
        if self.form and not re.fullmatch(self.form, value):
            raise ConfigError(f"{key}: {value!r}, expected the form {self.form}")
        return value


@dataclass(frozen=True)
class Texts:
    default: tuple = ()

    def check(self, key: str, value):
        if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
            raise ConfigError(f"{key}: expected a list of texts")
        return list(value)


#: Bits of ``source.flags``.
FLAGS = {
    "arch_only": 1 << 0, "schemaless": 1 << 1, "adaptive_schema": 1 << 2, "direct_disable": 1 << 3, "ignore_data_errors": 1 << 4, "show_ddl": 1 << 5, "show_hidden_columns": 1 << 6,
    "show_guard_columns": 1 << 7, "show_nested_columns": 1 << 8, "show_unused_columns": 1 << 9, "show_incomplete_transactions": 1 << 10, "show_system_transactions": 1 << 11,
    "show_checkpoint": 1 << 12, "checkpoint_keep": 1 << 13, "verify_schema": 1 << 14, "raw_column_data": 1 << 15, "experimental_xmltype": 1 << 16, "experimental_json": 1 << 17,
    "experimental_not_null_missing": 1 << 18,
}
ZONE = r"[+-]\d{1,2}:\d{2}"
#: Keys of each section with their bounds and defaults.
SECTIONS: dict[str, dict] = {
    "memory": {
        "min-mb": Number(32, 16), "max-mb": Number(2048, 16), "swap-mb": Number(None), "swap-path": Text("."), "read-buffer-min-mb": Number(4), "read-buffer-max-mb": Number(None),
        "write-buffer-min-mb": Number(4), "write-buffer-max-mb": Number(None), "unswap-buffer-min-mb": Number(4),
    },
    "metrics": {"type": Text(None, ("prometheus",)), "bind": Text(""), "tag-names": Text("none", ("none", "filter", "sys", "all"))},
    "state": {"type": Text("disk", ("disk",)), "path": Text("checkpoint"), "interval-s": Number(600), "interval-mb": Number(500), "keep-checkpoints": Number(100), "schema-force-interval": Number(20)},
    "reader": {
        "type": Text(None, ("online", "offline", "batch")), "disable-checks": Number(0, 0, 15), "start-scn": Number(None), "start-seq": Number(None, 0, 2**32 - 1), "start-time-rel": Number(None), "start-time": Text(None, form=r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d"),
        "db-timezone": Text(None, form=ZONE), "host-timezone": Text(None, form=ZONE), "log-timezone": Text(None, form=ZONE), "user": Text(""), "password": Text(""), "server": Text(""), "con-id": Number(None, 0, 32767),
        "path-mapping": Texts(), "redo-copy-path": Text(""), "redo-log": Texts(), "log-archive-format": Text("o1_mf_%t_%s_%h_.arc"),
    },
    "debug": {"stop-log-switches": Number(), "stop-checkpoints": Number(), "stop-transactions": Number(), "owner": Text(""), "table": Text("")},
    "format": {
        "type": Text("json", ("json", "protobuf", "debezium")), "db": Number(0, 0, 3), "attributes": Number(0, 0, 7), "interval-dts": Number(0, 0, 10), "interval-ytm": Number(0, 0, 4), "message": Number(0, 0, 31), "rid": Number(0, 0, 1),
        "redo-thread": Number(0, 0, 1), "xid": Number(0, 0, 3), "timestamp": Number(0, 0, 15), "timestamp-metadata": Number(0, 0, 15), "timestamp-tz": Number(0, 0, 11), "timestamp-type": Number(0, 0, 15), "user-type": Number(0, 0, 15),
        "char": Number(0, 0, 3), "scn": Number(0, 0, 1), "scn-type": Number(0, 0, 15), "unknown": Number(0, 0, 1), "schema": Number(0, 0, 7), "column": Number(0, 0, 2), "unknown-type": Number(0, 0, 1), "flush-buffer": Number(1048576),
    },
    "source": {
        "alias": Text(None), "name": Text(None), "flags": Number(0, 0, 524287), "transaction-max-mb": Number(0), "redo-read-sleep-us": Number(50_000), "arch-read-sleep-us": Number(10_000_000), "arch-read-tries": Number(10, 1, 1_000_000_000),
        "redo-verify-delay-us": Number(0), "refresh-interval-us": Number(10_000_000), "arch": Text("path", ("path", "online", "online-keep", "list")),
    },
    "table": {"owner": Text(None), "table": Text(None), "key": Text(""), "tag": Text(""), "condition": Text("")},
    "filter": {"separator": Text(","), "skip-xid": Texts(), "dump-xid": Texts()},
    "writer": {
        "type": Text(None, ("file", "kafka", "zeromq", "network", "discard")), "output": Text(""), "new-line": Number(0, 0, 2), "append": Number(1, 0, 1), "max-file-size": Number(0), "timestamp-format": Text("%F_%T"), "topic": Text(""),
        "uri": Text(""), "max-message-mb": Number(100, 1, 953), "poll-interval-us": Number(100_000, 100, 3_600_000_000), "queue-size": Number(65536, 1, 1_000_000), "write-buffer-flush-size": Number(1048576, 0, 1048576), "properties": Texts(),
    },
    "root": {"version": Text(None), "dump-path": Text("."), "dump-raw-data": Number(0, 0, 1), "dump-redo-log": Number(0, 0, 2), "log-level": Number(3, 0, 4), "trace": Number(0, 0, 2**20 - 1)},
}


def section(name: str, data, inner: tuple[str, ...] = (), required: tuple[str, ...] = ()) -> dict:
    """Values of a section with defaults; unknown keys and values out of bounds are errors."""
    if not isinstance(data, dict):
        raise ConfigError(f"{name}: expected an object")
    keys = SECTIONS[name]
    unknown = sorted(set(data) - set(keys) - set(inner))
    if unknown:
        raise ConfigError(f"{name}: unknown {', '.join(unknown)}")
    missing = [k for k in required if k not in data]
    if missing:
        raise ConfigError(f"{name}: {', '.join(missing)} is missing")
    return {k: kind.check(f"{name}.{k}", data[k]) if k in data else (list(kind.default) if isinstance(kind, Texts) else kind.default) for k, kind in keys.items()}


@dataclass
class Config:
    root: dict
    memory: dict
    state: dict
    metrics: dict | None
    source: dict
    reader: dict
    debug: dict
    format: FormatOptions
    format_type: str
    tables: list[dict]
    filter: dict
    writer: dict
    extra: dict = field(default_factory=dict)

    def flag(self, name: str) -> bool:
        return bool(self.source["flags"] & FLAGS[name])


def _one(document: dict, name: str) -> dict:
    found = document.get(name)
    if not isinstance(found, list) or len(found) != 1:
        raise ConfigError(f"{name}: expected a list of one element")
    return found[0]


def parse(text: str) -> Config:
    """A checked configuration of a JSON text."""
    try:
        document = json.loads(text)
    except ValueError as e:
        raise ConfigError(f"not JSON: {e}") from None
    root = section("root", document, ("memory", "metrics", "source", "state", "target"), ("version",))
    if root["version"] != VERSION:
        raise ConfigError(f"version: {root['version']!r}, expected {VERSION}")
    memory = section("memory", document.get("memory", {}))
    for low, high in (("min-mb", "max-mb"), ("read-buffer-min-mb", "read-buffer-max-mb"), ("write-buffer-min-mb", "write-buffer-max-mb")):
        if memory[high] is not None and memory[low] > memory[high]:
            raise ConfigError(f"memory.{low}: {memory[low]} is more than {high}")
    source_in, target = _one(document, "source"), _one(document, "target")
    source = section("source", source_in, ("reader", "format", "filter", "debug", "memory"), ("alias", "name", "reader", "format"))
    reader = section("reader", source_in["reader"], (), ("type",))
    starts = [k for k in ("start-scn", "start-seq", "start-time-rel", "start-time") if reader[k] is not None]
    if "start-time" in starts and "start-time-rel" in starts:
        raise ConfigError("reader: start-time and start-time-rel exclude each other")
    if reader["type"] == "batch" and not reader["redo-log"]:
        raise ConfigError("reader: a batch needs redo-log")
    mapping = reader["path-mapping"]
    if len(mapping) % 2:
        raise ConfigError("reader.path-mapping: expected pairs")
    fmt = section("format", source_in["format"], (), ("type",))
    if fmt["message"] & 1 and fmt["message"] & 12:
        raise ConfigError("format.message: one message a transaction has no begin or commit to skip")
    given = {k.replace("-", "_"): fmt[k] for k in source_in["format"] if k not in ("type", "flush-buffer")}
    build = FormatOptions.debezium if fmt["type"] == "debezium" else FormatOptions
    filter_in = source_in.get("filter", {})
    tables = [section("table", t, (), ("owner", "table")) for t in filter_in.get("table", [])]
    if target.get("source") != source["alias"]:
        raise ConfigError(f"target.source: {target.get('source')!r} is no source's alias")
    writer = section("writer", target.get("writer", {}), (), ("type",))
    if writer["type"] == "file" and writer["max-file-size"] and not re.search(r"%(\d*i|s|t)", writer["output"]):
        raise ConfigError("writer.output: rotation needs %i, %t or %s in the name")
    return Config(
        root=root, memory=memory, state=section("state", document.get("state", {})), metrics=section("metrics", document["metrics"], (), ("type", "bind")) if "metrics" in document else None,
        source=source, reader=reader, debug=section("debug", source_in.get("debug", {})), format=build(database=source["name"], **given), format_type=fmt["type"], tables=tables,
        filter=section("filter", filter_in, ("table",)), writer=writer,
    )
