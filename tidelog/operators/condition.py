"""The condition language of table rules, compiled to a column.

Strings ``'x'`` and attributes ``[name]`` compare by ``==`` and ``!=``; ``&&`` and ``||`` have one precedence and
associate to the left; ``!`` takes the next whole condition. ``[op]`` is the change's letter, ``[true]`` and ``[false]`` are
constants, any other name is a session attribute, empty where it is unknown.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<mark>[(),])|\[(?P<name>[^\]]*)\]|'(?P<text>[^']*)'|(?P<number>\d+(?:\.\d+)?)|(?P<op>[|&!=]+))")
#: Spellings of the manual beside those that a log holds.
ALIASES = {
    "current username": "current user name", "audit sessionid": "audit session id", "OS process name": "os program name",
    "OS process id": "os process id", "OS terminal": "os terminal",
}


class ConditionError(ValueError):
    """A condition that can't be read; the message says where."""


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ConditionError(f"unreadable at {at}: {text[at:at + 20]!r}")
        kind = m.lastgroup
        value = m[kind]
        if kind == "op" and value not in ("==", "!=", "&&", "||", "!"):
            raise ConditionError(f"unknown operator {value!r} at {m.start(kind)}")
        if kind == "number" or value == ",":
            raise ConditionError(f"{value!r} at {m.start(kind)} has no use")
        out.append((kind, value))
        at = m.end()
    return out


def compile_condition(text: str | None, op: Column, attributes: Column) -> Column:
    """A boolean column; no text means true."""
    if not text or not text.strip():
        return F.lit(True)
    rest = tokens(text)

    def take(value=None):
        if not rest:
            raise ConditionError("the condition ends too early")
        kind, got = rest.pop(0)
        if value is not None and got != value:
            raise ConditionError(f"{value!r} wanted, {got!r} found")
        return kind, got

    def string() -> Column:
        kind, value = take()
        if kind == "text":
            return F.lit(value)
        if kind != "name" or value in ("true", "false"):
            raise ConditionError(f"a string wanted, {value!r} found")
        if value == "op":
            return op
        return F.coalesce(F.element_at(attributes, F.lit(ALIASES.get(value, value))), F.lit(""))

    def unit() -> Column:
        if not rest:
            raise ConditionError("the condition ends too early")
        kind, value = rest[0]
        if value == "!" and kind == "op":
            take()
            return ~unit()
        if value == "(" and kind == "mark":
            take()
            inside = chain()
            take(")")
            return inside
        if kind == "name" and value in ("true", "false"):
            take()
            return F.lit(value == "true")
        left = string()
        kind, sign = take()
        if kind != "op" or sign not in ("==", "!="):
            raise ConditionError(f"a comparison wanted, {sign!r} found")
        right = string()
        # The letter of an insert may be written c or i.
        if left is op or right is op:
            left, right = (F.when(x == "i", "c").otherwise(x) for x in (left, right))
        return left == right if sign == "==" else left != right

    def chain() -> Column:
        out = unit()
        while rest and rest[0][0] == "op" and rest[0][1] in ("&&", "||"):
            _, sign = take()
            right = unit()
            out = out & right if sign == "&&" else out | right
        return out

    found = chain()
    if rest:
        raise ConditionError(f"{rest[0][1]!r} is left over")
    return found
