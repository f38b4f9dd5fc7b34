"""Identifiers as columns: system change number, transaction id, row id, packed log time, offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: digits of a row id.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def hex_of(value: Column, digits: int) -> Column:
    """Lower-case hexadecimal, filled up with zeros."""
    return F.lower(F.lpad(F.hex(value), digits, "0"))


def scn_text(scn: Column, mode: int = 0) -> Column:
    """0: decimal; 1: ``0x`` and 16 digits; 2: ``0xWWWW.BBBBBBBB``."""
    if mode == 0:
        return scn.cast("string")
    if mode == 1:
        return F.concat(F.lit("0x"), hex_of(scn, 16))
    low = F.lit((1 << 32) - 1)
    return F.concat(F.lit("0x"), hex_of(F.shiftright(scn, 32), 4), F.lit("."), hex_of(scn.bitwiseAND(low), 8))


def xid_pack(usn: Column, slt: Column, sqn: Column) -> Column:
    """The 64-bit number of a transaction id."""
    return F.shiftleft(usn.cast("long"), 48).bitwiseOR(F.shiftleft(slt.cast("long"), 32)).bitwiseOR(sqn.cast("long"))


def _swapped(value: Column, digits: int) -> Column:
    text = F.lpad(F.hex(value), digits, "0")
    return F.lower(F.concat(*(F.substring(text, digits - 1 - 2 * k, 2) for k in range(digits // 2))))


def xid_text(usn: Column, slt: Column, sqn: Column, mode: int = 0) -> Column:
    """0: dotted hexadecimal; 1: dotted decimal; 2: the packed number; 3: bytes in reverse order."""
    if mode == 0:
        return F.concat(F.lit("0x"), hex_of(usn, 4), F.lit("."), hex_of(slt, 3), F.lit("."), hex_of(sqn, 8))
    if mode == 1:
        return F.concat_ws(".", usn.cast("string"), slt.cast("string"), sqn.cast("string"))
    if mode == 2:
        return xid_pack(usn, slt, sqn).cast("string")
    return F.concat(_swapped(usn, 4), _swapped(slt, 4), _swapped(sqn, 8))


_XID = r"^(?:([0-9A-Fa-f]{4})([0-9A-Fa-f]{4})([0-9A-Fa-f]{8})|(?:0x)?([0-9A-Fa-f]{4})\.([0-9A-Fa-f]{3,4})\.([0-9A-Fa-f]{8}))$"


def xid_parse(text: Column) -> Column:
    """Struct (usn, slt, sqn) of any of the five spellings; null if it is none of them."""
    part = lambda a, b: F.conv(F.concat(F.regexp_extract(text, _XID, a), F.regexp_extract(text, _XID, b)), 16, 10).cast("long")
    return F.when(text.rlike(_XID), F.struct(part(1, 4).alias("usn"), part(2, 5).alias("slt"), part(3, 6).alias("sqn")))


def _digits(value: Column, n: int) -> Column:
    return F.concat(*(F.substring(F.lit(ALPHABET), F.shiftright(value, 6 * k).bitwiseAND(F.lit(63)).cast("int") + 1, F.lit(1)) for k in range(n - 1, -1, -1)))


def rowid_text(data_obj: Column, dba: Column, slot: Column) -> Column:
    """18 characters: object, file, block and slot."""
    afn, block = F.shiftright(dba, 22), dba.bitwiseAND(F.lit(0x3FFFFF))
    return F.concat(_digits(data_obj, 6), _digits(afn, 3), _digits(block, 6), _digits(slot, 3))


def rowid_hex(data_obj: Column, dba: Column, slot: Column) -> Column:
    """``block.object.slot`` in hexadecimal; the object's low 16 bits only."""
    low = F.lit(0xFFFF).cast("long")
    return F.concat_ws(".", hex_of(dba, 8), hex_of(data_obj.bitwiseAND(low), 4), hex_of(slot, 4))


def _number(text: Column, start: int, n: int) -> Column:
    total = F.lit(0).cast("long")
    for k in range(n):
        total = total * 64 + (F.position(F.substring(text, start + k, 1), F.lit(ALPHABET)) - 1).cast("long")
    return total


def rowid_parse(text: Column) -> Column:
    """Struct (data_obj, dba, slot) of an 18-character row id; null if it isn't one."""
    dba = F.shiftleft(_number(text, 7, 3), 22).bitwiseOR(_number(text, 10, 6))
    good = text.rlike("^[A-Za-z0-9+/]{18}$")
    return F.when(good, F.struct(_number(text, 1, 6).alias("data_obj"), dba.alias("dba"), _number(text, 16, 3).alias("slot")))


def log_time(packed: Column) -> Column:
    """Epoch seconds (of the host's clock) of a packed time: mixed radix, months of 31 days, from 1988."""
    t = packed.cast("long")
    sec, t = t % 60, F.floor(t / 60)
    minute, t = t % 60, F.floor(t / 60)
    hour, t = t % 24, F.floor(t / 24)
    day, t = t % 31 + 1, F.floor(t / 31)
    month, year = t % 12 + 1, F.floor(t / 12) + 1988
    # Days that a month doesn't have run on into the next one.
    first = F.make_date(year.cast("int"), month.cast("int"), F.lit(1))
    days = F.datediff(first, F.lit("1970-01-01").cast("date")) + day - 1
    return ((days.cast("long") * 24 + hour) * 60 + minute) * 60 + sec


def zone_seconds(text: Column) -> Column:
    """Seconds of ``+HH:MM``, ``-HH:MM`` or ``+H:MM``; null for anything else."""
    form = r"^([+-])(\d{1,2}):(\d{2})$"
    get = lambda k: F.regexp_extract(text, form, k)
    h, m = get(2).try_cast("int"), get(3).try_cast("int")
    sign = F.when(get(1) == "-", -1).otherwise(1)
    return F.when(text.rlike(form) & (h <= 15) & (m < 60), (sign * (h * 3600 + m * 60)).cast("long"))
