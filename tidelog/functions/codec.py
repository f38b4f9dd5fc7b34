"""Decoders of stored bytes, as column functions over ``BinaryType``.

All but XML stay in the JVM. A value that can't be decoded is null here; ``or_unknown`` writes ``?``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def byte(data: Column, at: int | Column) -> Column:
    """The unsigned byte at a place (from 0)."""
    place = (at if isinstance(at, Column) else F.lit(at)) + 1
    return F.conv(F.hex(F.substring(data, place, F.lit(1))), 16, 10).cast("int")


def big_endian(data: Column, at: int, n: int) -> Column:
    return F.conv(F.hex(F.substring(data, at + 1, n)), 16, 10).cast("long")


def bytes_of(data: Column) -> Column:
    """An array of the unsigned bytes."""
    return F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda k: F.conv(F.hex(F.substring(data, k, F.lit(1))), 16, 10).cast("int"))


def number(data: Column) -> Column:
    """Exact decimal text of a base-100 number, up to any exponent.

    The first byte holds sign and exponent, the others digit pairs: plus one if positive, taken from 101 if
    negative, where a byte of 102 ends them.
    """
    size, first = F.octet_length(data), byte(data, 0)
    negative = first < 0x80

    def text(raw: Column) -> Column:
        pairs = F.transform(raw, lambda b: F.lpad(F.when(negative, 101 - b).otherwise(b - 1).cast("string"), 2, "0"))
        fine = (size >= 2) & F.forall(raw, lambda b: F.when(negative, (b >= 2) & (b <= 101)).otherwise((b >= 1) & (b <= 100)))
        return F.when(fine, let(F.array_join(pairs, ""), placed))

    def placed(digits: Column) -> Column:
        whole = F.when(negative, 0x3F - first).otherwise(first - 0xC0)  # pairs before the decimal point
        filled = F.when(whole <= 0, F.concat(F.repeat(F.lit("00"), -whole), digits)).otherwise(F.rpad(digits, F.greatest(F.length(digits), 2 * whole), F.lit("0")))
        cut = F.greatest(F.lit(0), 2 * whole)
        parts = lambda x: F.struct(
            F.regexp_replace(F.substring(x, F.lit(1), cut), "^0+", "").alias("left"), F.regexp_replace(F.substring(x, cut + 1, F.length(x)), "0+$", "").alias("right")
        )
        return let(filled, lambda x: let(parts(x), joined))

    def joined(p: Column) -> Column:
        return F.concat(
            F.when(negative, "-").otherwise(""), F.when(p["left"] == "", "0").otherwise(p["left"]), F.when(p["right"] == "", "").otherwise(F.concat(F.lit("."), p["right"]))
        )

    raw = F.transform(F.sequence(F.lit(2), F.greatest(size, F.lit(2))), lambda k: F.conv(F.hex(F.substring(data, k, F.lit(1))), 16, 10).cast("int"))
    kept = F.filter(raw, lambda b: b.isNotNull() & ~(negative & (b == 102)))
    return F.when((size == 1) & (first == 0x80), "0").otherwise(let(kept, text))


@F.pandas_udf(T.DoubleType())
def _double(data: pd.Series) -> pd.Series:
    """Order-preserving doubles and floats: the sign bit is turned, or all bits where it was clear."""
    out, size = pd.Series(np.nan, index=data.index, dtype="float64"), data.map(len, na_action="ignore")
    for n, whole, kind in ((8, ">u8", ">f8"), (4, ">u4", ">f4")):
        some = data[size == n]
        if len(some):
            bits = np.frombuffer(b"".join(some), whole)
            top = np.array(1 << (8 * n - 1), whole)
            turned = np.where(bits & top, bits ^ top, ~bits).astype(whole)
            out[some.index] = turned.view(kind).astype("float64")
    return out.astype(object).where(size.isin([4, 8]), None)


def binary_double(data: Column) -> Column:
    """The value of a binary float (4 bytes) or double (8 bytes), with infinities and NaN."""
    return _double(data)


def epoch_seconds(data: Column) -> Column:
    """Epoch seconds of a date in 7 bytes: century and year in excess of 100, then month, day, time plus one."""
    century, year = byte(data, 0), byte(data, 1)
    full = (century - 100) * 100 + (year - 100)
    month, day = byte(data, 2), byte(data, 3)
    hour, minute, second = byte(data, 4) - 1, byte(data, 5) - 1, byte(data, 6) - 1
    # There is no year 0: the year before 1 is -1, which counts as 0 here.
    astronomical = F.when(full < 0, full + 1).otherwise(full)
    fine = full.between(-4712, 9999) & (full != 0) & month.between(1, 12) & day.between(1, 31) & hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    date = F.expr("CAST(NULL AS DATE)")
    date = F.when(fine & (day <= F.day(F.last_day(_date(astronomical, month, F.lit(1))))), F.date_add(_date(astronomical, month, F.lit(1)), day - 1)).otherwise(date)
    days = F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long")
    return ((days * 24 + hour) * 60 + minute) * 60 + second


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.make_date(F.greatest(year, F.lit(-4711)), F.when(month.between(1, 12), month).otherwise(1), day)


def nanos(data: Column, at: int = 7) -> Column:
    """Nanoseconds of the 4 bytes behind a date, 0 where there are none, null where they are too many."""
    part = big_endian(data, at, 4)
    return F.when(F.octet_length(data) < at + 4, F.lit(0).cast("long")).when(part < 1_000_000_000, part)


def timestamp(data: Column) -> Column:
    """Struct (seconds, nanos) of a date or timestamp in 7 or 11 bytes."""
    good = F.octet_length(data).isin(7, 11) & epoch_seconds(data).isNotNull() & nanos(data).isNotNull()
    return F.when(good, F.struct(epoch_seconds(data).alias("seconds"), nanos(data).alias("nanos")))


def timestamp_tz(data: Column, regions: dict[int, str] | None = None) -> Column:
    """Struct (seconds, nanos, zone) of a zoned timestamp in 9 or 13 bytes; the time is UTC.

    The last two bytes hold hours in excess of 20 and minutes in excess of 60, or, with the top bit set,
    the number of a region; an unknown one is ``TZ?``.
    """
    long_ = F.octet_length(data) == 13
    hour, minute = (F.when(long_, byte(data, 11 + k)).otherwise(byte(data, 7 + k)) for k in range(2))
    offset = (hour - 20) * 60 + (minute - 60)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat(F.when(offset < 0, "-").otherwise("+"), two(F.floor(F.abs(offset) / 60)), F.lit(":"), two(F.abs(offset) % 60))
    code = F.shiftleft(hour.bitwiseAND(F.lit(0x7F)), 6) + F.shiftright(minute.bitwiseAND(F.lit(0xFC)), 2)
    region = F.lit("TZ?")
    if regions:
        table = F.create_map(*(F.lit(x) for pair in regions.items() for x in pair))
        region = F.coalesce(F.element_at(table, code), region)
    seconds, part = epoch_seconds(data), F.when(long_, nanos(data)).otherwise(F.lit(0).cast("long"))
    good = F.octet_length(data).isin(9, 13) & seconds.isNotNull() & part.isNotNull()
    return F.when(good, F.struct(seconds.alias("seconds"), part.alias("nanos"), F.when(hour >= 0x80, region).otherwise(text).alias("zone")))


def _excess(data: Column, at: int, base: int) -> Column:
    return byte(data, at).cast("long") - base


def interval_ym(data: Column) -> Column:
    """Struct (negative, year, month) of 5 bytes: years in excess of 2**31, months of 60."""
    year, month = big_endian(data, 0, 4) - (1 << 31), _excess(data, 4, 60)
    good = (F.octet_length(data) == 5) & (F.abs(year) <= 999_999_999) & month.between(-11, 11)
    return F.when(good, F.struct(((year < 0) | (month < 0)).alias("negative"), F.abs(year).alias("year"), F.abs(month).alias("month")))


def interval_ds(data: Column) -> Column:
    """Struct (negative, day, hour, minute, second, nanos) of 11 bytes."""
    day, part = big_endian(data, 0, 4) - (1 << 31), big_endian(data, 7, 4) - (1 << 31)
    hour, minute, second = (_excess(data, k, 60) for k in (4, 5, 6))
    good = (F.octet_length(data) == 11) & (F.abs(day) <= 999_999_999) & (F.abs(part) <= 999_999_999) & hour.between(-23, 23) & minute.between(-59, 59) & second.between(-59, 59)
    parts = {"day": day, "hour": hour, "minute": minute, "second": second, "nanos": part}
    negative = F.greatest(*(c < 0 for c in parts.values()))
    return F.when(good, F.struct(negative.alias("negative"), *(F.abs(c).alias(n) for n, c in parts.items())))


#: Codecs for the names that a dictionary gives.
CHARSETS = {
    "US7ASCII": "ascii", "WE8ISO8859P1": "latin-1", "UTF8": "cesu-8", "AL32UTF8": "utf-8", "AL24UTFFSS": "cesu-8", "AL16UTF16": "utf-16-be", "AL16UTF16LE": "utf-16-le",
    "US8PC437": "cp437", "WE8PC850": "cp850", "WE8PC858": "cp858", "EE8PC852": "cp852", "RU8PC866": "cp866", "RU8PC855": "cp855", "TR8PC857": "cp857", "WE8PC860": "cp860",
    "IS8PC861": "cp861", "N8PC865": "cp865", "EL8PC737": "cp737", "EL8PC869": "cp869", "BLT8PC775": "cp775", "IW8PC1507": "cp862", "AR8PC864": "cp864", "CDN8PC863": "cp863",
    "EE8ISO8859P2": "iso8859-2", "SE8ISO8859P3": "iso8859-3", "NEE8ISO8859P4": "iso8859-4", "CL8ISO8859P5": "iso8859-5", "AR8ISO8859P6": "iso8859-6", "EL8ISO8859P7": "iso8859-7",
    "IW8ISO8859P8": "iso8859-8", "WE8ISO8859P9": "iso8859-9", "NE8ISO8859P10": "iso8859-10", "BLT8ISO8859P13": "iso8859-13", "CEL8ISO8859P14": "iso8859-14", "WE8ISO8859P15": "iso8859-15",
    "EE8MSWIN1250": "cp1250", "CL8MSWIN1251": "cp1251", "WE8MSWIN1252": "cp1252", "EL8MSWIN1253": "cp1253", "TR8MSWIN1254": "cp1254", "IW8MSWIN1255": "cp1255", "AR8MSWIN1256": "cp1256",
    "BLT8MSWIN1257": "cp1257", "VN8MSWIN1258": "cp1258", "CL8KOI8R": "koi8-r", "CL8KOI8U": "koi8-u", "TH8TISASCII": "tis-620", "TH8MACTHAI": "tis-620",
    "EE8MACCE": "mac-latin2", "EE8MACCES": "mac-latin2", "CL8MACCYRILLIC": "mac-cyrillic", "CL8MACCYRILLICS": "mac-cyrillic", "EL8MACGREEK": "mac-greek", "EL8MACGREEKS": "mac-greek",
    "IS8MACICELANDIC": "mac-iceland", "IS8MACICELANDICS": "mac-iceland", "TR8MACTURKISH": "mac-turkish", "TR8MACTURKISHS": "mac-turkish", "EE8MACCROATIAN": "mac-croatian",
    "EE8MACCROATIANS": "mac-croatian", "WE8MACROMAN8": "mac-roman", "WE8MACROMAN8S": "mac-roman", "WE8HP": "hp-roman8", "WE8ROMAN8": "hp-roman8",
    "WE8EBCDIC37": "cp037", "WE8EBCDIC500": "cp500", "WE8EBCDIC1140": "cp1140", "D8EBCDIC273": "cp273", "IW8EBCDIC424": "cp424", "EL8EBCDIC875": "cp875", "TR8EBCDIC1026": "cp1026",
    "JA16SJIS": "cp932", "JA16SJISTILDE": "cp932", "JA16EUC": "euc-jp", "JA16EUCTILDE": "euc-jp", "KO16KSC5601": "euc-kr", "KO16KSCCS": "johab", "KO16MSWIN949": "cp949",
    "ZHS16GBK": "gbk", "ZHS16CGB231280": "gb2312", "ZHS32GB18030": "gb18030", "ZHT16BIG5": "big5", "ZHT16MSWIN950": "cp950", "ZHT16HKSCS": "big5hkscs", "ZHT16HKSCS31": "big5hkscs",
}
#: Sets that only the JVM knows; Spark decodes them if ``spark.sql.legacy.javaCharsets`` is set.
JAVA_CHARSETS = {"ZHT32EUC": "x-EUC-TW", "CL8EBCDIC1025": "x-IBM1025", "WE8EBCDIC1047": "IBM1047", "DK8EBCDIC277": "IBM277", "S8EBCDIC278": "IBM278", "I8EBCDIC280": "IBM280", "F8EBCDIC297": "IBM297", "EE8EBCDIC870": "IBM870", "WE8EBCDIC871": "IBM871", "WE8EBCDIC284": "IBM284", "WE8EBCDIC285": "IBM285", "AR8EBCDICX": "IBM420", "LT8PC772": "x-IBM921", "LT8MSWIN921": "x-IBM921", "BLT8CP921": "x-IBM921", "ET8MSWIN923": "x-IBM922"}


class CharsetError(ValueError):
    """A character set that can't be decoded here."""


@F.pandas_udf(T.StringType())
def _decode(data: pd.Series, name: pd.Series) -> pd.Series:
    def one(b, n):
        if b is None:
            return None
        if n == "cesu-8":  # surrogate pairs in three bytes each
            text = bytes(b).decode("utf-8", "surrogatepass" if _pairs(b) else "replace")
            return text.encode("utf-16-be", "surrogatepass").decode("utf-16-be", "replace")
        return bytes(b).decode(n, "replace")

    return pd.Series([one(b, n) for b, n in zip(data, name, strict=True)])


def _pairs(data) -> bool:
    try:
        bytes(data).decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return False
    return True


def characters(data: Column, charset: str) -> Column:
    """Text of bytes in a character set; bytes that mean nothing become U+FFFD.

    Sets that Spark decodes by itself stay in the JVM if the bytes are valid; others and malformed bytes
    take an Arrow function. An unknown set is an error when the plan is built.
    """
    if charset in JAVA_CHARSETS:
        session = SparkSession.getActiveSession()
        if session is None or session.conf.get("spark.sql.legacy.javaCharsets", "false") != "true":
            raise CharsetError(f"{charset} needs spark.sql.legacy.javaCharsets = true")
        return F.decode(data, JAVA_CHARSETS[charset])
    codec = CHARSETS.get(charset)
    if codec is None:
        raise CharsetError(f"unknown character set {charset!r}")
    if codec == "utf-8":
        return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(F.make_valid_utf8(data.cast("string")))
    if codec == "latin-1":
        return F.decode(data, "ISO-8859-1")
    return _decode(data, F.lit(codec))


def character_output(text: Column, mode: int) -> Column:
    """0 and 1: text; 2 and 3: hexadecimal of its UTF-8 bytes. For bytes as stored see ``stored_characters``."""
    return F.lower(F.hex(F.encode(text, "UTF-8"))) if mode & 2 else text


def stored_characters(data: Column, charset: str, mode: int = 0) -> Column:
    """Output of stored bytes: bit 1 leaves out the mapping of the character set (each byte is a character), bit 2 writes hexadecimal."""
    if mode & 1:
        return raw(data) if mode & 2 else F.decode(data, "ISO-8859-1")
    return character_output(characters(data, charset), mode)


def raw(data: Column) -> Column:
    return F.lower(F.hex(data))


def or_unknown(value: Column, data: Column) -> Column:
    """``?`` where there are bytes but no value."""
    return F.when(value.isNull() & data.isNotNull(), "?").otherwise(value)


def boolean(data: Column) -> Column:
    return F.when((F.octet_length(data) == 1) & (byte(data, 0) <= 1), byte(data, 0).cast("string"))


def urowid(data: Column) -> Column:
    """Row id text of 13 bytes that begin with 1."""
    from tidelog.functions import ids

    obj, slot, afn, block = big_endian(data, 1, 4), big_endian(data, 5, 2), big_endian(data, 7, 2), big_endian(data, 9, 4)
    dba = block.bitwiseOR(F.shiftleft(afn, 22))
    return F.when((F.octet_length(data) == 13) & (byte(data, 0) == 1), ids.rowid_text(obj, dba, slot))
