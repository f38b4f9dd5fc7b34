"""Text forms of timestamps and intervals.

Values come as whole seconds and nanoseconds (timestamps) or as sign and whole parts (intervals), since
Spark's own types end at microseconds. Rounding is half up and carries into seconds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANO = 1_000_000_000


def seconds_of(clock: Column) -> Column:
    """Whole seconds of a clock time without zone since 1970, whatever the session's zone is."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), clock.cast("timestamp_ntz"))


def _civil(seconds: Column, separator: str) -> Column:
    """``YYYY-MM-DD?HH:MI:SS`` without the session's time zone."""
    day, rest = F.floor(seconds / 86400), F.pmod(seconds, F.lit(86400))
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")), "yyyy-MM-dd")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(date, F.lit(separator), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60))


def _rounded(seconds: Column, nanos: Column, digits: int) -> tuple[Column, Column]:
    """Seconds and fraction at ``digits`` places, rounded half up."""
    unit = 10 ** (9 - digits)
    part = F.floor((nanos + (unit // 2 if unit > 1 else 0)) / unit)
    full = 10**digits
    return seconds + F.floor(part / full), part % full


def epoch(seconds: Column, nanos: Column, digits: int) -> Column:
    """Epoch number in units of 10**-digits seconds; in smaller ones a decimal, as nanoseconds pass 64 bits in 2262."""
    s, f = _rounded(seconds, nanos, digits)
    return s.cast("decimal(28,0)") * 10**digits + f if digits else s


def iso(seconds: Column, nanos: Column, digits: int, zulu: bool) -> Column:
    s, f = _rounded(seconds, nanos, digits)
    text = _civil(s, "T" if zulu else " ")
    if digits:
        text = F.concat(text, F.lit("."), F.lpad(f.cast("string"), digits, "0"))
    return F.concat(text, F.lit("Z")) if zulu else text


PLACES = (9, 6, 3, 0)


def timestamp(seconds: Column, nanos: Column, mode: int) -> Column:
    """Mode 0-3 and 4-7: epoch in ns, us, ms, s; 8-11: ISO with T and Z; 12-15: ISO with a space."""
    if not 0 <= mode <= 15:
        raise ValueError(f"timestamp mode {mode}")
    kind, place = divmod(mode, 4)
    if kind < 2:
        return epoch(seconds, nanos, PLACES[place]).cast("string")
    return iso(seconds, nanos, PLACES[place], zulu=kind == 2)


def is_text(mode: int) -> bool:
    """Whether a timestamp mode is written between quotes."""
    return mode >= 4


def timestamp_tz(seconds: Column, nanos: Column, zone: Column, mode: int) -> Column:
    """Mode 0-3: epoch, comma, zone; 4-7: ISO with Z, space, zone; 8-11: plain ISO, space, zone."""
    if not 0 <= mode <= 11:
        raise ValueError(f"timestamp-tz mode {mode}")
    kind, place = divmod(mode, 4)
    if kind == 0:
        return F.concat(epoch(seconds, nanos, PLACES[place]).cast("string"), F.lit(","), zone)
    return F.concat(iso(seconds, nanos, PLACES[place], zulu=kind == 1), F.lit(" "), zone)


def interval_ds(negative: Column, day: Column, hour: Column, minute: Column, second: Column, nanos: Column, mode: int) -> Column:
    """Mode 0-3 and 4-7: count of ns, us, ms, s; 8-10: ``D HH:MI:SS.nnnnnnnnn`` with space, comma or dash."""
    if not 0 <= mode <= 10:
        raise ValueError(f"interval-dts mode {mode}")
    sign = F.when(negative, "-").otherwise("")
    seconds = ((day * 24 + hour) * 60 + minute) * 60 + second
    if mode < 8:
        # Days may be up to a billion: nanoseconds need more than 64 bits.
        return F.concat(sign, epoch(seconds.cast("decimal(28,0)"), nanos, PLACES[mode % 4]).cast("decimal(38,0)").cast("string"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat(two(hour), F.lit(":"), two(minute), F.lit(":"), two(second), F.lit("."), F.lpad(nanos.cast("string"), 9, "0"))
    return F.concat(sign, day.cast("string"), F.lit(" ,-"[mode - 8]), text)


def interval_ym(negative: Column, year: Column, month: Column, mode: int) -> Column:
    """Mode 0-1: months; 2-4: ``Y M`` with space, comma or dash."""
    if not 0 <= mode <= 4:
        raise ValueError(f"interval-ytm mode {mode}")
    sign = F.when(negative, "-").otherwise("")
    if mode < 2:
        return F.concat(sign, (year * 12 + month).cast("string"))
    return F.concat(sign, year.cast("string"), F.lit(" ,-"[mode - 2]), month.cast("string"))
