"""Before and after images: what a message shows.

Images are ``map<string,string>``: a missing key was not logged, a null value is an explicit null. That
difference survives to the output, since JSON of a map keeps null values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "map<string,string>"


def empty() -> Column:
    return F.create_map().cast(EMPTY)


def with_supplemental(image: Column, supplemental: Column) -> Column:
    """Columns that are absent or null in the image come from supplemental logging."""
    return F.map_zip_with(F.coalesce(image, empty()), F.coalesce(supplemental, empty()), lambda k, v, s: F.coalesce(v, s))


def null_guard(image: Column, names: list[str], bits: Column) -> Column:
    """Absent columns whose bit is set in the guard column's bitmap are explicit nulls."""
    missing = F.array(*(F.when((F.getbit(bits, F.lit(k)) == 1) & ~F.map_contains_key(image, F.lit(n)), F.lit(n)) for k, n in enumerate(names)))
    names_set = F.filter(missing, lambda n: n.isNotNull())
    return F.map_concat(image, F.map_from_arrays(names_set, F.transform(names_set, lambda n: F.lit(None).cast("string"))))


def repair_not_null(before: Column, after: Column, not_null: list[str]) -> Column:
    """A null before-image of a column that can't be null takes the after-image."""
    keys = F.array(*map(F.lit, not_null)).cast("array<string>")
    return F.transform_values(before, lambda k, v: F.when(v.isNull() & F.array_contains(keys, k) & F.map_contains_key(after, k), F.element_at(after, k)).otherwise(v))


def pairs(before: Column, after: Column) -> Column:
    """Map of column to (b, a, in_b, in_a)."""
    return F.map_zip_with(
        before, after, lambda k, b, a: F.struct(b.alias("b"), a.alias("a"), F.map_contains_key(before, k).alias("in_b"), F.map_contains_key(after, k).alias("in_a"))
    )


def names(columns: Column | list[str]) -> Column:
    """Column names as an array, given as a list or, where they differ from row to row, as a column."""
    return columns if isinstance(columns, Column) else F.array(*map(F.lit, columns)).cast("array<string>")


def changed(both: Column, keys: Column | list[str], mode: int) -> Column:
    """The columns of an update that are shown; an absent side becomes an explicit null.

    Mode 0 and 1 leave out non-key columns that are equal on both sides, or null on one and absent
    on the other; mode 2 shows all that was logged.
    """
    if mode >= 2:
        return both
    key = names(keys)

    def shown(k, p):
        same = p["in_b"] & p["in_a"] & p["b"].eqNullSafe(p["a"])
        bare = (p["in_b"] & ~p["in_a"] & p["b"].isNull()) | (p["in_a"] & ~p["in_b"] & p["a"].isNull())
        return F.array_contains(key, k) | ~(same | bare)

    return F.map_filter(both, shown)


def side(both: Column, name: str) -> Column:
    return F.transform_values(both, lambda k, p: p[name])


def update_images(before: Column, after: Column, keys: Column | list[str], mode: int = 0) -> tuple[Column, Column]:
    both = changed(pairs(before, after), keys, mode)
    return side(both, "b"), side(both, "a")


def one_image(image: Column, keys: Column | list[str], columns: Column | list[str], mode: int = 0) -> Column:
    """The shown image of an insert or delete: mode 0 without nulls but with all keys; above, every column."""
    if mode == 2 and isinstance(columns, list) and not columns:
        return image
    wanted = names(keys if mode == 0 else columns)
    missing = F.filter(wanted, lambda n: ~F.map_contains_key(image, n))
    nulls = F.map_from_arrays(missing, F.transform(missing, lambda n: F.lit(None).cast("string")))
    kept = image
    if mode == 0:
        key = names(keys)
        kept = F.map_filter(image, lambda k, v: v.isNotNull() | F.array_contains(key, k))
    return F.map_concat(kept, nulls)


#: Type numbers whose nulls are always shown, and those whose nulls are shown after a change alone.
NULL_TYPES, NULL_TYPES_AFTER = (1, 2, 12, 23, 96, 100, 101, 180, 182, 183, 208, 231), (58, 112, 113, 119)


def hide_unsupported(image: Column, types: Column, after: bool) -> Column:
    """Without the nulls of columns whose type (``types``: map of name to number) isn't supported; unknown names stay."""
    shown = NULL_TYPES + (NULL_TYPES_AFTER if after else ())
    return F.map_filter(image, lambda k, v: v.isNotNull() | F.coalesce(F.element_at(types, k).isin(*shown), F.lit(True)))


def text_of(image: Column) -> Column:
    """``name=value`` in order of names, a null as ``name``: a stable text for comparing."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(image)), lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), ";")


def tag(image: Column, columns: list[str], separator: str = ".") -> Column:
    """The message key: values of the tag columns in order."""
    return F.concat_ws(separator, *(F.coalesce(F.element_at(image, F.lit(c)), F.lit("")) for c in columns))
