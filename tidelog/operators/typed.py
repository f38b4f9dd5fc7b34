"""Messages as typed rows: the struct twin of the JSON text, for Parquet, Avro or Protobuf writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import ids


def value(text: Column, kind: Column) -> Column:
    """One of integer, double, text or bytes by the column's type; a number goes to the narrowest that holds it."""
    whole = text.rlike(r"^-?\d{1,18}$")
    number = kind.isin("number", "float")
    return F.struct(
        F.when(number & whole, text.try_cast("long")).alias("int"),
        F.when(number & ~whole & (F.length(text) <= 17), text.try_cast("double")).alias("double"),
        F.when(~number & (kind != "raw") | (number & ~whole & (F.length(text) > 17)), text).alias("string"),
        F.when(kind == "raw", F.unhex(text)).alias("bytes"),
    )


def columns(image: Column, types: dict[str, str]) -> Column:
    """An image as an array of (name, value) in order of names; a null value is an explicit null."""
    table = F.create_map(*(F.lit(x) for pair in types.items() for x in pair))
    entries = F.array_sort(F.map_entries(image))
    return F.transform(entries, lambda e: F.struct(e["key"].alias("name"), F.when(e["value"].isNotNull(), value(e["value"], F.coalesce(F.element_at(table, e["key"]), F.lit("varchar2")))).alias("value")))


def messages(changes: DataFrame, types: dict[str, str]) -> DataFrame:
    """One row a change: scn, position, xid, schema and both images, typed."""
    return changes.select(
        F.col("scn"), F.col("c_scn"), F.col("c_idx"), ids.xid_pack(F.col("usn"), F.col("slt"), F.col("sqn")).alias("xidn"),
        F.when(F.col("op") == "c", 2).when(F.col("op") == "u", 3).otherwise(4).alias("op"),
        F.struct(F.col("owner"), F.col("name"), F.col("obj")).alias("schema"),
        F.when(F.col("op") != "c", columns(F.col("before"), types)).alias("before"), F.when(F.col("op") != "d", columns(F.col("after"), types)).alias("after"),
    )
