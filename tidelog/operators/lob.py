"""Large objects from their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reassemble(pages: DataFrame, sizes: DataFrame | None = None, value_col: str = "page", kind: str = "text") -> DataFrame:
    """One value for each ``lob_id`` from pages in order of ``page_no``.

    With ``sizes(lob_id, size_pages, size_rest)`` the last page is cut to its rest and ``status`` says whether
    all pages are there; a value must fit in one row, as it must in one message.
    """
    ordered = F.array_sort(F.collect_list(F.struct("page_no", value_col)))
    parts = F.transform(ordered, lambda p: p[value_col])
    if kind == "text":
        whole = F.array_join(parts, "")
    else:
        whole = F.unhex(F.array_join(F.transform(parts, lambda b: F.hex(b)), ""))
    measure = F.length(value_col) if kind == "text" else F.octet_length(value_col)
    out = pages.groupBy("lob_id").agg(
        whole.alias("value"), F.count("*").alias("n_pages"), F.countDistinct("page_no").alias("n_distinct"), F.max("page_no").alias("last_page"), F.max(measure).alias("page_size")
    )
    if sizes is None:
        return out.select("lob_id", "value", "n_pages", F.when((F.col("n_distinct") == F.col("n_pages")) & (F.col("last_page") == F.col("n_pages") - 1), "ok").otherwise("damaged").alias("status"))
    joined = out.join(sizes, "lob_id", "left")
    n = F.coalesce(F.col("size_pages") * F.col("page_size") + F.col("size_rest"), F.length("value") if kind == "text" else F.octet_length("value"))
    wanted = F.col("size_pages") + (F.col("size_rest") > 0).cast("int")
    status = F.when(F.col("size_pages").isNull(), "no size").when(F.col("n_distinct") < F.col("n_pages"), "duplicate page").when(F.col("n_pages") < wanted, "page missing").when(F.col("n_pages") > wanted, "size differs").otherwise("ok")
    return joined.select("lob_id", F.substring(F.col("value"), F.lit(1), n.cast("int")).alias("value"), "n_pages", status.alias("status"))


def with_orphans(pages: DataFrame, locators: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with their locator's transaction, pages whose locator hasn't come); locators may be later than pages."""
    joined = pages.join(locators, "lob_id", "left")
    return joined.where(F.col("owner_sqn").isNotNull()), joined.where(F.col("owner_sqn").isNull()).drop("owner_sqn")
