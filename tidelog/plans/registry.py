"""All registered queries of the change-data engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.plans import codec_queries, format_queries, more_queries, output_queries, row_queries, run_queries, stream_queries, transaction_queries

MODULES = [transaction_queries, format_queries, row_queries, output_queries, more_queries, stream_queries, run_queries, codec_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: build for module in MODULES for name, build in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
