"""The registered queries of the library's own operators, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.plans import io_queries, ranking_queries, table_queries, text_queries  # noqa: F401
from docloom.plans.registry import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: BM25 top 10 for each question."""
    return QUERIES["rnk_01_bm25"](spark, sf_dir)
