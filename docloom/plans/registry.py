"""A query with its DuckDB twin, registered under the id of the operator that it shows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def folded(column: str) -> str:
    """The composed, case-folded text in DuckDB, which has no folding: of one letter of ours it differs from lower case."""
    return f"replace(lower(nfc_normalize({column})), 'ß', 'ss')"


def query(name: str, sql: str | None = None, session: bool = False):
    """Register a function of a table reader; ``t("orders")`` reads that table. With ``session`` it gets the session too."""

    def put(f):
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            t = lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
            return f(t, spark) if session else f(t)

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return put
