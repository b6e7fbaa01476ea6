"""The registered queries on the smallest tables against DuckDB, as rows without order."""

import math
import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
ORACLES = __spark_entry__.oracle_sql()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return str(int(v)) if float(v).is_integer() else str(round(float(v), 5))
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    names = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    found = duck.sql(ORACLES[name])
    assert sorted(found.columns) == names
    at = [found.columns.index(c) for c in names]
    assert ours == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_rows_only(spark):
    for name, query in __spark_entry__.queries().items():
        if name not in ORACLES and not name.startswith("op") and name != "pipeline":
            assert query(spark, SF).count() > 0, name


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
