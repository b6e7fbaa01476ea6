"""A table kept in hash buckets of its key, so that an upsert rewrites the buckets it touches and no others.

Each version is a row that names the folder of every bucket, and it is written last: readers see all of a change or nothing,
a job that fails leaves the last version as it was, and older versions stay readable. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.operators.graph import upsert

BUCKETS = 256
_VERSION = "version long, buckets long, key array<string>, folders map<string,string>, schema string"


def version(spark: SparkSession, path: str, number: int | None = None):
    """The row of a version, the last one if not given."""
    rows = spark.read.schema(_VERSION).json(f"{path}/versions")
    found = (rows if number is None else rows.filter(F.col("version") == number)).orderBy(F.desc("version")).first()
    if found is None:
        raise ValueError(f"no such version at {path}")
    return found


def _bucket(key: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in key]), F.lit(n)).cast("int")


def _write(rows: DataFrame, path: str, key: list[str], n: int) -> tuple[str, list[int]]:
    """Rows by bucket in a new folder, and the buckets that have any."""
    name = uuid.uuid4().hex
    rows.withColumn("__bucket", _bucket(key, n)).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{path}/data/{name}")
    found = rows.sparkSession.read.schema("__bucket int").parquet(f"{path}/data/{name}").select("__bucket").distinct()
    return name, [r[0] for r in found.collect()]  # at most ``n``


def _commit(spark: SparkSession, path: str, number: int, n: int, key: list[str], folders: dict[str, str], schema: str) -> int:
    spark.createDataFrame([(number, n, key, folders, schema)], _VERSION).coalesce(1).write.mode("append").json(f"{path}/versions")
    return number


def create(df: DataFrame, path: str, key: list[str], buckets: int = BUCKETS) -> int:
    """Write a table's first version. Rows of one key must be unique; a null key is a key."""
    name, found = _write(df, path, key, buckets)
    return _commit(df.sparkSession, path, 1, buckets, key, {str(b): name for b in found}, df.schema.json())


def _read(spark: SparkSession, path: str, at, buckets: list[str]) -> DataFrame:
    schema = StructType.fromJson(json.loads(at.schema))
    folders = [f"{path}/data/{at.folders[b]}/__bucket={b}" for b in buckets if b in at.folders]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    at = version(spark, path, number)
    return _read(spark, path, at, sorted(at.folders))


def upsert_buckets(spark: SparkSession, path: str, changes: DataFrame, order: list[Column]) -> int:
    """Put rows in place of those of their keys, or beside them; of several changes of a key the first by ``order`` counts, as in
    ``graph.upsert``. Doing it twice changes nothing. Gives the number of the new version; without changes the last one stays."""
    at = version(spark, path)
    key, n = list(at.key), at.buckets
    touched = sorted(str(r[0]) for r in changes.select(_bucket(key, n).alias("b")).distinct().collect())  # at most ``n``
    if not touched:
        return at.version
    merged = upsert(_read(spark, path, at, touched), changes, key, order)
    name, found = _write(merged, path, key, n)
    folders = {**at.folders, **{str(b): name for b in found}}
    return _commit(spark, path, at.version + 1, n, key, folders, at.schema)
