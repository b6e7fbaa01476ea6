"""The folder that the driver and all executors share, and what is written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table is broadcast beside another.
FEW = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``. Only in a single process, as in tests, a temporary one will do."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="docloom-checkpoints-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder: lost executors don't undo it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def beside(rows: DataFrame, few: DataFrame, most: int = FEW) -> DataFrame:
    """All pairs with a stated small set, such as questions. It is counted first: only a set of at most ``most`` rows is
    broadcast; for a larger one Spark pairs the two in blocks of partitions."""
    small = few.limit(most + 1).count() <= most
    return rows.crossJoin(F.broadcast(few) if small else few)


def few(rows: DataFrame, most: int = FEW) -> DataFrame:
    """The rows, marked for a broadcast if they are counted to be few."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def numbered(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """The rows with their place, from 1, in a total order of the whole table; no task sorts more than a range of it.

    Rows are dealt out by ranges and written; a row's place is its place in its range and the number of rows of those
    before, of which there is one figure for each range.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("__range", F.spark_partition_id())
    before, offsets = 0, []
    for part, n in sorted(map(tuple, ranged.groupBy("__range").agg(F.count(F.lit(1))).collect())):  # a row for each range
        offsets.append((part, before))
        before += n
    starts = df.sparkSession.createDataFrame(offsets, "__of int, __before long")
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = ranged.withColumn("__within", within).join(F.broadcast(starts), F.col("__range") == F.col("__of"))
    return placed.select(*df.columns, (F.col("__before") + F.col("__within") + 1).alias(name))
