"""Gives the executors this package, for functions that run in Python there."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Add the package to the files of the Spark context, once."""
    sc = spark.sparkContext
    if getattr(sc, "_docloom_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    path = os.path.join(tempfile.mkdtemp(prefix="docloom-"), "docloom.zip")
    with open(path, "wb") as out:
        out.write(buffer.getvalue())
    sc.addPyFile(path)
    sc._docloom_shipped = True


def arrow_function(f: Callable, kind: str):
    """An Arrow function of columns, made where it is used: modules stay importable on the executors."""
    ship(SparkSession.active())
    return F.pandas_udf(f, kind)
