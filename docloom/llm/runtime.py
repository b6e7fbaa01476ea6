"""What the operators of this package share: cutting lineage, Arrow maps over texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.shared import cut, shared_folder  # noqa: F401
from docloom.shipping import ship

#: Texts that one call of a text function sees at most; bounds what a Python worker holds.
SLICE_ROWS = 256
#: Bytes of text that one call sees at most, unless a single text is longer.
SLICE_BYTES = 8 << 20


#: Tables that ``staged`` has written within the innermost ``staging``, if there is one.
_STAGED: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def staged(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: for rows with texts, which a checkpoint wouldn't compress.

    Results that are still to be read depend on the table. It is deleted at the end of the ``staging`` that it was written
    within; outside of any it stays, like a checkpoint, until the folder's owner clears it.
    """
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    written = _STAGED.get()
    if written is not None:
        written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Tables staged within are deleted at the end, also after a fault, and no others: what is made within is to be written there."""
    token = _STAGED.set([])
    try:
        yield
    finally:
        written = _STAGED.get()
        _STAGED.reset(token)
        for path in written:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table, in whatever store it lies."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def one_of(rows: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """One row of those that agree in ``by``, which settles the text but for null or empty: the least by its other columns
    as JSON, a null text last. So it doesn't matter in which order rows come."""
    others = [c for c in rows.columns if c not in by]
    order = F.struct(F.col(text).isNull(), F.to_json(F.struct(F.lit(0), *[c for c in others if c != text])))
    return rows.groupBy(*by).agg(F.min_by(F.struct(*others), order).alias("__row")).select(*by, "__row.*")


def inner(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under names by position, which nothing an operator adds can clash with, and the new name of each column.

    Names may hold dots or backticks, or differ in case only.
    """
    names = [f"__d{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def outer(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns that ``inner`` made of those of ``docs``, under their own names and in their order."""
    return rows.select(*[f"__d{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def slices(texts: pa.Array, rows: int = SLICE_ROWS, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Runs of a text column, null as empty, each with its first row: few rows and few bytes, or one long text."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= rows or held + n > limit):
            yield start, [t or "" for t in texts.slice(start, i - start).to_pylist()]
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, [t or "" for t in texts.slice(start).to_pylist()]


def map_texts(df: DataFrame, function: Callable[[], Callable[[list[str]], Sequence[Sequence]]], out: Sequence[tuple[str, str]], text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Apply a text function to every whole text in Arrow batches, without a shuffle.

    ``function()`` is called once in each task and gives a callable from texts to one list for each column
    of ``out`` (name, Spark type). The result has the columns of ``keep`` and of ``out``; where names clash,
    those of ``out`` win. Null texts count as empty.
    """
    ship(df.sparkSession)
    names = [n for n, _ in out]
    kept = [c for c in keep if c not in names]
    narrow = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]] + [f"`{n}` {t}" for n, t in out])
    types = [_ARROW[t] for _, t in out]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = function()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for start, part in slices(texts):
                made = f(part)
                rows = batch.slice(start, len(part))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *(pa.array(v, t) for v, t in zip(made, types, strict=True))], names=[*kept, *names])

    return narrow.mapInArrow(over, fields)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
