"""Profiles and integrity checks: missing values, duplicates, keys, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import NULL_MARKS, wikilinks


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_null, n_empty, n_marked): one pass over the table, then one row for each column."""
    columns = columns or df.columns
    text = {c: F.trim(F.col(c).cast("string")) for c in columns}
    marks = [m.lower() for m in NULL_MARKS if m]
    sums = []
    for c in columns:
        sums += [F.sum(F.col(c).isNull().cast("long")).alias(f"{c}__0"), F.sum((text[c] == "").cast("long")).alias(f"{c}__1"), F.sum(F.lower(text[c]).isin(*marks).cast("long")).alias(f"{c}__2")]
    row = df.agg(*sums)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[F.coalesce(F.col(f"{c}__{i}"), F.lit(0)).alias(n) for i, n in enumerate(("n_null", "n_empty", "n_marked"))]) for c in columns])).alias("p")
    return row.select(each).select("p.*")


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: rows, distinct keys, and rows that repeat an earlier key."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys")).withColumn("n_repeats", F.col("n_rows") - F.col("n_keys"))


def corpus_check(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: rows, rows without text, ids that occur more than once."""
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum((F.coalesce(F.trim(text), F.lit("")) == "").cast("long")).alias("e"))
    return twice.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("e"), F.lit(0)).alias("n_without_text"), F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("n_repeated_ids"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def broken_references(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is not a known key; null references are no fault."""
    return rows.filter(F.col(column).isNotNull()).join(known.select(F.col(key).alias(column)), column, "left_anti")


def without(rows: DataFrame, key: str, others: DataFrame, column: str) -> DataFrame:
    """Rows that none of the others points at."""
    return rows.join(others.select(F.col(column).alias(key)), key, "left_anti")


def key_differences(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Keys in one table only, and which."""
    a = first.select(key).distinct().join(second.select(key), key, "left_anti").withColumn("only_in", F.lit("first"))
    return a.unionByName(second.select(key).distinct().join(first.select(key), key, "left_anti").withColumn("only_in", F.lit("second")))


def link_check(pages: DataFrame, body: str = "body", key: str = "id") -> DataFrame:
    """(id, n_out, n_in, n_broken) of wiki pages by their links."""
    links = pages.select(F.col(key).alias("src"), F.explode(wikilinks(F.col(body))).alias("dst"))
    known = pages.select(F.col(key).alias("dst"), F.lit(True).alias("known")).distinct()
    out = links.join(known, "dst", "left").groupBy("src").agg(F.count(F.lit(1)).alias("n_out"), F.sum(F.col("known").isNull().cast("long")).alias("n_broken"))
    into = links.groupBy("dst").agg(F.count(F.lit(1)).alias("n_in"))
    return pages.select(F.col(key).alias("id")).join(out.withColumnRenamed("src", "id"), "id", "left").join(into.withColumnRenamed("dst", "id"), "id", "left").fillna(0, ["n_out", "n_in", "n_broken"])


def dangling_next(rows: DataFrame, key: str = "block_id", following: str = "next_id") -> DataFrame:
    return broken_references(rows, following, rows, key)


def collected(rows: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """Sorted distinct values for each group."""
    return rows.groupBy(*by).agg(*[F.array_sort(F.collect_set(v)).alias(k) for k, v in values.items()])
