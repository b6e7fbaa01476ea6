"""Sinks: tables by Spark's commit protocol, upserts, manifests, reports, wiki pages, audit records."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.graph import upsert
from docloom.shared import cut, few, scratch
from docloom.shipping import ship


def json_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


#: Bytes from which a file of an array is written as several.
FILE = 256 << 20


def json_arrays(df: DataFrame, path: str, by: str, element: Column, member: str, within: Column) -> None:
    """A JSON file for each value of ``by``, or several of about ``FILE`` bytes for one with more: an array of the elements, or an object
    with it under the name ``member`` where ``within`` holds. A task writes a file as its rows come, none of which holds a file; no rows
    give one file with an empty array."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(by).alias("__key"), within.alias("__within"), F.to_json(element).alias("value"))
    parts = F.ceil(F.sum(F.octet_length("value").cast("long")) / FILE).cast("int").alias("__parts")
    before = F.coalesce(F.sum("__parts").over(Window.orderBy("__by").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    files = cut(rows.groupBy(F.col("__key").alias("__by")).agg(parts).withColumn("__before", before))
    n = files.agg(F.sum("__parts")).first()[0]
    if not n:
        spark.createDataFrame([("[]",)], "value string").coalesce(1).write.text(path)
        return
    begins, ends = ("[", f"{{{json.dumps(member)}: ["), ("]", "]}")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in batches:
            if batch.num_rows:
                marks = [","] * batch.num_rows
                if kind is None:
                    kind = batch.column(0)[0].as_py()
                    marks[0] = begins[kind]
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(pa.array(marks), batch.column(1), "")], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if kind is None else ends[kind]])], names=["value"])

    file = F.col("__before") + F.pmod(F.xxhash64("value"), F.col("__parts")).cast("int")
    dealt = rows.join(few(files), F.col("__key").eqNullSafe(F.col("__by"))).select(file.alias("__file"), "__within", "value").repartitionById(int(n), "__file")
    dealt.select("__within", "value").mapInArrow(over, "value string").write.text(path)


def csv_table(df: DataFrame, path: str) -> None:
    """CSV with a header; the first column's name carries a byte-order mark, as spreadsheets expect."""
    first, *rest = df.columns
    df.select(F.col(first).alias("﻿" + first), *rest).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def upsert_table(spark: SparkSession, path: str, changes: DataFrame, key: list[str], order: list[Column]) -> str:
    """Write the upserted table beside the old one, under a name of its own, and give its path: readers of older ones aren't disturbed."""
    merged = upsert(spark.read.parquet(path), changes, key, order) if path else upsert(changes.limit(0), changes, key, order)
    target = f"{path.split('.version-')[0]}.version-{uuid.uuid4().hex}" if path else scratch(spark)
    merged.write.parquet(target)
    return target


def vector_table(df: DataFrame, path: str, properties: dict) -> None:
    """A vector table, and its properties beside it."""
    df.write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(properties, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}_properties.json")


def written(spark: SparkSession, path: str) -> bool:
    """Whether a job has written a folder to the end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def append_audit(df: DataFrame, path: str, batch: str | int | None = None) -> None:
    """Append records. With ``batch``, a name for just these records, doing it again makes no difference: a batch has a folder of
    its own, which is left alone once it is complete and written anew if a job broke off. For a stream: ``foreachBatch``."""
    target = f"{path}/batch={uuid.uuid4().hex if batch is None else batch}"
    if batch is not None and written(df.sparkSession, target):
        return
    df.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(target)


def audit_sink(events: DataFrame, path: str, state: str, trigger: dict | None = None):
    """A running query that appends a stream's records, each once, also where it is started again after a failure."""
    writer = events.writeStream.foreachBatch(lambda df, batch: append_audit(df, path, batch)).option("checkpointLocation", state)
    return (writer.trigger(**trigger) if trigger else writer).start()


def config_digest(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, bytes) of the files at a path."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def manifest(spark: SparkSession, path: str, config: dict, version: int = 1, strategy: str = "hierarchical") -> DataFrame:
    """File hashes with the version, the strategy and the digest of the configuration."""
    return file_hashes(spark, path).withColumns({"schema_version": F.lit(version), "strategy": F.lit(strategy), "config_sha256": F.lit(config_digest(config))})


def staleness(built: DataFrame | None, current: DataFrame, config: dict, version: int = 1, strategy: str = "hierarchical") -> str:
    """Why a built store no longer holds, the first of: missing, incomplete, invalid, strategy, config, file count, file hash; or fresh."""
    if built is None:
        return "missing"
    b, c = built.select("file", F.col("sha256").alias("__b"), "schema_version", "strategy", "config_sha256"), current.select("file", F.col("sha256").alias("__c"))
    row = (
        b.join(c, "file", "full_outer")
        .agg(
            F.count("schema_version").alias("n"),
            F.sum((F.col("schema_version") != version).cast("int")).alias("version"),
            F.sum((F.col("strategy") != strategy).cast("int")).alias("strategy"),
            F.sum((F.col("config_sha256") != config_digest(config)).cast("int")).alias("config"),
            F.sum((F.col("__b").isNull() | F.col("__c").isNull()).cast("int")).alias("files"),
            F.sum((F.col("__b") != F.col("__c")).cast("int")).alias("hashes"),
        )
        .first()
    )
    if not row["n"]:
        return "incomplete"
    for why in ("version", "strategy", "config", "files", "hashes"):
        if row[why]:
            return {"version": "invalid", "strategy": "strategy_mismatch", "config": "config_mismatch", "files": "file_count_mismatch", "hashes": "file_hash_mismatch"}[why]
    return "fresh"


def wiki_pages(entities: DataFrame, relations: DataFrame, key: str = "id", name: str = "name", kind: str = "kind") -> DataFrame:
    """(id, file, body): a Markdown page for each entity, with front matter and its relations as links."""
    from docloom.functions.text import file_name

    named = entities.select(F.col(key).alias("target_id"), F.col(name).alias("__target"))
    links = relations.join(named, "target_id").groupBy("source_id").agg(F.array_sort(F.collect_list(F.format_string("- %s: [[%s|%s]]", F.col("relationship_type"), F.col("target_id"), F.col("__target")))).alias("__links"))
    rows = entities.join(links.withColumnRenamed("source_id", key), key, "left")
    body = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("id: "), F.col(key)), F.concat(F.lit("kind: "), F.col(kind)), F.lit("---"), F.concat(F.lit("# "), F.col(name)), F.lit("## Relations"), F.array_join(F.coalesce("__links", F.array().cast("array<string>")), "\n"))
    return rows.select(F.col(key).alias("id"), F.concat(file_name(F.col(name)), F.lit(".md")).alias("file"), body.alias("body"))


def report(rows: DataFrame, title: str, limit: int = 1000) -> str:
    """A Markdown table of a small result; more rows than the limit are refused."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    head = f"| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}"
    return f"# {title}\n\n{head}\n" + "\n".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found) + "\n"
