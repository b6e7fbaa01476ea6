"""Sources. Schemas are declared, never inferred; files are read by Spark's readers, so any store that Spark knows will do."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import collapse
from docloom.operators.security import ROLES, parse_roles
from docloom.sources import json_arrays

CHUNK = "chunk_id string, strategy string, source string, page_start int, page_end int, text string, structure string"


def _parsed(value: str = "value") -> Column:
    """An element as a variant; one that is no JSON ends the job, with the name of its file."""
    return F.coalesce(F.try_parse_json(value), F.raise_error(F.concat(F.lit("not JSON: "), F.col("input_file"))))


def _chunk_rows(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON files that hold an array, or an object with a list ``chunks``; with the file's name."""
    each = json_arrays.elements(spark, path, "chunks").select("input_file", "place", _parsed().alias("c"))
    field = lambda n, t: F.try_variant_get("c", f"$.{n}", t).alias(n)
    return each.select("input_file", "place", field("chunk_id", "string"), field("strategy", "string"), field("source", "string"), field("page_start", "int"), field("page_end", "int"), field("text", "string"), F.try_variant_get("c", "$.structure", "variant").alias("structure"))


def chunks(spark: SparkSession, path: str, strategy: str) -> DataFrame:
    """Chunks of one strategy, those without id or text left out, white space collapsed."""
    rows = _chunk_rows(spark, path).filter(F.col("strategy") == strategy).withColumn("text", collapse(F.col("text")))
    return rows.filter((F.coalesce(F.trim("chunk_id"), F.lit("")) != "") & (F.coalesce(F.col("text"), F.lit("")) != "")).drop("input_file", "place")


def strict_chunks(spark: SparkSession, path: str, strategies: tuple[str, ...] = ("fixed-size", "semantic", "hierarchical")) -> DataFrame:
    """All chunks with ``fault``: a missing id, an unknown strategy, pages out of order, an id that another row has too."""
    rows = _chunk_rows(spark, path).withColumn("text_missing", F.coalesce(F.trim("text"), F.lit("")) == "")
    repeated = rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("__n"))
    met = rows.join(repeated, "chunk_id", "left")
    fault = (
        F.when(F.coalesce(F.trim("chunk_id"), F.lit("")) == "", "chunk_id")
        .when(~F.coalesce(F.col("strategy").isin(*strategies), F.lit(False)), "strategy")
        .when(F.coalesce(F.col("page_start") < 0, F.lit(True)) | F.coalesce(F.col("page_end") < F.col("page_start"), F.lit(True)), "pages")
        .when(F.col("__n") > 1, "repeated")
    )
    return met.select(*[c for c in met.columns if c not in ("text_missing", "__n")], fault.alias("fault"), "text_missing")


def sound(rows: DataFrame, fault: str = "fault") -> DataFrame:
    """The rows as they are; reading one with a fault ends the job."""
    return rows.filter(F.when(F.col(fault).isNull(), True).otherwise(F.raise_error(F.concat(F.lit("faulty row: "), F.col(fault))).cast("boolean"))).drop(fault)


def csv(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A CSV table with a header, fields of any length over several lines, and a byte-order mark or none."""
    head = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).csv(path, enforceSchema=False, inferSchema=False)
    names = {c.lstrip("﻿").strip(): c for c in head.columns}
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    fields = T._parse_datatype_string(schema).fields
    return head.select(*[(F.col(f"`{names[f.name]}`") if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Document metadata with one key column ``id``, from ``id`` or ``doc_id``, trimmed; of repeated keys the last row.

    The last is that of the last file by path, and in a file the last one: a file over several lines is read by one task.
    """
    rows = csv(spark, path, schema).select("*", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__place"))
    key = F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in ("id", "doc_id") if c in rows.columns])
    keyed = rows.withColumn("id", key).filter("id is not null")
    columns = [c for c in keyed.columns if not c.startswith("__")]
    last = keyed.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("__file", "__place")).alias("r"))
    return last.select("r.*")


def relationships(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, other_doc_id, relationship_type); the type falls back to the wording; both ids must be there."""
    rows = csv(spark, path, "doc_id string, other_doc_id string, relationship string, relationship_type string")
    rows = rows.select("doc_id", "other_doc_id", F.coalesce(F.nullif(F.trim("relationship_type"), F.lit("")), "relationship").alias("relationship_type"))
    return rows.filter((F.coalesce(F.trim("doc_id"), F.lit("")) != "") & (F.coalesce(F.trim("other_doc_id"), F.lit("")) != ""))


def secure_chunks(rows: DataFrame, column: str = "allowed_roles") -> DataFrame:
    """Rows with roles as a list; without that column every role may see every row."""
    everyone = F.array(*[F.lit(r) for r in ROLES])
    return rows.withColumn(column, F.coalesce(parse_roles(F.col(column)), everyone) if column in rows.columns else everyone)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, question, relevant): a JSON array of questions. A file that holds anything else ends the call."""
    try:
        raw = json_arrays.elements(spark, path).select(_parsed().alias("q"))
    except ValueError as fault:
        raise ValueError(f"questions must be a JSON array: {fault}") from fault
    get = lambda n, t: F.try_variant_get("q", f"$.{n}", t)
    return raw.select(F.coalesce(get("question_id", "string"), get("id", "string")).alias("question_id"), get("question", "string").alias("question"), F.coalesce(get("relevant_child_ids", "array<string>"), get("relevant_chunk_ids", "array<string>"), F.array().cast("array<string>")).alias("relevant"))


def markdown_pages(spark: SparkSession, path: str) -> DataFrame:
    """(id, file, body): the id from the front matter, else null."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("body"), F.col("_metadata.file_name").alias("file"))
    return raw.select(F.nullif(F.regexp_extract("body", r"(?m)^id:\s*(\S+)", 1), F.lit("")).alias("id"), "file", "body")


AUDIT = "timestamp timestamp, request_id string, user_role string, action string, query string, returned_ids array<string>, filtered_count long, status string, metadata map<string,string>"

#: Times with or without parts of a second.
AUDIT_TIME = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]"


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).option("timestampFormat", AUDIT_TIME).option("recursiveFileLookup", True).json(path)


#: What holds where no policy file is given.
DEFAULT_POLICY = {"roles": {r: {"level": 5 - i} for i, r in enumerate(ROLES)}, "default_policy": "DENY", "unknown_role_handling": "DENY"}


def policy(spark: SparkSession, path: str | None = None) -> dict:
    """A role policy, a small file read on the driver."""
    return dict(DEFAULT_POLICY) if path is None else json.loads(spark.read.text(path, wholetext=True).first()["value"])


def vectors(spark: SparkSession, path: str, expected: dict | None = None) -> DataFrame:
    """A vector table; its properties, in ``_properties.json`` beside it, must agree with those expected."""
    if expected:
        found = json.loads(spark.read.text(f"{path}_properties.json", wholetext=True).first()["value"])
        different = {k: (v, found.get(k)) for k, v in expected.items() if found.get(k) != v}
        if different:
            raise ValueError(f"vectors were made otherwise: {different}")
    return spark.read.parquet(path)


def cached_vectors(texts: DataFrame, cache: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts whose vector is cached, by the hash of the text, and texts that still need one."""
    keyed = texts.withColumn("text_hash", F.sha2(F.col(text), 256))
    return keyed.join(cache, "text_hash"), keyed.join(cache, "text_hash", "left_anti")
