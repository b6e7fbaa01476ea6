"""Relations and entities from texts and tables: candidates, typing, edges, validation, prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.patterns import find_patterns
from docloom.operators.segments import number_within
from docloom.shared import few


def first_rows(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__place = 1").drop("__place")


def candidates(docs: DataFrame, pattern: str = T.DOCUMENT_NUMBER, text: str = "text", key: str = "doc_id", own: Column | None = None, triggers=T.TRIGGERS, other: str = T.OTHER_TRIGGER) -> DataFrame:
    """(key, target, trigger, evidence) for every mention of a document number but the document's own; each once."""
    found = docs.withColumn("__own", F.lit(None).cast("string") if own is None else own).select(key, F.col(text).alias("__text"), "__own", F.explode(T.matches(F.coalesce(F.col(text), F.lit("")), pattern)).alias("m"))
    rows = found.select(key, F.upper(F.col("m.word")).alias("target"), T.evidence(F.col("__text"), F.col("m.start"), F.col("m.end")).alias("evidence"), "__own")
    rows = rows.filter(F.coalesce(F.upper("__own") != F.col("target"), F.lit(True))).withColumn("trigger", T.trigger(F.col("evidence"), triggers, other))
    return rows.filter(F.length("evidence") > 0).select(key, "target", "trigger", "evidence").distinct()


#: The relation that a trigger means, and whether it runs from the old document to the new.
TYPES = {"Sửa đổi, bổ sung": ("SUA_DOI_BO_SUNG", False), "Thay thế": ("THAY_THE_BOI", True), "Bãi bỏ": ("THAY_THE_BOI", True)}
OTHER_TYPE = "THAM_CHIEU"


def typed(found: DataFrame, source: str = "source", types=None, other: str = OTHER_TYPE) -> DataFrame:
    """(source, target, relationship_type, method, confidence, evidence); replacing relations are turned round."""
    types = TYPES if types is None else types
    # a citation whose surroundings speak of replacing or repealing is one as well
    low = F.lower("evidence")
    effective = F.col("trigger")
    for name, words in T.TRIGGERS:
        if types.get(name, ("", False))[1]:
            effective = F.when(~F.col("trigger").isin(*types) & low.contains(words[0]), F.lit(name)).otherwise(effective)
    rows = found.withColumn("__t", effective)
    kind = F.coalesce(*[F.when(F.col("__t") == t, F.lit(k)) for t, (k, _) in types.items()], F.lit(other))
    turned = F.coalesce(*[F.when(F.col("__t") == t, F.lit(r)) for t, (_, r) in types.items()], F.lit(False))
    return rows.select(
        F.when(turned, F.col("target")).otherwise(F.col(source)).alias("source"),
        F.when(turned, F.col(source)).otherwise(F.col("target")).alias("target"),
        kind.alias("relationship_type"), F.lit("rule_candidate").alias("method"),
        F.when(F.col("trigger").isin(*types), 0.90).otherwise(0.85).alias("confidence"), "evidence",
    )


#: The edge from a document to an entity of each type.
ENTITY_EDGES = {"CoQuan": "BAN_HANH_BOI", "NguoiKy": "KY_BOI", "DoiTuongApDung": "AP_DUNG_CHO", "LinhVuc": "THUOC_LINH_VUC"}


def entity_edges(entities: DataFrame, documents: DataFrame, edges=None) -> DataFrame:
    """(source, target, relationship_type, confidence): the document's number, or its id where it has none."""
    edges = ENTITY_EDGES if edges is None else edges
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in edges.items() for x in pair]), F.col("entity_type"))
    numbered = first_rows(documents.select(F.col("id").cast("string").alias("source_doc_id"), "number"), ["source_doc_id"], [F.col("number").asc_nulls_last()])
    met = entities.join(numbered, "source_doc_id", "left").withColumn("relationship_type", kind).filter("relationship_type is not null")
    return met.select(F.coalesce(F.nullif(F.trim("number"), F.lit("")), "source_doc_id").alias("source"), F.col("canonical_name").alias("target"), "relationship_type", "confidence")


def split_edges(rows: DataFrame, source: str, field: str, kind: str, by: str = ";", confidence: float = 0.95) -> DataFrame:
    """An edge for each part of a field of several values."""
    part = rows.select(F.col(source).cast("string").alias("source"), F.explode(F.split(field, by)).alias("target")).withColumn("target", F.trim("target"))
    return part.filter("target <> ''").select("source", "target", F.lit(kind).alias("relationship_type"), F.lit(confidence).alias("confidence")).distinct()


def validate_edges(edges: DataFrame, allowed: list[str], order: list[Column], entities: DataFrame | None = None, entity_kinds: list[str] | None = None) -> DataFrame:
    """Adds ``status`` and ``reasons``: missing parts, unknown type, an edge to itself, no evidence, a repeat of a valid edge.

    Names are compared without case. With ``entities`` (column name), targets of entity edges must be among them.
    """
    t = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = edges.withColumns({c: t(c) for c in ("source", "target", "relationship_type", "evidence")})
    same = (F.col("source") != "") & (F.col("target") != "") & (F.upper("source") == F.upper("target"))
    faults = [
        F.when(F.col("source") == "", "missing_source"), F.when(F.col("target") == "", "missing_target"), F.when(F.col("relationship_type") == "", "missing_type"),
        F.when((F.col("relationship_type") != "") & ~F.col("relationship_type").isin(*allowed), "unknown_type"),
        F.when(same, "self_loop"), F.when(F.col("evidence").isin("", "nan"), "missing_evidence"),
    ]
    if entities is not None:
        known = entities.select(F.col("name").alias("__name")).distinct()
        rows = rows.join(known, F.col("target") == F.col("__name"), "left")
        faults.append(F.when(F.col("relationship_type").isin(*(entity_kinds or ())) & F.col("__name").isNull(), "unknown_entity"))
        rows = rows.withColumn("reasons", F.array_compact(F.array(*faults))).drop("__name")
    else:
        rows = rows.withColumn("reasons", F.array_compact(F.array(*faults)))
    sound = F.size("reasons") == 0
    nth = F.sum(F.when(sound, 1).otherwise(0)).over(Window.partitionBy(F.upper("source"), F.upper("target"), "relationship_type").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("reasons", F.when(F.coalesce(nth, F.lit(0)) > 0, F.concat("reasons", F.array(F.lit("duplicate")))).otherwise(F.col("reasons")))
    return rows.withColumn("status", F.when(F.size("reasons") == 0, "PASS").otherwise("FAIL"))


def entities_from_metadata(rows: DataFrame, fields: dict[str, str], key: str = "id", confidence: float = 0.98) -> DataFrame:
    """(document_id, entity, entity_type, method, confidence) from metadata columns; marks of missing values give none."""
    each = F.explode(F.array(*[F.struct(F.lit(kind).alias("entity_type"), T.clean_null(F.col(c)).alias("entity")) for c, kind in fields.items()])).alias("e")
    return rows.select(F.col(key).cast("string").alias("document_id"), each).select("document_id", "e.entity", "e.entity_type", F.lit("metadata").alias("method"), F.lit(confidence).alias("confidence")).filter("entity is not null")


def entities_from_json(rows: DataFrame, json: str = "answer", key: str = "id", confidence: float = 0.85) -> DataFrame:
    """(document_id, entity, entity_type, method, confidence) from a model's JSON answer, however it is wrapped."""
    kind = "array<struct<name:string,type:string,confidence:double>>"
    found = F.explode(F.try_variant_get(T.json_part(F.col(json)), "$.entities", kind)).alias("e")
    return rows.select(F.col(key).cast("string").alias("document_id"), found).select("document_id", T.clean_null(F.col("e.name")).alias("entity"), F.col("e.type").alias("entity_type"), F.lit("llm").alias("method"), F.coalesce(F.col("e.confidence"), F.lit(confidence)).alias("confidence")).filter("entity is not null")


def dedup_entities(entities: DataFrame, canonical: Column, prefix: str = "ENT") -> DataFrame:
    """One row for each document, type and canonical name, with an id numbered within the type.

    Ids run over the sorted canonical names of a type, so they don't depend on the order of rows. They are numbered by ranges:
    a type of any size is no task's alone.
    """
    rows = entities.withColumn("canonical_name", canonical).filter(F.coalesce(F.col("canonical_name"), F.lit("")) != "")
    once = first_rows(rows, ["document_id", "entity_type", "canonical_name"], [F.desc("confidence"), F.col("entity")])
    placed = number_within(once, ["entity_type"], [F.col("canonical_name"), F.col("document_id")], "__place")
    number = F.format_string("%s_%s_%04d", F.lit(prefix), F.upper(F.substring("entity_type", 1, 3)), F.col("__place"))
    return placed.withColumn("entity_id", number).drop("__place")


def precedence_union(truth: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """All true relations, and the predicted ones of pairs that have none."""
    return truth.unionByName(predicted.join(truth.select(*key), key, "left_anti"))


def contained_in(texts: DataFrame, patterns: DataFrame, text: str = "text", pattern: str = "pattern", key: str = "doc_id", pattern_key: str = "item_id") -> DataFrame:
    """(key, pattern key) of every text and every pattern that it contains, in one pass over the texts."""
    named = patterns.select(F.col(pattern).alias("pattern"), pattern_key)
    return find_patterns(texts, named, text, "pattern", key).join(few(named), "pattern").select(key, pattern_key)


def by_id_or_number(edges: DataFrame, documents: DataFrame, end: str = "target") -> DataFrame:
    """Edges with the document that their end names by id or by number: two equi-joins instead of one with OR."""
    by_id = edges.join(documents.select(F.col("id").cast("string").alias(end), F.col("id").alias("document_id")), end)
    by_number = edges.join(documents.select(F.col("number").alias(end), F.col("id").alias("document_id")), end)
    return by_id.unionByName(by_number).distinct()
