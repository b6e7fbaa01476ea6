"""Chunking and hierarchies: article splitting, block trees, structural paths, packing children into parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.segments import carry_forward, pack_windows

#: Levels from the outside in, and how a block of each begins.
LEVELS = {"document": 0, "chapter": 1, "section": 2, "article": 3, "clause": 4, "item": 5, "content": 6}
BEGINNINGS = {
    "chapter": r"(?iu)^Chương\b",
    "section": r"(?iu)^Mục\b",
    "article": r"(?iu)^Điều\b",
    "clause": r"(?iu)^(?:\d+\.|Khoản\b)",
    "item": r"(?iu)^(?:[a-z]\)|[a-z]\.|\([a-z]\)|Điểm\b)",
}
#: Headings at the start of a chunk, by key of its path.
HEADINGS = {
    "chapter": r"(?iu)^(Chương\s+.+)",
    "article": r"(?iu)^(Điều\s+\d+)(?=[\s.:;\-–]|$)",
    "clause": r"(?iu)^(Khoản\s+[IVX0-9]+)(?=[\s.:;\-–]|$)",
    "point": r"(?iu)^(Điểm\s+[a-zA-Z0-9]+)(?=[\s.:;\-–]|$)",
}
PATH = tuple(HEADINGS)
#: Fixed value: a line that opens an article.
ARTICLE_LINE = r"(?iu)^Điều\s+\d+"
#: Characters of a label. On collapsed text the chapter pattern goes on to the end of the chunk.
LONGEST_LABEL = 120


def split_articles(docs: DataFrame, text: str = "text", key: str = "doc_id", heading: str = ARTICLE_LINE, least: int = 20) -> DataFrame:
    """Rows (key, chunk_no, chunk_id, article, text): a line that matches opens a chunk, lines before are the preamble.

    Chunks of ``least`` characters or fewer go; numbers run over those that stay.
    """
    lines = docs.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("place", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    order = Window.partitionBy(key).orderBy("place")
    part = lines.withColumn("segment", F.sum(F.when(F.col("line").rlike(heading), 1).otherwise(0)).over(order))
    joined = part.groupBy(key, "segment").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("rows"))
    whole = joined.withColumn("text", T.tidy_lines(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))).filter(F.length("text") > least)
    numbered = whole.withColumn("chunk_no", F.row_number().over(Window.partitionBy(key).orderBy("segment")))
    article = F.when(F.col("segment") > 0, F.col("rows")[0]["line"]).otherwise("")
    return numbered.select(key, "chunk_no", F.format_string("%s_c%03d", F.col(key).cast("string"), F.col("chunk_no")).alias("chunk_id"), article.alias("article"), "text")


def block_level(text: Column, beginnings=None) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), F.lit(level)) for level, p in (beginnings or BEGINNINGS).items()], F.lit("content"))


def block_tree(blocks: DataFrame, key: str = "page_id", place: str = "place", text: str = "text", beginnings=None) -> DataFrame:
    """Adds block_id, level, parent_id and next_id. A heading stands under the last one of a level further out;
    content stands under the last heading; siblings are chained in order."""
    order = Window.partitionBy(key).orderBy(place)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.withColumn("block_no", F.row_number().over(order)).withColumn("block_id", F.format_string("%s:%03d", F.col(key).cast("string"), F.col("block_no"))).withColumn("level", block_level(F.col(text), beginnings))
    depth = F.element_at(F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair]), F.col("level"))
    rows = rows.withColumn("__depth", depth)
    heading = F.when(F.col("level") != "content", F.struct("block_no", "block_id"))
    # the last heading of each level so far, with its place; one opened later at a level further out or the same closes it
    last = {n: F.last(F.when(F.col("__depth") == n, F.struct("block_no", "block_id")), ignorenulls=True).over(before) for n in range(1, 6)}
    rows = rows.withColumns({f"__last{n}": c for n, c in last.items()}).withColumn("__any", F.last(heading, ignorenulls=True).over(before))
    parent = F.coalesce(F.greatest(*[F.when(F.col("__depth") > n, F.col(f"__last{n}")) for n in range(1, 6)])["block_id"], F.col(key).cast("string"))
    rows = rows.withColumn("parent_id", F.when(F.col("level") == "content", F.coalesce(F.col("__any.block_id"), F.col(key).cast("string"))).otherwise(parent))
    rows = rows.withColumn("next_id", F.lead("block_id").over(Window.partitionBy(key, "parent_id").orderBy("block_no")))
    return rows.drop("__depth", "__any", *[f"__last{n}" for n in range(1, 6)])


def headings(text: Column, patterns=None, longest: int | None = LONGEST_LABEL) -> Column:
    """A struct of the headings at the start of a text, cut to ``longest`` characters; None keeps whatever a pattern matches."""
    flat = T.collapse(text)

    def label(p: str) -> Column:
        found = F.regexp_extract(flat, p, 1)
        return F.nullif(F.trim(found if longest is None else F.substring(found, 1, longest)), F.lit(""))

    return F.struct(*[label(p).alias(k) for k, p in (patterns or HEADINGS).items()])


def structure_path(structure: Column) -> Column:
    """A struct of labels from a variant: an object of labels, or a list of typed nodes, the first of each type."""
    label = lambda k: F.try_variant_get(structure, f"$.{k}", "string")
    nodes = F.try_variant_get(structure, "$", "array<struct<type:string,label:string>>")
    first = lambda k: F.get(F.filter(nodes, lambda n: (F.lower(F.trim(n["type"])) == k) & n["label"].isNotNull()), F.lit(0))["label"]
    return F.struct(*[F.nullif(F.trim(F.coalesce(label(k), first(k))), F.lit("")).alias(k) for k in PATH])


def resolve_paths(chunks: DataFrame, source: str = "source", key: str = "chunk_id", text: str = "text", metadata: Column | None = None, patterns=None, longest: int | None = LONGEST_LABEL) -> DataFrame:
    """Adds path, resolution_method, ambiguous and warnings.

    Labels from metadata come before those of a heading, these before labels carried on inside the source in natural
    order of the keys, and these before none. A row that carries labels on repeats them, so only own labels are carried.
    Keys are expected to be unique in a source; only they and the labels are sorted, by ranges, so that a source of any size
    is no task's alone, and texts are joined once after that.
    """
    none = F.struct(*[F.lit(None).cast("string").alias(k) for k in PATH])
    labels = chunks.select(F.col(source).alias("__source"), F.col(key).alias("__id"), (none if metadata is None else metadata).alias("__meta"), headings(F.col(text), patterns, longest).alias("__head"))
    found = _labels_resolved(labels.dropDuplicates(["__source", "__id"]), none)
    met = F.col(source).eqNullSafe(F.col("__source")) & F.col(key).eqNullSafe(F.col("__id"))
    return chunks.join(found, met).select(*chunks.columns, "resolution_method", "path", "ambiguous", "warnings")


def _labels_resolved(rows: DataFrame, none: Column) -> DataFrame:
    some = lambda s: F.coalesce(*[F.col(f"{s}.{k}") for k in PATH]).isNotNull()
    rows = rows.withColumn("__own", F.when(some("__meta"), F.col("__meta")).when(some("__head"), F.col("__head")))
    rows = carry_forward(rows.withColumns({f"__own_{k}": F.col(f"__own.{k}") for k in PATH}), ["__source"], [T.natural_key(F.col("__id")), F.col("__id")], {f"__own_{k}": f"__last_{k}" for k in PATH})
    rows = rows.withColumn("__carried", F.struct(*[F.col(f"__last_{k}").alias(k) for k in PATH])).drop(*[f"__{n}_{k}" for n in ("own", "last") for k in PATH])
    carried = F.coalesce(F.col("__carried.article"), F.col("__carried.chapter")).isNotNull()
    method = F.when(some("__meta"), "metadata").when(some("__head"), "heading_inferred").when(carried, "carried_forward").otherwise("document_fallback")
    rows = rows.withColumn("resolution_method", method).withColumn("path", F.when(F.col("__own").isNotNull(), F.col("__own")).when(carried, F.col("__carried")).otherwise(none))
    conflict = F.lit(False)
    for k in PATH:
        conflict = conflict | F.coalesce(F.lower(F.trim(F.col(f"__meta.{k}"))) != F.lower(F.trim(F.col(f"__head.{k}"))), F.lit(False))
    ambiguous = some("__meta") & some("__head") & conflict
    inferred = F.col("resolution_method") == "heading_inferred"
    warnings = F.array_compact(
        F.array(
            F.when(ambiguous, "metadata_heading_conflict"),
            F.when(inferred & F.col("path.article").isNull() & F.col("path.clause").isNotNull() & F.col("path.chapter").isNull(), "clause_without_article"),
            F.when(F.col("resolution_method") == "document_fallback", "document_fallback"),
            F.when(F.col("resolution_method").isin("metadata", "heading_inferred") & F.col("path.article").isNull(), "article_missing"),
        )
    )
    return rows.withColumn("ambiguous", ambiguous).withColumn("warnings", warnings).drop("__meta", "__head", "__own", "__carried")


def pack(children: DataFrame, by: list[str], order: list[Column], size: Column, limit: int = 6000, key: str = "chunk_id") -> DataFrame:
    """Adds ``window_index``: in order, children fill a window until the next would go beyond the limit.

    Only groups, keys, orders and sizes are sorted, by ranges, so that a group of any size is no task's alone; the children are
    joined once after that. A child that is too long by itself has a window of its own. Rows that repeat a key of their group
    share the window of one of them.
    """
    names = [f"__by{i}" for i in range(len(by))]
    narrow = children.select(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], F.col(key).alias("__id"), size.cast("long").alias("__size"), *[c.alias(f"__o{i}") for i, c in enumerate(order)])
    once = narrow.groupBy(*names, "__id").agg(F.min(F.struct(*[f"__o{i}" for i in range(len(order))], "__size")).alias("__first")).select(*names, "__id", "__first.*")
    windows = pack_windows(once, names, [*[F.col(f"__o{i}") for i in range(len(order))], F.col("__id")], "__size", limit)
    met = F.col(key).eqNullSafe(F.col("__id"))
    for b, n in zip(by, names, strict=True):
        met = met & F.col(b).eqNullSafe(F.col(n))
    return children.join(windows.select(*names, "__id", "window_index"), met).drop(*names, "__id")


def build_parents(children: DataFrame, limit: int = 6000, source: str = "source", key: str = "chunk_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Parents of resolved children, and the children with their parent_id.

    Children of one source and article are packed in natural order; lengths of separators don't count. A parent has the
    least first and the greatest last page of its children, where they have pages, and warns of a child that is longer
    than the limit by itself, and of children that nothing but the fallback places.
    """
    rows = children.withColumn("article_key", F.coalesce(F.lower(F.trim(F.col("path.article"))), F.lit("document")))
    packed = pack(rows, [source, "article_key"], [T.natural_key(F.col(key))], F.length(text), limit, key)
    packed = packed.withColumn("parent_id", T.stable_id(F.col(source), F.col("article_key"), F.col("window_index").cast("string")))
    item = F.struct(T.natural_key(F.col(key)).alias("order"), F.col(key).alias("id"), F.col(text).alias("text"), "path", "warnings")
    page = lambda c: F.col(c) if c in children.columns else F.lit(None).cast("int")
    fallback = (F.col("resolution_method") == "document_fallback") & (F.col("article_key") == "document")
    grouped = packed.groupBy("parent_id", source, "article_key", "window_index").agg(
        F.array_sort(F.collect_list(item)).alias("rows"), F.sum(F.col("ambiguous").cast("int")).alias("ambiguous_child_count"),
        F.min(page("page_start")).alias("page_start"), F.max(page("page_end")).alias("page_end"),
        F.bool_or(F.length(text) > limit).alias("__oversized"), F.bool_or(fallback).alias("__fallback"),
    )
    joined = F.array_join(F.transform("rows", lambda r: r["text"]), "\n\n")
    first = lambda k: F.get(F.filter(F.transform("rows", lambda r: r["path"][k]), lambda v: v.isNotNull()), F.lit(0))
    own = F.array_compact(F.array(F.when(F.col("__fallback"), "document_fallback_parent"), F.when(F.col("__oversized"), "oversized_single_child")))
    parents = grouped.select(
        "parent_id", source, "article_key", "window_index", "page_start", "page_end", F.transform("rows", lambda r: r["id"]).alias("child_ids"), joined.alias("text"), F.length(joined).alias("char_count"), "ambiguous_child_count",
        F.array_distinct(F.concat(own, F.flatten(F.transform("rows", lambda r: r["warnings"])))).alias("warnings"), F.struct(*[first(k).alias(k) for k in PATH]).alias("structural_path"),
    )
    return parents, packed


def twice_assigned(packed: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Children with more than one parent: must be empty."""
    return packed.groupBy(key).agg(F.countDistinct("parent_id").alias("n")).filter("n > 1")


def hierarchy_summary(parents: DataFrame, packed: DataFrame) -> DataFrame:
    a = parents.agg(F.count(F.lit(1)).alias("n_parents"), F.max("char_count").alias("longest_parent"), F.sum("ambiguous_child_count").alias("n_ambiguous"))
    b = packed.agg(F.count(F.lit(1)).alias("n_children"), F.sum(F.when(F.col("resolution_method") == "document_fallback", 1).otherwise(0)).alias("n_fallback"))
    return a.crossJoin(b)
