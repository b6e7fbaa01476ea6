"""Rank fusion, reranking and selection. Lists are fused by union and one aggregation, not by outer joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.shared import few, numbered

#: Constant of reciprocal rank fusion; weights of the question itself and of its variants.
RRF_K, FIRST_WEIGHT, VARIANT_WEIGHT = 60, 1.5, 1.0


def _ranked(df: DataFrame, name: str, by: list[str], *order: Column) -> DataFrame:
    """The rows with their rank in each group; without a group in the whole table, by ranges."""
    if not by:
        return numbered(df, *order, name=name).withColumn(name, F.col(name).cast("int"))
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def fuse(first: DataFrame, second: DataFrame, key: str = "doc_id", question_key: str = "query_id", ranks=("bm25_rank", "semantic_rank"), weights=(1.0, 1.0), k: int = RRF_K, metadata: tuple[str, ...] = ()) -> DataFrame:
    """Weighted reciprocal rank fusion of two lists: (question, key, both ranks, rrf_score, best_rank, matched_by, fused_rank).

    Order: score, best rank, second rank, first rank with missing ones last, key. Columns of ``metadata`` are kept; an item
    for which the two lists tell different ones ends the job.
    """
    a, b = ranks
    if not any(weights):
        raise ValueError("one of the weights must be above zero")
    told = F.struct(*[F.col(c) for c in metadata] or [F.lit(None).alias("none")]).alias("__told")
    rows = first.select(question_key, key, F.col(a), F.lit(None).cast("int").alias(b), told).unionByName(second.select(question_key, key, F.lit(None).cast("int").alias(a), F.col(b), told))
    met = rows.groupBy(question_key, key).agg(F.min(a).alias(a), F.min(b).alias(b), F.min("__told").alias("__told"), F.max("__told").alias("__other"))
    fault = F.raise_error(F.concat(F.lit("the lists differ in what they tell of "), F.col(key).cast("string"))).cast("boolean")
    met = met.filter(F.when(F.col("__told").eqNullSafe(F.col("__other")), True).otherwise(fault)) if metadata else met
    met = met.select(question_key, key, a, b, *[F.col(f"__told.{c}").alias(c) for c in metadata])
    part = lambda c, w: F.coalesce(w / (k + F.col(c)), F.lit(0.0))
    scored = met.withColumn("rrf_score", part(a, weights[0]) + part(b, weights[1])).withColumn("best_rank", F.least(a, b))
    scored = scored.withColumn("matched_by", F.array_compact(F.array(F.when(F.col(a).isNotNull(), a.removesuffix("_rank")), F.when(F.col(b).isNotNull(), b.removesuffix("_rank")))))
    return _ranked(scored, "fused_rank", [question_key], F.round("rrf_score", 12).desc(), F.col("best_rank"), F.col(b).asc_nulls_last(), F.col(a).asc_nulls_last(), F.col(key))


def fuse_plain(first: DataFrame, second: DataFrame, key: str = "doc_id", question_key: str = "query_id", ranks=("bm25_rank", "semantic_rank"), k: int = RRF_K) -> DataFrame:
    """Unweighted fusion; ties in the order of insertion, the first list before the second; the score is rounded after sorting."""
    a, b = ranks
    fused = fuse(first, second, key, question_key, ranks, (1.0, 1.0), k).drop("fused_rank", "best_rank", "matched_by")
    fused = _ranked(fused, "fused_rank", [question_key], F.round("rrf_score", 12).desc(), F.col(a).asc_nulls_last(), F.col(b).asc_nulls_last())
    return fused.withColumn("rrf_score", F.round("rrf_score", 5))


def fuse_queries(hits: DataFrame, child: str = "child_id", query: str = "query_id", rank: str = "rank", k: int = RRF_K, question: list[str] | None = None) -> DataFrame:
    """Fusion over the variants of a question: (child, score rounded to 8, support, best_query_rank, per_query_ranks, merged_rank).

    The question itself (``Q0``) weighs more. The best place of a child in each query counts. The score is rounded before sorting.
    """
    by = question or []
    best = hits.groupBy(*by, query, child).agg(F.min(rank).alias(rank))
    weight = F.when(F.col(query) == "Q0", FIRST_WEIGHT).otherwise(VARIANT_WEIGHT)
    merged = best.groupBy(*by, child).agg(
        F.round(F.sum(weight / (k + F.col(rank))), 8).alias("score"),
        F.count(F.lit(1)).alias("support"),
        F.min(rank).alias("best_query_rank"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(query, rank)))).alias("per_query_ranks"),
    )
    return _ranked(merged, "merged_rank", by, F.desc("score"), F.desc("support"), F.col("best_query_rank"), F.col(child))


def support_counts(merged: DataFrame) -> DataFrame:
    """How many children are found by how many queries."""
    return merged.groupBy("support").agg(F.count(F.lit(1)).alias("n_children"))


def aggregate_parents(children: DataFrame, parent_of: DataFrame, child: str = "child_id", parent: str = "parent_id", rank: str = "merged_rank", ranks: str = "per_query_ranks", best: int = 3, k: int = RRF_K, question: list[str] | None = None) -> DataFrame:
    """(question, parent, score rounded to 8, n_children, n_queries, best_child_rank, anchor, parent_rank).

    The best children of a parent make its score; all its children, and the queries that found any of them (the keys
    of ``ranks``, where the children have it), count. Order: score, queries, best rank, parent.
    """
    by = question or []
    queries = F.map_keys(ranks) if ranks in children.columns else F.array().cast("array<string>")
    met = children.withColumn("__queries", queries).join(parent_of.select(child, parent), child)
    placed = _ranked(met, "__place", [*by, parent], F.col(rank), F.col(child))
    scored = placed.groupBy(*by, parent).agg(
        F.round(F.sum(F.when(F.col("__place") <= best, 1.0 / (k + F.col(rank)))), 8).alias("score"),
        F.count(F.lit(1)).alias("n_children"),
        F.size(F.array_distinct(F.flatten(F.collect_set("__queries")))).alias("n_queries"),
        F.min(rank).alias("best_child_rank"),
        F.min_by(child, F.struct(rank, child)).alias("anchor"),
    )
    return _ranked(scored, "parent_rank", by, F.desc("score"), F.desc("n_queries"), F.col("best_child_rank"), F.col(parent))


def missing_parents(children: DataFrame, parent_of: DataFrame, child: str = "child_id") -> DataFrame:
    """Children that no parent is known for: must be empty before parents are aggregated."""
    return children.join(parent_of, child, "left_anti")


def gate(evidence: DataFrame, mode: str, most_distance: float = 0.45, least_score: float = 0.5) -> DataFrame:
    """Adds ``accepted``: a near enough distance, or for reranked rows a high enough score; a missing one is refused."""
    if mode == "hybrid_rerank":
        ok = F.col("rerank_score") >= least_score
    elif mode in ("bm25", "semantic", "hybrid"):
        ok = F.col("distance") <= most_distance
    else:
        raise ValueError(f"unknown mode: {mode}")
    return evidence.withColumn("accepted", F.coalesce(ok, F.lit(False)))


#: Legal terms that a question and a text may share; those that call for the second and third lists; terms
#: that then count in the text; and terms with a bonus of their own.
TERMS = ("điều kiện", "cho vay", "tín dụng", "vốn", "không được", "không được cho vay", "quy định", "khách hàng", "hồ sơ", "điều", "khoản", "trường hợp", "người vay", "thỏa thuận")
CALLS = ("cho vay", "tín dụng", "không được", "điều kiện", "khách hàng")
CALLED = ("cho vay", "không được", "khách hàng", "điều kiện", "hồ sơ", "quy định")
BONUS = {"điều": 0.06, "khoản": 0.06, "trường hợp": 0.06, "không được": 0.08, "cho vay": 0.08}
ASKED = ("điều kiện", "quy định", "không được", "trường hợp")


def score_words(text: Column) -> Column:
    """The distinct words of a text that the heuristic score compares."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def with_texts(candidates: DataFrame, questions: DataFrame, docs: DataFrame, question: str = "question", text: str = "text", key: str = "doc_id", question_key: str = "query_id") -> DataFrame:
    """Candidates with the lower-cased question and text and the distinct words of both (``question_words``, ``text_words``).

    Only texts that are candidates are read on, and each is taken apart once, before it meets its questions.
    """
    asked = questions.select(question_key, F.lower(question).alias(question), score_words(F.col(question)).alias("question_words"))
    some = docs.join(few(candidates.select(key).distinct()), key, "left_semi")
    texts = some.select(key, F.lower(text).alias(text), score_words(F.col(text)).alias("text_words"))
    return candidates.join(texts, key).join(few(asked), question_key)


def heuristic_score(question: Column, text: Column, terms=TERMS, calls=CALLS, called=CALLED, bonus=None, asked=ASKED, shared: Column | None = None) -> Column:
    """A rerank score without a model: shared words up to 12 at 0.06 each, shared terms, and bonuses.

    ``shared`` is the number of shared words, where it is known already.
    """
    bonus = BONUS if bonus is None else bonus
    q, t = F.lower(question), F.lower(text)
    both = lambda w: q.contains(w) & t.contains(w)
    points = lambda cond, p: F.when(cond, p).otherwise(0.0)
    anyof = lambda c, ws: F.array_contains(F.array(*[c.contains(w) for w in ws]), True)
    shared = F.size(F.array_intersect(score_words(question), score_words(text))) if shared is None else shared
    score = F.least(shared, F.lit(12)) * 0.06
    for w in terms:
        score = score + points(both(w), 0.12)
    called_score = F.lit(0.0)
    for w in called:
        called_score = called_score + points(t.contains(w), 0.04)
    score = score + F.when(anyof(q, calls), called_score).otherwise(0.0)
    for w, p in bonus.items():
        score = score + points(both(w), p)
    return F.coalesce(score, F.lit(0.0)) + points(anyof(q, asked), 0.05)


def rerank(candidates: DataFrame, raw: Column | Callable[[Column], Column] | None, prior: str = "fused_rank", key: str = "doc_id", question_key: str = "query_id", k: int | None = None, most_chars: int | None = None, text: str = "text", digits: int | None = None) -> DataFrame:
    """Adds raw score, its sigmoid, the new rank and the change of rank; order: score, prior rank, key.

    ``raw`` may be any column, so a model comes in as an Arrow function; or a function of the text column, which then is
    cut to its first ``most_chars`` characters, as models with short inputs need; or None, where no model is at hand: then
    the prior order stays and scores are null. Scores are rounded to ``digits`` before they are sorted.
    """
    if callable(raw) and not isinstance(raw, Column):
        raw = raw(F.col(text) if most_chars is None else F.substring(text, 1, most_chars))
    elif most_chars is not None:
        raise ValueError("a text is cut only for a function of the text")
    scored = candidates.withColumn("rerank_raw_score", F.lit(None).cast("double") if raw is None else raw)
    sigmoid = 1 / (1 + F.exp(-F.col("rerank_raw_score")))
    scored = scored.withColumn("rerank_score", sigmoid if digits is None else F.round(sigmoid, digits))
    ranked = _ranked(scored, "final_rank", [question_key], F.round("rerank_score", 12).desc(), F.col(prior), F.col(key))
    ranked = ranked.withColumn("rank_change", F.col(prior) - F.col("final_rank"))
    return ranked if k is None else ranked.filter(F.col("final_rank") <= k)


#: Modes of a run over one list of texts, and of a run over the variants of a question.
MODES = ("bm25", "semantic", "hybrid", "hybrid_rerank")
PARENT_MODES = ("single_flat", "multi_flat", "single_parent", "multi_parent")


def run_query(mode: str, bm25: Callable[[], DataFrame], semantic: Callable[[], DataFrame], rerank_with: Callable[[DataFrame], DataFrame] | None = None, k: int = 5, key: str = "doc_id", question_key: str = "query_id") -> DataFrame:
    """(mode, question, key, rank) of the first ``k`` in one of ``MODES``. Only the lists that the mode needs are built."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "bm25":
        rows, rank = bm25(), "bm25_rank"
    elif mode == "semantic":
        rows, rank = semantic(), "semantic_rank"
    else:
        rows, rank = fuse(bm25(), semantic(), key, question_key), "fused_rank"
        if mode == "hybrid_rerank":
            if rerank_with is None:
                raise ValueError("this mode needs a reranker")
            rows, rank = rerank_with(rows), "final_rank"
    return rows.filter(F.col(rank) <= k).select(F.lit(mode).alias("mode"), question_key, key, F.col(rank).alias("rank"))


def run_parent_query(mode: str, hits: DataFrame, parent_of: DataFrame | None = None, k: int = 5, child: str = "child_id", parent: str = "parent_id", query: str = "query_id", rank: str = "rank") -> DataFrame:
    """(mode, id, rank) of the first ``k`` children or parents in one of ``PARENT_MODES``.

    Single modes take the hits of the question itself (``Q0``), the others those of its variants too.
    """
    if mode not in PARENT_MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode.endswith("parent") and parent_of is None:
        raise ValueError("this mode needs the parents of children")
    merged = fuse_queries(hits.filter(F.col(query) == "Q0") if mode.startswith("single") else hits, child, query, rank)
    if mode.endswith("flat"):
        rows, name, place = merged, child, "merged_rank"
    else:
        rows, name, place = aggregate_parents(merged, parent_of, child, parent), parent, "parent_rank"
    return rows.filter(F.col(place) <= k).select(F.lit(mode).alias("mode"), F.col(name).cast("string").alias("id"), F.col(place).alias("rank"))


def within_budget(parents: DataFrame, budget: int = 16_000, size: str = "char_count", rank: str = "parent_rank", key: str = "parent_id", question_key: str = "query_id") -> DataFrame:
    """Adds ``selected`` and ``oversized``: in order of rank a parent is taken if it still fits; the first is taken in any case.

    A fold over the short candidate list of each question; a later smaller parent may still fit.
    """
    row = F.struct(F.col(rank).alias("rank"), F.col(key).alias("key"), F.col(size).cast("long").alias("size"))
    listed = parents.groupBy(question_key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    key_type = parents.schema[key].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("taken"), F.array().cast(f"array<struct<key:{key_type},selected:boolean,oversized:boolean>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        fits = acc["used"] + r["size"] <= budget
        take = fits | (acc["taken"] == 0)
        mark = F.struct(r["key"].alias("key"), take.alias("selected"), (take & ~fits).alias("oversized"))
        return F.struct((acc["used"] + F.when(take, r["size"]).otherwise(0)).alias("used"), (acc["taken"] + F.when(take, 1).otherwise(0)).alias("taken"), F.concat(acc["out"], F.array(mark)).alias("out"))

    marked = listed.select(question_key, F.explode(F.aggregate("rows", start, step)["out"]).alias("m")).select(question_key, F.col("m.key").alias(key), "m.selected", "m.oversized")
    return parents.join(marked, [question_key, key])


def cut_stages(ranked: DataFrame, candidates: int, final: int, rank: str = "parent_rank") -> DataFrame:
    """Adds ``stage``: final, dropped after candidates, or dropped before them."""
    return ranked.withColumn("stage", F.when(F.col(rank) <= final, "final").when(F.col(rank) <= candidates, "dropped_by_final").otherwise("dropped_by_candidates"))


#: What a variant of a question may focus on.
FOCUSES = ("legal_terms", "conditions", "exceptions", "procedure", "synonyms")


def valid_variants(variants: DataFrame, allowed: Column, text: str = "text", focus: str = "focus", query_key: str = "question_id", place: str = "place", focuses=FOCUSES, most: int = 3, most_chars: int = 300) -> DataFrame:
    """Adds ``kept`` and ``reason``: known focus, length, references within the question's, no repeats, at most ``most``.

    Where the question has references and no kept variant holds one of them, none is kept.
    """
    wording = T.collapse(F.col(text))
    found = T.references(wording)
    reason = F.when(F.coalesce(wording, F.lit("")) == "", "empty").when(~F.coalesce(F.col(focus).isin(*focuses), F.lit(False)), "focus").when(F.length(wording) > most_chars, "length").when(~T.references_allowed(found, allowed), "reference")
    judged = variants.withColumn("__allowed", allowed).withColumn("__found", found).withColumn("reason", reason).withColumn("__key", T.dedup_key(F.col(text)))
    fresh = F.row_number().over(Window.partitionBy(query_key, "__key", F.col("reason").isNull()).orderBy(place))
    judged = judged.withColumn("reason", F.when(F.col("reason").isNull() & (fresh > 1), "repeat").otherwise(F.col("reason")))
    nth = F.sum(F.when(F.col("reason").isNull(), 1).otherwise(0)).over(Window.partitionBy(query_key).orderBy(place))
    judged = judged.withColumn("reason", F.when(F.col("reason").isNull() & (nth > most), "limit").otherwise(F.col("reason")))
    holds = F.max(F.when(F.col("reason").isNull() & F.arrays_overlap("__found", "__allowed"), 1).otherwise(0)).over(Window.partitionBy(query_key))
    judged = judged.withColumn("reason", F.when(F.col("reason").isNull() & (F.size("__allowed") > 0) & (holds == 0), "no_reference").otherwise(F.col("reason")))
    return judged.withColumn("kept", F.col("reason").isNull()).drop("__allowed", "__found", "__key")


def status(n_evidence: Column, n_accepted: Column, reranker: Column, generated: Column, citations_ok: Column) -> Column:
    """How a run ended."""
    return (
        F.when(~reranker, "reranker_unavailable")
        .when((n_evidence == 0) | (n_accepted == 0), "insufficient_evidence")
        .when(~generated, "retrieval_only")
        .when(~citations_ok, "citation_validation_failed")
        .otherwise("answered")
    )


def mode_status(mode: str, n_selected: Column, n_failed: Column, citations_ok: Column | None = None) -> Column:
    """How a run over the variants of a question ended: nothing selected, citations refused, variants failed, or all well."""
    name = "parent" if mode.endswith("parent") else mode
    refused = F.lit(False) if citations_ok is None else ~citations_ok
    return F.when(n_selected == 0, "insufficient_evidence").when(refused, "citation_validation_failed").when(n_failed > 0, f"{name}_partial").otherwise(f"{name}_ready")


def query_key(question: Column, config: str = "") -> Column:
    """The key of a question's variants in a cache: its wording without case and spare blanks, and the configuration."""
    return F.sha2(F.concat_ws("|", F.lower(T.collapse(question)), F.lit(config)), 256)


def cached_variants(questions: DataFrame, cache: DataFrame, question: str = "question", config: str = "") -> tuple[DataFrame, DataFrame]:
    """Questions with the variants that the cache (query_key, variants) has for them, and questions that it hasn't."""
    keyed = questions.withColumn("query_key", query_key(F.col(question), config))
    return keyed.join(cache.dropDuplicates(["query_key"]), "query_key"), keyed.join(cache, "query_key", "left_anti")


def run_queries(queries: list[str], search, first: str = "Q0") -> tuple[DataFrame | None, dict[str, str]]:
    """The hits of every query, and what went wrong: a variant that fails is left out, a failure of the first ends the run.

    ``search(query_id)`` builds and checks a plan; nothing is collected here.
    """
    hits, failed = None, {}
    for q in queries:
        try:
            found = search(q)
        except Exception as e:
            if q == first:
                raise
            failed[q] = str(e)
            continue
        hits = found if hits is None else hits.unionByName(found)
    return hits, failed
