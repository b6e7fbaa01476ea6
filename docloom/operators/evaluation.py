"""Retrieval and relation metrics over many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.shared import beside


def recall_at(predicted: Column, relevant: Column, k: int, n_relevant: Column | None = None) -> Column:
    """Share of the relevant ids among the first k; 0 without relevant ids. Repeats in the list count once each.

    Where there are many, ``relevant`` may have those of the predicted ids only, and ``n_relevant`` how many there are in all."""
    hits = F.size(F.filter(F.slice(predicted, 1, k), lambda p: F.array_contains(relevant, p)))
    total = F.size(F.array_distinct(relevant)) if n_relevant is None else n_relevant
    return F.when(total == 0, 0.0).otherwise(hits / total)


def reciprocal_rank(predicted: Column, relevant: Column, k: int) -> Column:
    """1 over the place of the first relevant id among the first k, else 0."""
    places = F.filter(F.transform(F.slice(predicted, 1, k), lambda p, i: F.when(F.array_contains(relevant, p), i + 1)), lambda i: i.isNotNull())
    return F.coalesce(1.0 / F.array_min(places), F.lit(0.0))


def _gain(gains: Column) -> Column:
    parts = F.transform(gains, lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + 2.0))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def ndcg(predicted: Column, relevant: Column, k: int, ideal: str = "retrieved") -> Column:
    """Normalised discounted gain of the first k with relevance 0 or 1.

    The ideal order is that of the retrieved relevances, or with ``ideal="full"`` that of all relevant ids.
    """
    gains = F.transform(F.slice(predicted, 1, k), lambda p: F.array_contains(relevant, p).cast("double"))
    if ideal == "retrieved":
        best = F.sort_array(gains, asc=False)
    elif ideal == "full":
        best = F.array_repeat(F.lit(1.0), F.least(F.size(relevant), F.lit(k)))
    else:
        raise ValueError(f"unknown ideal: {ideal}")
    return F.when(_gain(best) > 0, _gain(gains) / _gain(best)).otherwise(0.0)


def hits(ranked: DataFrame, gold: DataFrame, key: str = "doc_id", question_key: str = "query_id", rank: str = "rank", places=(1, 3, 5)) -> DataFrame:
    """For each gold question hit@k and the reciprocal rank within the last k; questions without results count as missed."""
    best = ranked.join(gold.select(question_key, key), [question_key, key], "left_semi").groupBy(question_key).agg(F.min(rank).alias("__r"))
    met = gold.select(question_key).distinct().join(best, question_key, "left")
    hit = [F.coalesce((F.col("__r") <= k).cast("int"), F.lit(0)).alias(f"hit_{k}") for k in places]
    return met.select(question_key, *hit, F.when(F.col("__r") <= max(places), 1.0 / F.col("__r")).otherwise(0.0).alias("mrr"))


def means(rows: DataFrame, by: list[str], metrics: list[str], digits: int = 4) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), digits).alias(m) for m in metrics])


def means_by_sets(rows: DataFrame, sets: list[list[str]], metrics: list[str], digits: int = 4) -> DataFrame:
    """Means for several groupings in one pass; columns that a grouping lacks are null."""
    every = sorted({c for s in sets for c in s})
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in every])
    return grouped.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), digits).alias(m) for m in metrics])


def relation_scores(predicted: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """One row: true and false positives, misses, precision, recall and F1 of two sets of relations; 0 where undefined."""
    p, t = predicted.select(*key).distinct().withColumn("__p", F.lit(1)), truth.select(*key).distinct().withColumn("__t", F.lit(1))
    met = p.join(t, key, "full_outer")
    counts = met.agg(
        F.coalesce(F.sum(F.when(F.col("__p").isNotNull() & F.col("__t").isNotNull(), 1)), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("__t").isNull(), 1)), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(F.col("__p").isNull(), 1)), F.lit(0)).alias("fn"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    scored = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def low_scores(rows: DataFrame, causes: dict[str, str], least: float = 0.7) -> DataFrame:
    """Rows in which a metric is below the bound, with the causes that these tell of."""
    bad = F.lit(False)
    for m in causes:
        bad = bad | (F.col(m) < least)
    return rows.filter(bad).withColumn("causes", F.concat_ws("; ", *[F.when(F.col(m) < least, F.lit(c)) for m, c in causes.items()]))


def chunk_number(c: Column) -> Column:
    """The number in an id such as ``c12``."""
    return F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).cast("int")


def mode_report(questions: DataFrame, results: DataFrame, k: int = 5, key: str = "question_id") -> DataFrame:
    """(mode, question, recall, mrr, ndcg) for every question in every mode; a question without a result has none found.
    ``questions`` may have n_relevant, as in ``recall_at``."""
    total = F.col("n_relevant") if "n_relevant" in questions.columns else None
    modes = results.select("mode").distinct()
    met = beside(questions, modes).join(results.select("mode", key, "predicted"), ["mode", key], "left")
    predicted = F.coalesce("predicted", F.array().cast(results.schema["predicted"].dataType))
    return met.select("mode", key, recall_at(predicted, F.col("relevant"), k, total).alias("recall"), reciprocal_rank(predicted, F.col("relevant"), k).alias("mrr"), ndcg(predicted, F.col("relevant"), k).alias("ndcg"))


def rank_matrix(hits_: DataFrame, row: str, column: str, values: list[str], rank: str = "rank") -> DataFrame:
    """Best rank of each row key in each of the given columns."""
    return hits_.groupBy(row).pivot(column, values).agg(F.min(rank))


def parent_tree(children: DataFrame, parent: str = "parent_id", child: str = "child_id", rank: str = "rank") -> DataFrame:
    """Parents with their ranked children."""
    return children.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct(rank, child))).alias("children"))


def lexical_proxy(answer: Column, context: Column, truth: Column) -> Column:
    """Shares of shared words in place of a model's judgement: a proxy, and named one.

    faithfulness: answer words that the context holds; recall: truth words that the context holds; precision: context
    words that the truth holds; relevancy: truth words that the answer holds.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    share = lambda a, b: F.when(F.size(words(a)) > 0, F.size(F.array_intersect(words(a), words(b))) / F.size(words(a))).otherwise(0.0)
    return F.struct(share(answer, context).alias("faithfulness"), share(truth, context).alias("recall"), share(context, truth).alias("precision"), share(truth, answer).alias("relevancy"))
