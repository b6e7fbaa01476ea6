"""Ranking operators. Questions are a DataFrame too, so a batch of them is one job."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.arrays import TAKEN, bound, pieces
from docloom.operators.nearest import best_of_all
from docloom.operators.patterns import find_patterns
from docloom.operators.relations import contained_in
from docloom.shared import beside, cut, few
from docloom.shipping import ship

#: Parameters of BM25-Okapi as commonly published: saturation, length, and the share of the mean that lifts negative idf.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Asked terms that a worker holds at most; of more, every term is counted. Distinct terms that a task counts at a time.
MOST_ASKED, COUNTED = 200_000, 200_000
#: Tokens of documents that a task takes apart at a time; a longer document goes alone.
TOKENS = 200_000


def count_terms(docs: DataFrame, wanted: DataFrame | None = None, words: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(term, key, tf, length, df) of documents (key, list of tokens), in one pass and without a shuffle.

    With ``words`` documents are (key, text), and ``words`` gives a text's tokens: texts are taken apart here, a piece of a batch at
    a time, so that a batch's lists of tokens are never held, nor handed from one Python worker to another.
    Rows with ``tf`` have a document's count of a term and its length: for all terms, or for those of ``wanted`` (term).
    Rows with ``df`` have in how many documents of some part of a task a term occurs; where their term is null, ``df`` counts
    the documents and ``length`` their tokens.
    """
    spark = docs.sparkSession
    ship(spark)
    some = None
    if wanted is not None:
        names = [r.term for r in wanted.distinct().limit(MOST_ASKED + 1).collect()]
        some = spark.sparkContext.broadcast(frozenset(names)) if len(names) <= MOST_ASKED else None
    kind = docs.schema.fields[0].dataType.simpleString()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None if some is None else some.value
        seen: Counter = Counter()
        keys = None

        def rows(term, key, tf, length, df) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(term, pa.string()), key, pa.array(tf, pa.int64()), pa.array(length, pa.int64()), pa.array(df, pa.int64())], names=["term", "key", "tf", "length", "df"])

        for batch in batches:
            keys, first = batch.column(0), 0
            for piece in pieces(batch.column(1), TOKENS if words is None else TAKEN):
                at, terms, tf, lengths, total = [], [], [], [], 0
                for i, tokens in enumerate(piece.to_pylist(), first):
                    tokens = (words(tokens) if words and tokens else tokens) or ()
                    times = Counter(tokens)
                    seen.update(times.keys())
                    total += len(tokens)
                    met = times if asked is None else times.keys() & asked
                    terms += met
                    tf += [times[t] for t in met]
                    at += [i] * len(met)
                    lengths += [len(tokens)] * len(met)
                yield rows(terms, keys.take(pa.array(at, pa.int64())), tf, lengths, [None] * len(at))
                yield rows([None], pa.nulls(1, keys.type), [None], [total], [len(piece)])
                first += len(piece)
                if len(seen) >= COUNTED:
                    yield rows(list(seen), pa.nulls(len(seen), keys.type), [None] * len(seen), [None] * len(seen), list(seen.values()))
                    seen.clear()
        if seen:
            yield rows(list(seen), pa.nulls(len(seen), keys.type), [None] * len(seen), [None] * len(seen), list(seen.values()))

    return docs.mapInArrow(over, f"term string, key {kind}, tf long, length long, df long")


def asked_terms(questions: DataFrame, question_tokens: Column, question_key: str, without: str) -> DataFrame:
    """(question, term, times). A question without tokens ends the job, or with ``without="skip"`` has no terms."""
    if without not in ("raise", "skip"):
        raise ValueError(f"unknown choice: {without}")
    rows = questions.select(question_key, question_tokens.alias("__tokens"))
    if without == "raise":
        none = F.coalesce(F.size("__tokens") < 1, F.lit(True))
        fault = F.raise_error(F.concat(F.lit("a question without tokens: "), F.coalesce(F.col(question_key).cast("string"), F.lit("null"))))
        rows = rows.filter(F.when(none, fault.cast("boolean")).otherwise(True))
    return rows.select(question_key, F.explode("__tokens").alias("term")).groupBy(question_key, "term").agg(F.count(F.lit(1)).alias("times"))


def bm25(docs: DataFrame, questions: DataFrame, tokens: Column, question_tokens: Column, key: str = "doc_id", question_key: str = "query_id", k: int = 10, keep_zero: bool = True, visible: DataFrame | None = None, k1: float = K1, b: float = B, epsilon: float = EPSILON, without: str = "raise", words: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(question, key, bm25_score, bm25_rank) of the best ``k`` for each question; ties by key.

    Repeated terms of a question count repeatedly; a question without tokens ends the job, unless ``without`` is "skip".
    Only documents that hold a term of a question are scored; with ``keep_zero`` the places that are left go to documents
    without any, by key. ``visible`` restricts what is ranked, while statistics stay those of all documents.

    The texts are read and taken apart once: each task counts in how many of its documents a term occurs, and keeps the
    counts of asked terms by document. Both are written; only they are shuffled, and ``visible`` meets keys alone. With ``words``,
    which gives a text's tokens, ``tokens`` is a document's text: then its list of tokens isn't handed on.
    """
    asked = asked_terms(questions, question_tokens, question_key, without)
    counted = cut(count_terms(docs.select(key, tokens.alias("__tokens")), asked.select("term"), words))
    whole = counted.filter("term is null").agg(F.sum("df").alias("df"), F.sum("length").alias("length")).first()
    n, mean_length = (whole.df, whole.length / whole.df) if whole.df else (0, 1.0)
    idf = lambda df: F.log(n - df + 0.5) - F.log(df + 0.5)
    terms = counted.filter("df is not null and term is not null").groupBy("term").agg(F.sum("df").alias("df")).withColumn("raw", idf(F.col("df")))
    terms = cut(terms)
    mean_idf = terms.agg(F.avg("raw")).first()[0] or 0.0
    weights = terms.join(asked, "term").select(question_key, "term", (F.col("times") * F.when(F.col("raw") < 0, epsilon * mean_idf).otherwise(F.col("raw"))).alias("weight"))
    found = counted.filter("tf is not null").select(F.col("key").alias(key), "length", "term", "tf")
    if visible is not None:
        found = found.join(visible.select(key), key, "left_semi")
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / (mean_length or 1.0)))
    parts = found.join(few(weights), "term").select(question_key, key, part.alias("part"))
    if keep_zero:
        # a question with fewer than k scored documents finds its k others among the first 2k by key
        first = (docs if visible is None else visible).select(key).distinct().orderBy(key).limit(2 * k)
        parts = parts.unionByName(questions.select(question_key).distinct().crossJoin(F.broadcast(first)).withColumn("part", F.lit(0.0)))
    scored = parts.groupBy(question_key, key).agg(F.sum("part").alias("bm25_score"))
    order = Window.partitionBy(question_key).orderBy(F.round("bm25_score", 9).desc(), key)
    return scored.withColumn("bm25_rank", F.row_number().over(order)).filter(F.col("bm25_rank") <= k)


def containing(docs: DataFrame, terms: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, term): which lower-cased texts contain which terms, for a table ``term``; in one pass over the texts."""
    low = docs.select(key, F.lower(text).alias("__low"))
    return find_patterns(low, terms, "__low", "term", key).withColumnRenamed("pattern", "term").distinct()


def substring_rank(docs: DataFrame, questions: DataFrame, text: str = "text", needle: str = "needle", key: str = "doc_id", question_key: str = "query_id", k: int = 10) -> DataFrame:
    """(question, key, hits, rank) by how often a string occurs, without case and overlaps; in one pass over the texts."""
    asked = questions.select(question_key, F.lower(needle).alias("pattern"))
    met = find_patterns(docs.select(key, F.lower(text).alias("__low")), asked, "__low", key=key, hits=True)
    found = met.join(few(asked), "pattern").select(question_key, key, "hits")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(question_key).orderBy(F.desc("hits"), key))).filter(F.col("rank") <= k)


def search_terms(tokens: Column, most: int = 8, with_digits: int = 6) -> Column:
    """A question's distinct tokens, longest first; where one is a number, numbers and single letters go and fewer stay."""
    order = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    first = F.slice(F.array_sort(F.array_distinct(tokens), order), 1, most)
    words = F.filter(F.slice(F.filter(first, lambda t: ~t.rlike(r"^\d+$")), 1, with_digits), lambda t: F.length(t) >= 2)
    return F.when(F.exists(tokens, lambda t: t.rlike(r"^\d+$")), words).otherwise(first)


def keyword_rank(docs: DataFrame, questions: DataFrame, terms: str = "terms", text: str = "text", key: str = "doc_id", question_key: str = "query_id", k: int = 5) -> DataFrame:
    """(question, key, score, rank): how many of a question's terms a text contains; ties by key."""
    asked = questions.select(question_key, F.explode(terms).alias("term"))
    met = containing(docs, asked.select("term"), text, key).join(few(asked), "term")
    found = met.groupBy(question_key, key).agg(F.count(F.lit(1)).cast("int").alias("score"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(question_key).orderBy(F.desc("score"), key))).filter(F.col("rank") <= k)


def reference_match(docs: DataFrame, questions: DataFrame, refs: str = "refs", title: str = "title", text: str = "text", key: str = "doc_id", question_key: str = "query_id", first: int = 3, k: int = 5) -> DataFrame:
    """(question, key, rank): documents whose title or text holds one of a question's first references; by key."""
    asked = questions.select(question_key, F.explode(F.slice(refs, 1, first)).alias("__ref")).select(question_key, F.lower("__ref").alias("__ref"))
    low = docs.select(key, F.concat_ws("\n", F.lower(title), F.lower(text)).alias("__low"))
    patterns = asked.select(F.col("__ref").alias("pattern"), F.col("__ref").alias("__id")).distinct()
    met = contained_in(low, patterns, "__low", "pattern", key, "__id").join(few(asked), F.col("__id") == F.col("__ref")).select(question_key, key).distinct()
    return met.withColumn("rank", F.row_number().over(Window.partitionBy(question_key).orderBy(key))).filter(F.col("rank") <= k)


def cascade(*stages: DataFrame, question_key: str = "query_id") -> DataFrame:
    """For each question the rows of the first stage that has any, with the number of the stage."""
    every = None
    for i, stage in enumerate(stages, 1):
        numbered = stage.withColumn("stage", F.lit(i))
        every = numbered if every is None else every.unionByName(numbered, allowMissingColumns=True)
    first = F.min("stage").over(Window.partitionBy(question_key))
    return every.withColumn("__first", first).filter(F.col("stage") == F.col("__first")).drop("__first")


def hybrid_cascade(semantic: DataFrame, lexical: DataFrame, scan: DataFrame, key: str = "doc_id", question_key: str = "query_id", rank: str = "rank", k: int = 60) -> DataFrame:
    """(question, key, rank, stage): both lists fused where a question has both, else the one it has, else a plain scan.

    The semantic list comes before the lexical one. A stage without rows for a question leaves it to the next.
    """
    from docloom.operators.fusion import fuse

    both = semantic.select(question_key).intersect(lexical.select(question_key))
    a, b = semantic.withColumnRenamed(rank, "__a"), lexical.withColumnRenamed(rank, "__b")
    fused = fuse(b, a, key, question_key, ("__b", "__a"), k=k).join(both, question_key, "left_semi")
    stages = [fused.withColumnRenamed("fused_rank", rank), semantic, lexical, scan]
    return cascade(*[s.select(question_key, key, rank) for s in stages], question_key=question_key)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b))


def unit(v: Column) -> Column:
    """The vector with length 1; null if it is zero."""
    return bound(F.sqrt(_dot(v, v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)))


def dense_rank(vectors: DataFrame, questions: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", question_key: str = "query_id", visible: DataFrame | None = None) -> DataFrame:
    """(question, key, similarity, distance, semantic_rank): exact cosine, the best ``k`` for each question; ties by key.

    Vectors are brought to length 1 once each, and compared by packs (``nearest``).
    """
    pool = vectors if visible is None else vectors.join(visible.select(key), key, "left_semi")
    found = best_of_all(pool.select(F.col(key).alias("key"), unit(F.col(vector)).alias("unit")), questions.select(F.col(question_key).alias("key"), unit(F.col(vector)).alias("unit")), k)
    return found.select(F.col("question").alias(question_key), F.col("key").alias(key), "similarity", F.col("place").alias("semantic_rank"), (1 - F.col("similarity")).alias("distance"))


def vector_faults(vector: Column, size: int) -> Column:
    """Why a vector cannot be used: its size, a value that is no number, or no value but zero; null if it can."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNull() | (F.size(vector) != size), "size").when(odd, "not_finite").when(F.forall(vector, lambda x: x == 0), "zero")


def mean_pool(vectors: Column, mask: Column) -> Column:
    """The mean of the token vectors that the mask keeps; null where it keeps none."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: F.transform(x["v"], lambda y: y.cast("double")))
    first = F.transform(F.get(kept, F.lit(0)), lambda y: y * 0)
    total = F.aggregate(kept, first, lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return F.when(F.size(kept) > 0, F.transform(total, lambda y: y / F.size(kept)))
