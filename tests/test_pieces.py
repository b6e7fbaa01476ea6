"""Arrow functions take a batch apart in pieces, so their memory doesn't follow its rows."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import arrays
from docloom.functions import text as T
from docloom.operators import lexical_index, ranking


@pytest.mark.parametrize("column", [pa.array(["abc", None, "", "x" * 10, "yy", "z"]), pa.array(["abc", None, "", "x"]).slice(2), pa.array([["a"], None, ["b"] * 5, [], ["c"]]).slice(1, 3), pa.array([], pa.string())])
@pytest.mark.parametrize("most", [1, 4, 100])
def test_pieces_are_the_column(column, most):
    got = list(arrays.pieces(column, most))
    assert [x for g in got for x in g.to_pylist()] == column.to_pylist()
    assert all(len(g) == 1 or sum(len(x or "") for x in g.to_pylist()) <= most for g in got)


def test_words_of_pieces(monkeypatch):
    monkeypatch.setattr(arrays, "TAKEN", 5)
    assert T._words(pa.array(["A b", None, "", "c d e f", "g"])).to_pylist() == [["a", "b"], None, [], ["c", "d", "e", "f"], ["g"]]


def test_few_tokens_at_a_time(spark, monkeypatch):
    """One batch of 500 documents is handed on in parts, with the counts of one."""
    docs = spark.range(500).selectExpr("id", "array('a', concat('t', id % 7), 'a') tokens").coalesce(1)
    monkeypatch.setattr(ranking, "TOKENS", 30)
    rows = ranking.count_terms(docs).collect()
    whole = [r for r in rows if r.term is None]
    assert len(whole) == 50 and sum(r.df for r in whole) == 500 and sum(r.length for r in whole) == 1500
    assert {(r.key, r.term, r.tf) for r in rows if r.tf} == {(i, "a", 2) for i in range(500)} | {(i, f"t{i % 7}", 1) for i in range(500)}
    monkeypatch.setattr(lexical_index, "TOKENS", 30)
    made = lexical_index._forward(docs, F.col("tokens"), "id", F.lit("x")).collect()
    assert {(r.key, r.length, dict(zip(r.terms, r.times, strict=True))["a"]) for r in made} == {(i, 3, 2) for i in range(500)}


def test_counting_texts_is_counting_their_tokens(spark, monkeypatch):
    """Texts that a task takes apart itself give the rows of their lists of tokens, a piece of a batch at a time."""
    monkeypatch.setattr(ranking, "TAKEN", 1_000)
    rows = [(i, None if i % 7 == 0 else "" if i % 7 == 1 else f"Straße {i % 5} ét É, wort{i % 3} WORT{i % 3}") for i in range(300)]
    texts = spark.createDataFrame(rows, "k long, text string").coalesce(1)
    wanted = spark.createDataFrame([("wort1",), ("strasse",), ("ét",)], "term string")
    lists = texts.select("k", T.legal_tokens(F.col("text")))
    for some in (None, wanted):
        tf = lambda found: sorted((r.term, r.key, r.tf, r.length) for r in found if r.tf is not None)
        df = lambda found: sum((Counter({r.term: r.df}) for r in found if r.df), Counter())
        a, b = ranking.count_terms(texts, some, T.legal_words).collect(), ranking.count_terms(lists, some).collect()
        assert tf(a) == tf(b) and df(a) == df(b) and len(tf(a)) > 100
        assert len([r for r in a if r.term is None]) > 5


def test_registered_bm25_hands_on_no_tokens(spark):
    """The texts of the queries on BM25 meet one Python function, so a task has one worker for them."""
    from docloom.plans import ranking_queries, table_queries

    calls = []
    t = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    real = ranking.count_terms
    ranking.count_terms = lambda docs, *rest: calls.append(docs) or real(docs, *rest)
    try:
        ranking_queries._bm25(t, 3).count(), table_queries._secure_bm25(t).count()
    finally:
        ranking.count_terms = real
    assert [d.schema["__tokens"].dataType.simpleString() for d in calls] == ["string", "string"]
