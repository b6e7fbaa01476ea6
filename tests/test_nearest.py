"""Comparing packs of vectors: the rows of all pairs, but only the best of each task go on."""

import math

import pytest
from pyspark.sql import functions as F

from docloom.operators import evaluation, graph, nearest, ranking
from docloom.plans import ranking_queries


def plain(vectors, asked, k):
    norm = lambda v: None if v is None or None in v or not any(v) else [x / math.sqrt(sum(y * y for y in v)) for x in v]
    out = []
    for q, a in asked:
        rows = []
        for key, b in vectors:
            x, y = norm(a), norm(b)
            s = None if x is None or y is None or len(x) != len(y) else sum(m * n for m, n in zip(x, y, strict=True))
            rows.append((-9 if s is None else round(s, 9), key, s))
        rows.sort(key=lambda r: (-r[0], r[1]))
        out += [(q, place, key, None if s is None else round(s, 9)) for place, (_, key, s) in enumerate(rows[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 7, 60])
def test_equals_all_pairs(spark, monkeypatch, k):
    for name, size in (("QUESTIONS", 3), ("VECTORS", 5), ("HELD", 2)):
        monkeypatch.setattr(nearest, name, size)
    rows = [(f"k{i % 97:02}-{i}", [float(i % 5), float(i % 3) - 1, float(i % 7) - 3]) for i in range(50)]
    rows += [("zero", [0.0] * 3), ("null", None), ("short", [1.0, 2.0]), ("hole", [1.0, None, 2.0]), ("a", rows[3][1]), ("b", rows[3][1])]
    asked = rows[:7] + rows[-6:-3]
    df = lambda r, c: spark.createDataFrame(r, f"{c} string, embedding array<double>").repartition(3)
    got = ranking.dense_rank(df(rows, "vec_id"), df(asked, "query_id"), k).collect()
    want = plain(rows, asked, k)
    assert sorted((r.query_id, r.semantic_rank) for r in got) == [w[:2] for w in want]
    of = {(r.query_id, r.semantic_rank): r for r in got}
    assert [(q, p, of[q, p].vec_id, None if of[q, p].similarity is None else round(of[q, p].similarity, 9)) for q, p, _, _ in want] == want


def test_pairs_are_not_rows(spark):
    """Of 40 questions and 4,000 vectors 160,000 pairs are compared; 3 of each question and task go on."""
    v = spark.range(4000).select(F.col("id").alias("key"), F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 3)).alias("u"))
    v = v.select("key", ranking.unit(F.col("u")).alias("unit"))
    packs = nearest.packed(v, nearest.VECTORS).repartition(4)
    rows = nearest.best_of_pairs(packs.crossJoin(nearest.sent(nearest.packed_questions(v.filter("key < 40")))), 3)
    assert rows.count() == 120
    plan = ranking.dense_rank(v, v.filter("key < 40").withColumnRenamed("key", "query_id"), 3, key="key", vector="unit")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("MapInArrow") < plan.index("Join")  # above the pairs of packs only the best go on


def test_a_label_is_no_list_for_each_question(spark):
    """Of what is relevant only that is listed which was found; the rest is counted."""
    e = spark.range(600).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"), F.when(F.col("id") > 0, F.col("id") % 2).cast("int").alias("label"))
    rows = ranking_queries._gold(lambda name: e).collect()
    assert len(rows) == 11  # a question without a label has none
    assert all(len(r.relevant) <= 10 and len(r.predicted) == 10 and r.n_relevant in (299, 300) for r in rows)
    assert all(set(r.relevant) == {v for v in r.predicted if v and v % 2 == r.query_id % 2} for r in rows)


def test_recall_of_a_number(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3], 8), ([1], [], 0)], "p array<int>, r array<int>, n int")
    assert [x[0] for x in df.select(evaluation.recall_at(F.col("p"), F.col("r"), 2, F.col("n"))).collect()] == [0.125, 0.0]


def test_a_neighbourhood_is_found_once_for_a_node(spark):
    """A thousand seeds of a node don't multiply its edges."""
    seeds = spark.range(1000).select(F.col("id").alias("q"), F.lit(1).alias("node")).union(spark.createDataFrame([(1000, 2), (1001, None), (1002, 9)], "q long, node int"))
    first = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "src int, dst int")
    second = spark.range(3000).select((F.col("id") % 2 + 10).cast("int").alias("src"), (F.col("id") % 3).alias("dst"))
    out = graph.seed_neighbourhood(seeds, first, second, by=["q"])
    got = {r.q: (r.node, r.first, r.second) for r in out.collect()}
    assert len(got) == 1003 and got[0] == got[999] == (1, [10, 11], [0, 1, 2])
    assert got[1000] == (2, [12], []) and got[1001] == (None, [], []) and got[1002] == (9, [], [])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the edges are met before, by node


@pytest.mark.parametrize("joined", [{}, {"joined": ","}])
def test_a_neighbourhood_is_dealt_out_by_its_size(spark, joined, monkeypatch):
    """Of 40 rows of about 100 KB no task makes more than four; a seed without neighbours, and a null one, stay."""
    monkeypatch.setattr(graph, "DEALT", 300_000, raising=False)
    seeds = spark.range(42).select(F.col("id").alias("q"), F.when(F.col("id") < 40, F.col("id") % 2).when(F.col("id") == 40, 9).cast("int").alias("node"))
    first = spark.createDataFrame([(0, 10), (1, 11), (1, 12), (1, None)], "src int, dst int")
    second = spark.range(60000).select((F.col("id") % 3 + 10).cast("int").alias("src"), (F.col("id") * 7 % 17000 + 10000).alias("dst"))
    out = graph.seed_neighbourhood(seeds, first, second, by=["q"], **joined)
    assert max(sum(r.q < 40 for r in part) for part in out.select("q").rdd.glom().collect()) <= 4
    got = {r.q: (r.node, r.first, r.second) for r in out.collect()}
    listed = (lambda x: ",".join(map(str, x))) if joined else list
    every = listed(range(10000, 27000))
    assert len(got) == 42
    assert all(got[i] == (0, listed([10]), every) for i in range(0, 40, 2))
    assert all(got[i] == (1, listed([11, 12]), every) for i in range(1, 40, 2))
    assert got[40] == (9, listed([]), listed([])) and got[41] == (None, listed([]), listed([]))
