"""Expansion that stops where a seed has enough against all trails, cut afterwards."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import graph


def rows(df):
    return sorted((r.seed, r.place, r.node, r.hop, tuple(r.path), r.chunk_id) for r in df.select("seed", "place", "node", "hop", "path", "chunk_id").collect())


@pytest.mark.parametrize(("hops", "hub"), [(0, 10), (1, 3), (2, 3), (2, 10_000), (3, 4)])
def test_equals_all_trails(spark, hops, hub):
    rng = random.Random(hops)
    names = [f"n{i}" for i in range(14)]
    edges = [(rng.choice(names), rng.choice(names), rng.choice("AB"), i) for i in range(26)] + [("n0", n, "H", 100 + i) for i, n in enumerate(names[1:])]
    items = [(rng.choice(names[4:]), f"c{i:03d}") for i in range(30)] + [(None, "lost")]
    e = spark.createDataFrame(edges, "src string, dst string, kind string, edge_id int").repartition(3)
    i = spark.createDataFrame(items, "node string, chunk_id string")
    seeds = spark.createDataFrame([(n,) for n in names[:5]] + [("n0",), ("nowhere",)], "node string")
    want = graph.limited(graph.expand(seeds, e, hops), i, hops, 2)
    # where hop, key and path agree any order of nodes will do
    strip = lambda df: [(s, p, h, path, c) for s, p, _, h, path, c in rows(df)]
    assert strip(graph.expand_to_items(seeds, e, i, hops, 2, hub=hub)) == strip(want)


def test_a_hub_is_joined_in_parts(spark):
    n = 60_000
    edges = spark.range(n).select(F.lit("hub").alias("src"), F.concat(F.lit("x"), F.col("id")).alias("dst"), F.lit("K").alias("kind"), F.col("id").alias("edge_id")).unionByName(spark.createDataFrame([("s", "hub", "K", n)], "src string, dst string, kind string, edge_id long"))
    items = spark.range(0, n, 3).select(F.concat(F.lit("x"), F.col("id")).alias("node"), F.format_string("c%06d", F.col("id")).alias("chunk_id"))
    seeds = spark.createDataFrame([("s",)], "node string")
    got = graph.expand_to_items(seeds, edges, items, 2, 5, hub=1000)
    assert [r.chunk_id for r in got.orderBy("place").collect()] == [f"c{i:06d}" for i in range(0, 30, 3)]
    both, hubs = graph._both_ways(edges, "src", "dst", "kind", "edge_id", 1000)
    assert [tuple(r) for r in hubs.collect()] == [("hub", 61)]
    assert both.filter("__from = 'hub'").groupBy("__part").count().agg(F.max("count")).first()[0] < 1300
