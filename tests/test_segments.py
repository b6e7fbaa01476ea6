"""Running values over ranges of rows against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import hierarchy, relations, segments


@pytest.fixture()
def many_ranges(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_windows(sizes, limit):
    window, used, out = -1, 0, []
    for n in sizes:
        if window < 0 or used + n > limit:
            window, used = window + 1, 0
        used += n
        out.append(window)
    return out


def test_windows_of_parts_by_a_plain_loop():
    """However the rows are cut into ranges, also into ranges of a single row."""
    rng = random.Random(1)
    for _ in range(400):
        limit = rng.choice([1, 10, 100])
        sizes = [rng.choice([0, 1, 3, 9, 40, 150]) for _ in range(rng.randint(0, 40))]
        packing, state, got, at = segments.Packing(limit), None, [], 0
        while at < len(sizes):
            n = rng.randint(1, 12)
            part = np.array(sizes[at : at + n], np.int64)
            got += packing.apply(state, part).tolist()
            state = packing.combine(state, packing.summarise(part))
            at += n
        assert got == plain_windows(sizes, limit)


def test_summaries_are_short():
    rng = random.Random(2)
    sizes = np.array([rng.randint(200, 900) for _ in range(20_000)], np.int64)
    assert len(segments.Packing(6000).summarise(sizes)[1]) < 20


def rows_of_groups(rng, n):
    groups = ["hot"] * 8 + ["b", "c", None]
    return [(i, rng.choice(groups), rng.choice([None, None, f"v{i}"]), rng.choice([None, 0, 5, 30, 80, 200])) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 900])
def test_scans_by_plain_loops(spark, many_ranges, n):
    rows = rows_of_groups(random.Random(n), n)
    df = spark.createDataFrame(rows, "i long, g string, v string, size int").repartition(5)
    carried = {r.i: r.last for r in segments.carry_forward(df, ["g"], [F.col("i")], {"v": "last"}).collect()}
    placed = {r.i: r.place for r in segments.number_within(df, ["g"], [F.col("i")]).collect()}
    packed = {r.i: r.window_index for r in segments.pack_windows(df, ["g"], [F.col("i")], "size", 100).collect()}
    for g in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == g]
        last = None
        windows = plain_windows([r[3] or 0 for r in own], 100)
        for k, (i, _, v, _) in enumerate(own):
            assert (carried[i], placed[i], packed[i]) == (last, k + 1, windows[k])
            last = v if v is not None else last
    assert len(carried) == len(placed) == len(packed) == n


def test_one_large_group_lies_in_many_ranges(spark, many_ranges):
    df = spark.range(200_000).select("id", F.lit("only").alias("g"), F.when(F.col("id") % 1000 == 3, F.col("id")).alias("v"), (F.col("id") % 7).alias("size"))
    made = segments.carry_forward(df, ["g"], [F.col("id")], {"v": "last"})
    per_task = made.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 8 and max(r["count"] for r in per_task) < 60_000
    wrong = F.when(F.col("id") > 3, F.col("last") != F.floor((F.col("id") - 4) / 1000) * 1000 + 3).otherwise(F.col("last").isNotNull())
    assert made.filter(wrong).count() == 0


def test_hierarchy_of_one_hot_source(spark, many_ranges):
    """All chunks of one source: paths and windows as in a plain loop."""
    rng = random.Random(4)
    texts = [(f"c{i}", "s", rng.choice(["x" * rng.randint(1, 90), "Điều %d. a" % i]) if i % 50 else "y") for i in range(800)]
    df = spark.createDataFrame(texts, "chunk_id string, source string, text string").repartition(4)
    resolved = hierarchy.resolve_paths(df)
    article, want = None, {}
    for c, _, t in texts:
        own = " ".join(t.split(".")[0].split()) if t.startswith("Điều") else None
        article = own or article
        want[c] = article
    assert {r.chunk_id: r.path.article for r in resolved.collect()} == want
    packed = {r.chunk_id: (r.article_key, r.window_index) for r in hierarchy.build_parents(resolved, 300)[1].collect()}
    groups = {}
    for c, _, t in texts:
        groups.setdefault((want[c] or "document").lower(), []).append((c, len(t)))
    for key, own in groups.items():
        assert [packed[c] for c, _ in own] == [(key, w) for w in plain_windows([n for _, n in own], 300)]


def test_ids_within_a_type(spark, many_ranges):
    rows = [(f"d{i % 40}", f"name {i:04d}", "Hot" if i % 9 else "Cold", 0.5) for i in range(600)]
    df = spark.createDataFrame(rows, "document_id string, entity string, entity_type string, confidence double")
    got = {(r.entity_type, r.canonical_name, r.document_id): r.entity_id for r in relations.dedup_entities(df, F.col("entity")).collect()}
    for kind in ("Hot", "Cold"):
        own = sorted((n, d) for d, n, k, _ in rows if k == kind)
        assert [got[kind, n, d] for n, d in own] == ["ENT_%s_%04d" % (kind.upper()[:3], i) for i in range(1, len(own) + 1)]
