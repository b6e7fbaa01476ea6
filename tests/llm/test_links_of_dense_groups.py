"""Dense groups of unlike labels: what is verified in a bucket goes on as a forest, and no class is lost."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import simhash


def classes_of(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_alike_sets():
    rng = random.Random(1)
    own = np.array(sorted(rng.sample(range(60), 40)), np.uint64)
    others = [np.array(sorted(rng.sample(range(60), n)), np.uint64) for n in (0, 1, 38, 40, 45, 59, 60)] + [own]
    got = simhash.alike(own, np.array([len(x) for x in others]), np.concatenate(others), 600).tolist()
    assert got == [len(set(own) & set(x)) >= 0.6 * len(set(own) | set(x)) for x in others]
    assert simhash.alike(own[:0], np.array([0, 2]), own[:2], 800).tolist() == [True, False]


@pytest.mark.parametrize("block", [16, 10**6])
def test_links_follow_the_rows_not_their_square(spark, monkeypatch, block):
    """120 sets that all meet, in chains about the threshold: fewer links than rows, with the classes of all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(300)]
    sets = {n: sorted({*base[n : n + 170], *(rng.getrandbits(63) for _ in range(rng.choice((0, 0, 2, 60))))}) for n in range(120)}
    rows = [(7, 7, 7, 7, n) for n in sets]
    index = simhash.Index(spark.createDataFrame(rows, "fp long, fp1 long, fp2 long, fp3 long, node long"), [(list(range(64)), 0)], 13, 60, 4, "node")
    fine = simhash.finer(spark.createDataFrame(list(sets.items()), "node long, shingles array<long>"))
    labels = spark.createDataFrame([(n, n if n % 4 else 0) for n in sets], "node long, label long")
    got = [(r.a, r.b) for r in index.between(labels, fine, 64 * simhash.FINE, True, 0.8).collect()]
    alike = lambda a, b: len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))
    same = [(0, n) for n in sets if n % 4 == 0]
    want = [(a, b) for a, b in combinations(sets, 2) if alike(a, b)]
    assert len(want) > 1000 and all(alike(a, b) for a, b in got)
    assert classes_of(got + same, sets) == classes_of(want + same, sets)
    assert 1 < len(set(classes_of(got + same, sets).values())) < 60
    if block > len(sets):
        assert len(got) < len(sets)


def test_forest_of_fingerprints(spark):
    """Without sets: as many links as connect the labels, as all of them would."""
    rng = random.Random(5)
    prints = sorted({sum(1 << b for b in rng.sample(range(32), rng.randint(0, 3))) for _ in range(400)})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    index = simhash.Index(df, [(list(range(32)), 0)], 4, 4)
    labels = df.select(F.col("fp").alias("node"), F.col("fp").alias("label"))
    every = [(r.a, r.b) for r in index.between(labels).collect()]
    got = [(r.a, r.b) for r in index.between(labels, forest=True).collect()]
    assert set(got) <= set(every) and len(got) < len(prints) < len(every)
    assert classes_of(got, prints) == classes_of(every, prints)


def test_sets_meet_candidates_only(spark, monkeypatch):
    """Of 400 sets filed under three values each that are unlike but for ten pairs, only these pairs go to their buckets with their sets."""
    rng = random.Random(7)
    sets = {n: sorted(rng.getrandbits(63) for _ in range(150)) for n in range(400)}
    for n in range(0, 100, 10):
        sets[n + 1] = sorted([*sets[n][:145], *(rng.getrandbits(63) for _ in range(5))])
    rows = [(7, 7, 7, 7, n) for n in sets]
    plan = [(list(range(a, a + 64)), 0) for a in (0, 64, 128)]
    index = simhash.Index(spark.createDataFrame(rows, "fp long, fp1 long, fp2 long, fp3 long, node long"), plan, 13, 60, 4, "node")
    fine = simhash.finer(spark.createDataFrame(list(sets.items()), "node long, shingles array<long>"))
    labels = spark.createDataFrame([(n, n) for n in sets], "node long, label long")
    met = []
    verified = simhash.Index._verified
    monkeypatch.setattr(simhash.Index, "_verified", lambda self, dealt, *rest: met.append(dealt.select("part", "node").collect()) or verified(self, dealt, *rest))
    got = sorted((r.a, r.b) for r in index.between(labels, fine, simhash.most_bits(0.8, simhash.FINE, simhash.ERRORS), True, 0.8).collect())
    assert got == [(n, n + 1) for n in range(0, 100, 10)]
    assert sorted(tuple(r) for r in met[0]) == [(p, n + i) for p in range(3) for n in range(0, 100, 10) for i in (0, 1)]


@pytest.mark.parametrize("small", [0, 256])
def test_rows_with_candidates(monkeypatch, small):
    """As all pairs of different labels say, in small and in large buckets, over batches that cut a bucket."""
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(11)
    made = [(0, rng.randint(0, 3), 0, sum(1 << b for b in rng.sample(range(40), rng.randint(0, 6))), n, rng.randint(0, 5)) for n in range(300)]
    made = sorted(made, key=lambda r: r[:3])
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=["part", "value", "block", "fp", "node", "label"])
    found = simhash._links(3, 3, 1, True, True, rows=["fp", "node", "label"])(iter(table.to_batches(max_chunksize=37)))
    got = sorted(tuple(r.values()) for b in found for r in b.to_pylist())
    near = lambda x, y: x[1] == y[1] and x[5] != y[5] and (x[3] ^ y[3]).bit_count() <= 3
    want = sorted(r for r in made if any(near(r, o) for o in made))
    assert got == want and 50 < len(want) < len(made)
