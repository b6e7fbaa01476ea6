"""Upserts by buckets, and audit batches that come twice."""

import os
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import graph
from docloom.sources import buckets, readers, writers


def test_upserts_by_brute_force(spark, tmp_path):
    rng, path = random.Random(1), str(tmp_path)
    kind = "id long, part string, v string"
    now = {(i, "a"): "old" for i in range(50)} | {(None, "a"): "old"}
    frame = lambda rows: spark.createDataFrame([(*k, v) for k, v in rows], kind)
    buckets.create(frame(now.items()), path, ["id", "part"], 8)
    versions = [dict(now)]
    for step in range(3):
        changes = [((rng.choice([None, *range(70)]), rng.choice("ab")), f"v{step}{rng.randrange(9)}") for _ in range(30)]
        flat = graph.upsert(frame(now.items()), frame(changes), ["id", "part"], [F.col("v")]) if step == 0 else None
        for k in {k for k, _ in changes}:
            now[k] = min(v for c, v in changes if c == k)
        assert buckets.upsert_buckets(spark, path, frame(changes), [F.col("v")]) == step + 2
        got = {(r.id, r.part): r.v for r in buckets.read(spark, path).collect()}
        assert got == now
        assert flat is None or sorted(map(str, flat.collect())) == sorted(map(str, buckets.read(spark, path).collect()))
        now = got
        versions.append(dict(now))
    for number, want in enumerate(versions, 1):
        assert {(r.id, r.part): r.v for r in buckets.read(spark, path, number).collect()} == want
    with pytest.raises(ValueError):
        buckets.read(spark, path, 9)


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path)
    buckets.create(spark.range(5000).withColumn("v", F.lit("x" * 50)), path, ["id"], 32)
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{path}/data") for f in names)
    before = size()
    change = spark.createDataFrame([(7, "new")], "id long, v string")
    buckets.upsert_buckets(spark, path, change, [F.col("v")])
    assert size() - before < before / 8
    first, last = buckets.version(spark, path, 1), buckets.version(spark, path)
    assert sum(first.folders[b] != last.folders[b] for b in first.folders) == 1
    assert buckets.read(spark, path).count() == 5000 and buckets.read(spark, path).filter("id = 7").first().v == "new"
    assert buckets.upsert_buckets(spark, path, change.limit(0), [F.col("v")]) == 2
    # doing it again changes nothing
    buckets.upsert_buckets(spark, path, change, [F.col("v")])
    assert buckets.read(spark, path).count() == 5000


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    buckets.create(spark.createDataFrame([], "id long, v string"), path, ["id"])
    assert buckets.read(spark, path).count() == 0
    buckets.upsert_buckets(spark, path, spark.createDataFrame([(1, "a")], "id long, v string"), [F.col("v")])
    assert [tuple(r) for r in buckets.read(spark, path).collect()] == [(1, "a")]


def audit(spark, *ids):
    return spark.createDataFrame([(i, "OK") for i in ids], "request_id string, status string").withColumn("timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp"))


def test_a_batch_that_comes_twice(spark, tmp_path):
    path = str(tmp_path / "log")
    for batch, ids in ((0, "ab"), (1, "c"), (0, "ab")):
        writers.append_audit(audit(spark, *ids), path, batch)
    assert sorted(r.request_id for r in readers.audit_log(spark, path).collect()) == ["a", "b", "c"]
    # one that broke off is written anew
    os.remove(f"{path}/batch=1/_SUCCESS")
    writers.append_audit(audit(spark, "c", "d"), path, 1)
    assert sorted(r.request_id for r in readers.audit_log(spark, path).collect()) == ["a", "b", "c", "d"]
    writers.append_audit(audit(spark, "e"), path)
    writers.append_audit(audit(spark, "e"), path)
    assert readers.audit_log(spark, path).count() == 6


def test_a_stream_that_starts_again(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for round_ in range(2):
        audit(spark, *[f"{round_}{i}" for i in range(5)]).write.mode("append").json(source)
        events = spark.readStream.schema("request_id string, status string, timestamp timestamp").json(source)
        q = writers.audit_sink(events, path, str(tmp_path / f"state{round_}"), {"availableNow": True})
        q.awaitTermination()
        if round_ == 0:  # the state is lost: the same batch comes again
            q = writers.audit_sink(events, path, str(tmp_path / "lost"), {"availableNow": True})
            q.awaitTermination()
            assert readers.audit_log(spark, path).count() == 5
            break
