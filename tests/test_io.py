import json

import pytest
from pyspark.sql import functions as F

from docloom.sources import readers, writers
from docloom.streaming.audit import audit_stream, denials


@pytest.fixture
def chunk_files(tmp_path):
    folder = tmp_path / "chunks"
    folder.mkdir()
    row = {"strategy": "semantic", "source": "s", "page_start": 0, "page_end": 1}
    (folder / "a.json").write_text(json.dumps({"chunks": [row | {"chunk_id": "c1", "text": " a\n b ", "structure": {"article": "Điều 1"}}, row | {"chunk_id": "c2", "text": ""}, row | {"chunk_id": "c3", "text": "x", "strategy": "fixed-size"}]}))
    (folder / "b.json").write_text(json.dumps([row | {"chunk_id": "c1", "text": "z"}, row | {"chunk_id": "c4", "text": "y", "page_end": -1}, row | {"chunk_id": " ", "text": "y"}]))
    return str(folder)


def test_chunks(spark, chunk_files):
    assert sorted(r.text for r in readers.chunks(spark, chunk_files, "semantic").collect()) == ["a b", "y", "z"]
    rows = readers.strict_chunks(spark, chunk_files)
    assert sorted((r.input_file, r.place, r.fault) for r in rows.collect()) == [("a.json", 0, "repeated"), ("a.json", 1, None), ("a.json", 2, None), ("b.json", 0, "repeated"), ("b.json", 1, "pages"), ("b.json", 2, "chunk_id")]
    with pytest.raises(Exception, match="faulty row"):
        readers.sound(rows).collect()
    assert readers.sound(rows.filter("fault is null")).filter("text_missing").count() == 1


def test_csv(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('﻿id,text\n1,"a\n""b"""\n2,\n')
    got = readers.csv(spark, str(path), "id string, text string, extra int", ("id",)).orderBy("id").collect()
    assert [(r.id, r.text, r.extra) for r in got] == [("1", 'a\n"b"', None), ("2", None, None)]
    with pytest.raises(ValueError):
        readers.csv(spark, str(path), "id string", ("other",))
    (tmp_path / "r.csv").write_text("doc_id,other_doc_id,relationship\n1,2,cites\n,2,x\n")
    assert [tuple(r) for r in readers.relationships(spark, str(tmp_path / "r.csv")).collect()] == [("1", "2", "cites")]
    (tmp_path / "d.csv").write_text("doc_id,title\n1,a\n1,b\n2,c\n")
    assert readers.metadata(spark, str(tmp_path / "d.csv"), "id string, doc_id string, title string").count() == 2


def test_small_files(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "question": "?", "relevant_chunk_ids": ["c1"]}, {"question_id": "2", "question": "!"}]))
    assert [tuple(r) for r in readers.questions(spark, str(tmp_path / "q.json")).orderBy("question_id").collect()] == [("1", "?", ["c1"]), ("2", "!", [])]
    (tmp_path / "p.md").write_text("---\nid: RR-1\n---\n# x")
    assert readers.markdown_pages(spark, str(tmp_path / "p.md")).first().id == "RR-1"
    (tmp_path / "policy.json").write_text('{"default_policy": "DENY"}')
    assert readers.policy(spark, str(tmp_path / "policy.json"))["default_policy"] == readers.policy(spark)["default_policy"] == "DENY"


def test_secure_chunks(spark):
    plain = spark.createDataFrame([(1,)], "id int")
    assert len(readers.secure_chunks(plain).first().allowed_roles) == 5
    rows = plain.withColumn("allowed_roles", F.lit('["HR"]'))
    assert readers.secure_chunks(rows).first().allowed_roles == ["HR"]


def test_vectors(spark, tmp_path):
    path = str(tmp_path / "v")
    writers.vector_table(spark.createDataFrame([("h", [1.0])], "text_hash string, v array<double>"), path, {"model": "m"})
    assert readers.vectors(spark, path, {"model": "m"}).count() == 1
    with pytest.raises(ValueError):
        readers.vectors(spark, path, {"model": "other"})
    texts = spark.createDataFrame([("a",), ("b",)], "text string")
    cache = texts.filter("text = 'a'").select(F.sha2("text", 256).alias("text_hash"), F.lit(1).alias("v"))
    have, need = readers.cached_vectors(texts, cache)
    assert have.first().text == "a" and need.first().text == "b"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    writers.json_table(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    writers.csv_table(df, str(tmp_path / "c"))
    assert sorted(tuple(r) for r in readers.csv(spark, str(tmp_path / "c"), "id int, v string").collect()) == [(1, "a"), (2, "b")]
    df.write.parquet(str(tmp_path / "t"))
    new = writers.upsert_table(spark, str(tmp_path / "t"), df.filter("id = 2").withColumn("v", F.lit("c")), ["id"], [F.col("v")])
    assert sorted(tuple(r) for r in spark.read.parquet(new).collect()) == [(1, "a"), (2, "c")]
    assert "| 1 | a |" in writers.report(df, "T")
    with pytest.raises(ValueError):
        writers.report(df, "T", 1)


def test_manifest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x")
    path = str(tmp_path / "in")
    built = spark.createDataFrame(writers.manifest(spark, path, {"k": 1}).collect())
    now = lambda: writers.file_hashes(spark, path)
    assert writers.staleness(None, now(), {}) == "missing" and writers.staleness(built, now(), {"k": 1}) == "fresh"
    assert writers.staleness(built.limit(0), now(), {"k": 1}) == "incomplete" and writers.staleness(built, now(), {"k": 1}, 2) == "invalid"
    assert writers.staleness(built, now(), {"k": 2}) == "config_mismatch"
    (tmp_path / "in" / "b.txt").write_text("y")
    assert writers.staleness(built, now(), {"k": 1}) == "file_count_mismatch"
    (tmp_path / "in" / "b.txt").unlink()
    (tmp_path / "in" / "a.txt").write_text("z")
    assert writers.staleness(built, now(), {"k": 1}) == "file_hash_mismatch"


def test_wiki(spark):
    e = spark.createDataFrame([("R1", "Risk: one", "risk"), ("C1", "Control", "control")], "id string, name string, kind string")
    r = spark.createDataFrame([("C1", "MITIGATES", "R1")], "source_id string, relationship_type string, target_id string")
    got = {x.id: x for x in writers.wiki_pages(e, r).collect()}
    assert "- MITIGATES: [[R1|Risk: one]]" in got["C1"].body and got["R1"].file == "Risk_one.md"


def test_audit_stream(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [("2024-01-01 00:01:00", "Staff", "DENIED"), ("2024-01-01 00:02:00", "Staff", "OK"), ("2024-01-01 00:07:00", "HR", "DENIED")]
    df = spark.createDataFrame(rows, "timestamp string, user_role string, status string").withColumn("timestamp", F.to_timestamp("timestamp"))
    writers.append_audit(df.filter("user_role = 'Staff'"), log)
    writers.append_audit(df.filter("user_role = 'HR'"), log)
    assert readers.audit_log(spark, log).count() == 3
    q = denials(audit_stream(spark, log)).writeStream.outputMode("complete").format("memory").queryName("denied").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {(r.user_role, r.n_denied, r.n) for r in spark.table("denied").collect()} == {("Staff", 1, 2), ("HR", 1, 1)} == {(r.user_role, r.n_denied, r.n) for r in denials(readers.audit_log(spark, log)).collect()}
