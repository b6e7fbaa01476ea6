"""Arrays of JSON files that are cut anywhere: the elements are those that a plain parser finds."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docloom.plans import io_queries
from docloom.sources import json_arrays, readers, writers

PIECES = ('}', '{', '"', '\\', ',', '[', ']', ':', 'a', 'é', '\n', ' ', '"chunks": [', '\\"', '{"a": 1}', ' ', '😀')


def made(rnd, depth=0):
    kind = rnd.randrange(7 if depth < 3 else 4)
    if kind <= 1:
        return "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(12)))
    if kind == 2:
        return rnd.choice([None, True, 1.5, -3, 10**12])
    if kind == 3:
        return rnd.choice([[], {}, "", "chunks"])
    if kind == 4:
        return [made(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    return {rnd.choice(["chunks", "b}", 'c"', "d"]): made(rnd, depth + 1) for _ in range(rnd.randrange(4))}


def wanted(content):
    found = content.get("chunks") if isinstance(content, dict) else content
    return found if isinstance(found, list) else []


def read(spark, path, member="chunks"):
    rows = json_arrays.elements(spark, str(path), member).collect()
    assert len({(r.input_file, r.place) for r in rows}) == len(rows)
    return {(r.input_file, r.place): json.loads(r.value) for r in rows}


@pytest.fixture
def small_parts(spark):
    """Files are cut every 97 bytes or so."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "97")
    spark.conf.set(names[1], "1")
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def test_equal_to_a_plain_parser_however_a_file_is_cut(spark, tmp_path, small_parts):
    rnd = random.Random(5)
    want = {}
    for i in range(24):
        content = [made(rnd) for _ in range(rnd.randrange(9))]
        if i % 3:
            content = {"a": made(rnd), "chunks": content, "z": [made(rnd)], "y": {"chunks": [1, 2]}}
        text = json.dumps(content, ensure_ascii=bool(i % 2), indent=rnd.choice([None, 1]))
        (tmp_path / f"{i}.json").write_bytes(b"\xef\xbb\xbf" * (i % 5 == 4) + (text + rnd.choice(["", "\n", "  "])).encode())
        want |= {(f"{i}.json", n): e for n, e in enumerate(wanted(content))}
    assert len(want) > 60
    assert read(spark, tmp_path) == want


def test_a_long_array_is_read_by_many_tasks(spark, tmp_path, small_parts):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    rows = [{"chunk_id": f"c{i}", "strategy": "s", "source": "x", "page_start": 1, "page_end": 1, "text": "a } b" * (i % 50) + "end"} for i in range(3000)]
    (tmp_path / "long.json").write_text(json.dumps({"chunks": rows}))
    (tmp_path / "one.json").write_text(json.dumps([rows[0] | {"chunk_id": "long", "text": "{[" * 60000}]))  # one element over many parts
    found = readers.strict_chunks(spark, str(tmp_path), ("s",))
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = sorted((r.place, r.chunk_id, r.text) for r in found.collect() if r.input_file == "long.json")
    assert got == [(i, r["chunk_id"], r["text"]) for i, r in enumerate(rows)]
    assert [r.text for r in found.filter("chunk_id = 'long'").collect()] == ["{[" * 60000]
    assert found.filter("fault is not null").count() == 0


def test_empty_arrays_and_objects_without_the_array(spark, tmp_path):
    for i, text in enumerate(["[]", " [ \n] ", '{"chunks": []}', "{}", '{"chunks": 5}', '{"chunks": {"chunks": [1]}}', '{"b": [1]}', '{"b": {"chunks": [1]}}', '{"b": "chunks", "c": [1]}']):
        (tmp_path / f"{i}.json").write_text(text)
    assert read(spark, tmp_path) == {}


@pytest.mark.parametrize("text", ["", " ", "[", '[{"a": 1}', '{"chunks": [{"a": 1}]', '["a]', "5", "[1]]", "{}}"])
def test_a_broken_file_is_named(spark, tmp_path, text):
    (tmp_path / "good.json").write_text("[1]")
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(ValueError, match="not JSON.*(bad.json|an empty file)"):
        json_arrays.elements(spark, str(tmp_path), "chunks")


@pytest.mark.parametrize("text", ["[1,,2]", "[1,]", '[{"a" 1}]', "[a]"])
def test_a_broken_element_names_its_file(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="not JSON: bad.json"):
        readers.strict_chunks(spark, str(tmp_path)).collect()


def test_no_row_holds_a_file(spark):
    """A file is written as its rows come: its longest line is an element, however many there are."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("src"), F.col("id") % 2).alias("source"), F.repeat(F.lit('a } "b'), 10).alias("text"))
    path = io_queries._chunk_files(lambda table: docs, spark)
    lines = spark.read.text(path)
    assert len(lines.inputFiles()) == 2
    assert lines.agg(F.max(F.length("value"))).first()[0] < 300
    rows = readers.strict_chunks(spark, path, ("en",)).collect()
    assert sorted(int(r.chunk_id[1:]) for r in rows) == list(range(4000))
    assert all(r.text == (None if int(r.chunk_id[1:]) % 5 == 0 else 'a } "b' * 10) and r.text_missing == (r.text is None) for r in rows)


@pytest.mark.parametrize("n", [0, 1, 30])
def test_written_arrays_are_read_back(spark, tmp_path, n):
    """A null, an empty and other values each have a file, an array or an object with one."""
    made = [(i, (None, "", "a", "b")[i % 4], "\n".join(PIECES[i % 7 :])) for i in range(n)]
    df = spark.createDataFrame(made, "i int, source string, text string").repartition(3)
    path = str(tmp_path / "files")
    writers.json_arrays(df, path, "source", F.struct("i", "source", "text"), "chunks", F.hash("source") % 2 != 0)
    files = [f for f in (tmp_path / "files").iterdir() if f.name.startswith("part-")]
    content = [json.loads(f.read_text()) for f in files]
    assert len(files) == max(1, min(n, 4))
    assert all(len({e.get("source") for e in wanted(c)}) == min(n, 1) for c in content)
    assert sorted((e["i"], e.get("source"), e["text"]) for c in content for e in wanted(c)) == made
    assert sorted(e["i"] for e in read(spark, path).values()) == list(range(n))


def test_a_large_array_is_dealt_out_to_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "FILE", 20_000)
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, "few").otherwise("many").alias("source"))
    path = str(tmp_path / "files")
    writers.json_arrays(df, path, "source", F.struct("id", "source"), "chunks", F.col("source") == "many")
    content = [json.loads(f.read_text()) for f in (tmp_path / "files").iterdir() if f.name.startswith("part-")]
    many = [wanted(c) for c in content if isinstance(c, dict)]
    assert len(content) - len(many) == 1 and len(many) == 4
    assert all(500 < len(c) < 850 for c in many)
    assert sorted(e["id"] for c in content for e in wanted(c)) == list(range(3000))
    assert sorted(e["id"] for e in read(spark, path).values()) == list(range(3000))
