"""Behaviour that the DuckDB twins don't show: faults, orders, plain versions of what SQL can't express."""

import html as entities
import json
import random
import re
import struct
import time
import unicodedata

import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
from docloom.functions import arrays
from docloom.functions import html as H
from docloom.functions import text as T
from docloom.operators import fusion, hierarchy, ranking, relations
from docloom.shared import numbered
from docloom.sources import readers, writers

SF = "/root/testdata/sf0.001"


# arrays


@pytest.mark.parametrize("block", [1, 2, 7, 256])
def test_scan_of_any_length(spark, monkeypatch, block):
    monkeypatch.setattr(arrays, "BLOCK", block)
    lists = [None, [], [5], list(range(8)), list(range(50))]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>")
    got = {r.i: r.s for r in df.select("i", arrays.running_sum(F.col("x")).alias("s")).collect()}
    for i, x in enumerate(lists):
        assert got[i] == (None if x is None else [sum(x[: k + 1]) for k in range(len(x))])


def test_matches_of_long_texts_take_linear_time(spark):
    took = {}
    for n in (1_000, 50_000, 100_000, 200_000):
        df = spark.createDataFrame([("12 é " * n,)], "t string")
        began = time.perf_counter()
        last = df.select(F.element_at(T.matches(F.col("t"), r"\d+"), -1).alias("m")).first().m
        took[n] = time.perf_counter() - began
        assert (last.start, last.end, last.word) == (5 * n - 5, 5 * n - 3, "12")
    assert took[200_000] < 8 * max(took[50_000], 0.5)


def test_places_in_a_whole_table(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "a", "b", "c"])) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, s string").repartition(9)
    got = [r.i for r in sorted(numbered(df, F.col("s").asc_nulls_last(), F.col("i").desc()).collect(), key=lambda r: r.place)]
    assert got == [i for i, _ in sorted(rows, key=lambda r: (r[1] is None, r[1] or "", -r[0]))]
    assert numbered(df.limit(0), F.col("i")).count() == 0


# ranking


def test_texts_that_contain_terms(spark):
    rng = random.Random(3)
    docs = [(i, "".join(rng.choice("abAB1 é-") for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(100, "ab" * 50), (101, None)]
    terms = ["a", "ab", "1a", "b-", "é", "-", "ba1", "abab", ""]
    got = set(map(tuple, ranking.containing(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()))
    assert got == {(i, t) for i, x in docs for t in terms if t and t in (x or "").lower()}


def test_strings_by_how_often_they_occur(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["ab", "b", "Abc", "x1"]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    needles = ["ab", "b", "ab b", "b abc x1 ab b ab", "abc ab ab b b x1"]
    docs.append((60, f"x {needles[3]} y {needles[3]}"))
    got = {(r.query_id, r.doc_id): r.hits for r in ranking.substring_rank(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(list(enumerate(needles)), "query_id int, needle string"), k=1000).collect()}
    assert got == {(q, i): t.lower().count(n) for q, n in enumerate(needles) for i, t in docs if n in t.lower()}


def test_composed_and_decomposed_questions_find_the_same(spark):
    texts = ["Điều kiện vay vốn của khách hàng", "Hồ sơ vay vốn", "lãi suất cho vay", "một hai ba", "bốn năm sáu", "bảy tám chín", "mười"]
    docs = spark.createDataFrame([(i, unicodedata.normalize("NFD" if i % 2 else "NFC", t)) for i, t in enumerate(texts)], "doc_id int, text string")
    asked = spark.createDataFrame([("composed", "điều kiện vay vốn"), ("decomposed", unicodedata.normalize("NFD", "ĐIỀU KIỆN vay vốn"))], "query_id string, question string")
    found = {}
    for r in ranking.bm25(docs, asked, T.legal_tokens(F.col("text")), T.legal_tokens(F.col("question")), keep_zero=False).collect():
        found.setdefault(r.query_id, {})[r.doc_id] = round(r.bm25_score, 9)
    assert found["composed"] == found["decomposed"] and set(found["composed"]) == {0, 1, 2}


def test_counts_of_terms_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(ranking, "COUNTED", 2)
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, []), (4, None), (None, ["c"])], "doc_id int, tokens array<string>").repartition(2)
    for wanted, want in ((None, {(1, "a", 2, 3), (1, "b", 1, 3), (2, "b", 1, 1), (None, "c", 1, 1)}), (spark.createDataFrame([("b",), ("z",)], "term string"), {(1, "b", 1, 3), (2, "b", 1, 1)})):
        rows = ranking.count_terms(docs, wanted).collect()
        assert {(r.key, r.term, r.tf, r.length) for r in rows if r.tf is not None} == want
        df = {}
        for r in rows:
            if r.df is not None:
                df[r.term] = df.get(r.term, 0) + r.df
        assert df == {"a": 1, "b": 2, "c": 1, None: 5}
        assert sum(r.length or 0 for r in rows if r.term is None) == 5
    assert [r for r in ranking.count_terms(docs.limit(0)).collect() if r.df] == []


def test_a_question_without_tokens(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id int, text string")
    asked = spark.createDataFrame([("q", "a"), ("none", "?!")], "query_id string, question string")
    run = lambda **o: ranking.bm25(docs, asked, T.legal_tokens(F.col("text")), T.legal_tokens(F.col("question")), keep_zero=False, **o)
    with pytest.raises(Exception, match="a question without tokens: none"):
        run().collect()
    assert [r.query_id for r in run(without="skip").collect()] == ["q"]


def test_cascade_of_lists(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "query_id int, doc_id int, rank int")
    out = ranking.hybrid_cascade(rows((1, 10, 1), (1, 11, 2), (2, 20, 1)), rows((1, 11, 1), (3, 30, 1)), rows((1, 99, 1), (2, 99, 1), (3, 99, 1), (4, 40, 1)))
    assert sorted((r.query_id, r.doc_id, r["rank"], r.stage) for r in out.collect()) == [(1, 10, 2, 1), (1, 11, 1, 1), (2, 20, 1, 2), (3, 30, 1, 3), (4, 40, 1, 4)]


# fusion


def test_lists_that_tell_different_things(spark):
    a = spark.createDataFrame([("q", 1, 1, "s")], "query_id string, doc_id int, bm25_rank int, source string")
    same = spark.createDataFrame([("q", 1, 1, "s"), ("q", 2, 2, "t")], "query_id string, doc_id int, semantic_rank int, source string")
    assert {r.doc_id: r.source for r in fusion.fuse(a, same, metadata=("source",)).collect()} == {1: "s", 2: "t"}
    with pytest.raises(Exception, match="the lists differ in what they tell of 1"):
        fusion.fuse(a, same.withColumn("source", F.lit("other")), metadata=("source",)).collect()


def test_parents_by_supporting_queries(spark):
    children = [("a1", 1, ["Q0"]), ("b1", 2, ["Q0"]), ("b2", 5, ["Q1"]), ("a2", 6, ["Q0"]), ("a3", 7, ["Q0"]), ("a4", 8, ["Q0"]), ("c1", 9, ["Q0", "Q2"]), ("d1", 9, ["Q0"])]
    df = spark.createDataFrame([(c, r, {q: r for q in qs}) for c, r, qs in children], "child_id string, merged_rank int, per_query_ranks map<string,int>")
    parents = spark.createDataFrame([(c, c[0]) for c, _, _ in children], "child_id string, parent_id string")
    got = {r.parent_id: r for r in fusion.aggregate_parents(df, parents).collect()}
    assert (got["a"].n_children, got["a"].n_queries, got["a"].anchor, got["a"].best_child_rank) == (4, 1, "a1", 1)
    assert got["a"].score == pytest.approx(round(1 / 61 + 1 / 66 + 1 / 67, 8)) and got["b"].n_queries == 2
    # c and d have one score and one best rank; more queries found c
    assert got["c"].score == got["d"].score and got["c"].parent_rank < got["d"].parent_rank
    by = fusion.aggregate_parents(df.withColumn("question", F.lit(1)).unionByName(df.withColumn("question", F.lit(2))), parents, question=["question"])
    assert sorted(r.parent_rank for r in by.collect()) == sorted([*range(1, 5)] * 2)


def test_modes(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, doc_id int, bm25_rank int")
    b = spark.createDataFrame([("q", 2, 1), ("q", 3, 2)], "query_id string, doc_id int, semantic_rank int")

    def unused():
        raise AssertionError("not needed in this mode")

    ids = lambda rows: [r.doc_id for r in sorted(rows.collect(), key=lambda r: r["rank"])]
    assert ids(fusion.run_query("bm25", lambda: a, unused)) == [1, 2] and ids(fusion.run_query("semantic", unused, lambda: b)) == [2, 3]
    assert ids(fusion.run_query("hybrid", lambda: a, lambda: b, k=2)) == [2, 1]
    turned = lambda rows: fusion.rerank(rows, F.col("doc_id").cast("double"))
    assert ids(fusion.run_query("hybrid_rerank", lambda: a, lambda: b, turned)) == [3, 2, 1]
    for bad in (lambda: fusion.run_query("other", unused, unused), lambda: fusion.run_query("hybrid_rerank", lambda: a, lambda: b), lambda: fusion.run_parent_query("single_parent", a), lambda: fusion.run_parent_query("other", a)):
        with pytest.raises(ValueError):
            bad()


def test_rerank_cuts_texts_and_goes_without_a_model(spark):
    df = spark.createDataFrame([("q", 1, 1, "x" * 10 + "hit"), ("q", 2, 2, "hit" + "x" * 10), ("q", 3, 3, "none")], "query_id string, doc_id int, fused_rank int, text string")
    hit = lambda text: F.when(text.contains("hit"), 1.0).otherwise(0.0)
    ids = lambda rows: [r.doc_id for r in sorted(rows.collect(), key=lambda r: r.final_rank)]
    assert ids(fusion.rerank(df, hit, most_chars=5)) == [2, 1, 3] and ids(fusion.rerank(df, hit)) == [1, 2, 3]
    kept = fusion.rerank(df, None)
    assert ids(kept) == [1, 2, 3] and all(r.rerank_score is None for r in kept.collect())
    with pytest.raises(ValueError):
        fusion.rerank(df, F.lit(1.0), most_chars=5)


def test_how_runs_over_variants_end(spark):
    df = spark.createDataFrame([(2, 0, True), (2, 1, True), (0, 1, True), (2, 1, False)], "n int, failed int, ok boolean")
    one = lambda *a: [r.s for r in df.select(fusion.mode_status(*a).alias("s")).collect()]
    assert one("multi_flat", F.col("n"), F.col("failed")) == ["multi_flat_ready", "multi_flat_partial", "insufficient_evidence", "multi_flat_partial"]
    assert one("multi_parent", F.col("n"), F.col("failed"), F.col("ok")) == ["parent_ready", "parent_partial", "insufficient_evidence", "citation_validation_failed"]


def test_variants_from_a_cache(spark):
    asked = spark.createDataFrame([(1, " What  is it"), (2, "what is it"), (3, "other")], "id int, question string")
    cache = asked.filter("id = 2").select(fusion.query_key(F.col("question"), "v1").alias("query_key"), F.array(F.lit("a")).alias("variants"))
    hit, miss = fusion.cached_variants(asked, cache, config="v1")
    assert {r.id for r in hit.collect()} == {1, 2} and {r.id for r in miss.collect()} == {3}
    assert fusion.cached_variants(asked, cache, config="v2")[0].count() == 0


# hierarchies


def test_parents_have_pages_and_warnings(spark):
    rows = [("c1", "s", "Điều 1. a", 3, 4), ("c2", "s", "x" * 200, 2, 9), ("d1", "t", "nothing", 1, 1)]
    df = spark.createDataFrame(rows, "chunk_id string, source string, text string, page_start int, page_end int")
    parents = {tuple(p.child_ids): p for p in hierarchy.build_parents(hierarchy.resolve_paths(df), 100)[0].collect()}
    assert "oversized_single_child" in parents["c2",].warnings and "oversized_single_child" not in parents["c1",].warnings
    assert "document_fallback_parent" in parents["d1",].warnings and "document_fallback_parent" not in parents["c1",].warnings
    whole = hierarchy.build_parents(hierarchy.resolve_paths(df), 1000)[0].filter("source = 's'").first()
    assert (whole.page_start, whole.page_end) == (2, 9)


def test_packing_by_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [(f"c{i}", rng.choice(["s", "t"]), rng.choice([0, 5, 30, 80, 200])) for i in range(700)]
    df = spark.createDataFrame(rows, "chunk_id string, source string, n int")
    got = {r.chunk_id: r.window_index for r in hierarchy.pack(df, ["source"], [T.natural_key(F.col("chunk_id"))], F.col("n"), 100).collect()}
    for s in ("s", "t"):
        window, used = -1, 0
        for chunk, _, n in (r for r in rows if r[1] == s):
            if window < 0 or used + n > 100:
                window, used = window + 1, 0
            used += n
            assert got[chunk] == window


def test_chapter_labels_are_cut(spark):
    df = spark.createDataFrame([("Chương I\nQUY ĐỊNH CHUNG " + "rất dài " * 100,)], "text string")
    cut = df.select(hierarchy.headings(F.col("text")).alias("h")).first().h.chapter
    whole = df.select(hierarchy.headings(F.col("text"), longest=None).alias("h")).first().h.chapter
    assert len(cut) <= hierarchy.LONGEST_LABEL < len(whole) and whole.startswith(cut)


def test_levels_in_both_readings(spark):
    """Block levels are read at the start of a block; the words alone, further in, make no heading."""
    texts = ["Điều 5 quy định", "1. khoản một", "theo điểm a khoản 2", "Chương II"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.l for r in df.select(hierarchy.block_level(F.col("t")).alias("l")).collect()] == ["article", "clause", "content", "chapter"]
    anywhere = {k: p.replace("^", "") for k, p in hierarchy.BEGINNINGS.items()}
    assert df.select(hierarchy.block_level(F.col("t"), anywhere).alias("l")).collect()[2].l in ("clause", "item")


# sources and sinks


def test_the_last_of_repeated_keys(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.csv").write_text("doc_id,title\n1,first\n 2 ,two\n1,second\n,none\n")
    (tmp_path / "m" / "b.csv").write_text("doc_id,title\n2,last\n3,three\n")
    got = {r.id: r.title for r in readers.metadata(spark, str(tmp_path / "m"), "doc_id string, title string").collect()}
    assert got == {"1": "second", "2": "last", "3": "three"}


def test_questions_must_be_an_array(spark, tmp_path):
    good, bad, broken = (tmp_path / n for n in ("good.json", "bad.json", "broken.json"))
    good.write_text(json.dumps([{"id": "1", "question": "q"}]))
    bad.write_text(json.dumps({"questions": []}))
    broken.write_text("[")
    assert readers.questions(spark, str(good)).count() == 1
    for path in (bad, broken):
        with pytest.raises(Exception, match="questions must be a JSON array"):
            readers.questions(spark, str(path)).collect()


def test_upserts_leave_older_versions_alone(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.parquet(str(tmp_path / "t"))
    change = lambda i, v: spark.createDataFrame([(i, v)], "id int, v string")
    first = writers.upsert_table(spark, str(tmp_path / "t"), change(1, "c"), ["id"], [F.col("v")])
    before = spark.read.parquet(first)
    second = writers.upsert_table(spark, first, change(2, "d"), ["id"], [F.col("v")])
    third = writers.upsert_table(spark, str(tmp_path / "t"), change(3, "e"), ["id"], [F.col("v")])
    assert sorted(map(tuple, before.collect())) == [(1, "c"), (2, "b")]
    assert sorted(map(tuple, spark.read.parquet(second).collect())) == [(1, "c"), (2, "d")]
    assert sorted(map(tuple, spark.read.parquet(third).collect())) == [(1, "a"), (2, "b"), (3, "e")]


def test_store_of_another_strategy(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    built = spark.createDataFrame(writers.manifest(spark, str(tmp_path), {"k": 1}, strategy="flat").collect())
    now = writers.file_hashes(spark, str(tmp_path))
    assert writers.staleness(built, now, {"k": 2}) == "strategy_mismatch" and writers.staleness(built, now, {"k": 1}, strategy="flat") == "fresh"


# queries without SQL


def test_page_texts_by_patterns(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in __spark_entry__.queries()["txt_12_html_text"](spark, SF).collect():
        t = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1>|<[^>]*>", "\0", pages[r.page_id])
        want = " ".join(x for p in t.split("\0") if (x := entities.unescape(p).strip()))
        assert r.text == re.sub(r"\s+", " ", want).strip()


def test_page_blocks_by_tags(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    want = set()
    for page, t in pages.items():
        t = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1>", "\0", t)
        open_, block, place, pieces = [], None, 0, []
        for tag, text in re.findall(r"(<[^>]*>)|([^<]+)", t):
            name = re.sub(r"[</>\s].*", "", tag.lstrip("</"), flags=re.S).lower()
            if text:
                if block is not None:
                    pieces += text.split("\0")
            elif name in H.VOID or not re.match(r"</?[a-zA-Z]", tag):
                pieces.append("")
            elif not tag.startswith("</"):
                if name in H.BLOCKS and block is None:
                    block, place, pieces, kind = len(open_), place + 1, [], name
                open_.append(name)
            elif name in open_:
                while open_.pop() != name:
                    pass
                if block is not None and len(open_) <= block:
                    found = re.sub(r"\s+", " ", " ".join(x for p in pieces if (x := entities.unescape(p).strip()))).strip()
                    want |= {(page, place, kind, found)} if found else set()
                    block = None
        if block is not None:
            found = re.sub(r"\s+", " ", " ".join(x for p in pieces if (x := entities.unescape(p).strip()))).strip()
            want |= {(page, place, kind, found)} if found else set()
    assert set(map(tuple, __spark_entry__.queries()["chk_01_html_blocks"](spark, SF).collect())) == want


def test_block_tree_by_a_stack(spark):
    rows = {}
    for r in __spark_entry__.queries()["chk_04_block_tree"](spark, SF).collect():
        rows.setdefault(r.page_id, []).append(r)
    for page, blocks in rows.items():
        stack, last = [], {}
        for r in sorted(blocks, key=lambda r: r.block_no):
            depth = hierarchy.LEVELS[r.level]
            if r.level == "content":
                parent = stack[-1][1] if stack else str(page)
            else:
                while stack and stack[-1][0] >= depth:
                    stack.pop()
                parent = stack[-1][1] if stack else str(page)
                stack.append((depth, r.block_id))
            assert r.parent_id == parent
            if parent in last:
                assert last[parent].next_id == r.block_id
            last[parent] = r
        assert all(r.next_id is None for r in last.values())


def test_sample_by_the_published_hash(spark):
    ids = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]

    def key(i):
        h = xxhash.xxh64_intdigest(struct.pack("<i", 42), xxhash.xxh64_intdigest(struct.pack("<q", i), 42))
        return (h - (1 << 64) if h >> 63 else h, i)

    assert {r.doc_id for r in __spark_entry__.queries()["top_03_sample"](spark, SF).collect()} == set(sorted(ids, key=key)[:20])


def test_contained_patterns_by_a_plain_search(spark):
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 25)))) for i in range(60)]
    patterns = [(i, " ".join(rng.choice("abc") for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8])]
    got = relations.contained_in(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(patterns, "item_id int, pattern string")).collect()
    assert sorted(map(tuple, got)) == sorted((i, j) for i, t in texts for j, p in patterns if p in t)
