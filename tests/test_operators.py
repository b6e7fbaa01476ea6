import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import evaluation, fusion, graph, hierarchy, integrity, ranking, relations, security


def column(spark, c):
    return spark.range(1).select(c.alias("r")).first().r


def strings(*values):
    return F.array(*map(F.lit, values)).cast("array<string>")


# ranking and fusion


def test_bm25_ties_zeros_and_visibility(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c c a"), (4, "d"), (5, "e f")], "doc_id int, text string")
    asked = spark.createDataFrame([("q", "b b c"), ("z", "none")], "query_id string, question string")
    run = lambda **o: {(r.query_id, r.bm25_rank): r for r in ranking.bm25(docs, asked, T.legal_tokens(F.col("text")), T.legal_tokens(F.col("question")), k=4, **o).collect()}
    got = run()
    # N 5, mean length 2: c once in the corpus, ln(4.5 / 1.5) * 2 * 2.5 / (2 + 1.5 * 1.375); b twice asked, 2 ln(3.5 / 2.5)
    assert got["q", 1].bm25_score == pytest.approx(1.3521, abs=1e-3) and got["q", 2].bm25_score == pytest.approx(0.6729, abs=1e-3)
    assert [got["q", i].doc_id for i in (1, 2, 3, 4)] == [3, 1, 2, 4] and got["q", 2].bm25_score == got["q", 3].bm25_score
    assert [got["z", i].doc_id for i in (1, 2, 3, 4)] == [1, 2, 3, 4] and got["z", 1].bm25_score == 0
    seen = run(visible=docs.filter("doc_id > 1"), keep_zero=False)
    assert [k for k in seen if k[0] == "z"] == [] and [seen["q", i].doc_id for i in (1, 2)] == [3, 2] and seen["q", 2].bm25_score == got["q", 3].bm25_score


def test_rrf_order(spark):
    a = spark.createDataFrame([("q", "c1", 1), ("q", "c2", 2)], "query_id string, doc_id string, bm25_rank int")
    b = spark.createDataFrame([("q", "c2", 1), ("q", "c3", 2)], "query_id string, doc_id string, semantic_rank int")
    got = fusion.fuse(a, b, k=10).orderBy("fused_rank").collect()
    assert [r.doc_id for r in got] == ["c2", "c1", "c3"] and got[0].matched_by == ["bm25", "semantic"]
    swapped = fusion.fuse(b.withColumnRenamed("semantic_rank", "bm25_rank"), a.withColumnRenamed("bm25_rank", "semantic_rank"), k=10)
    assert {r.doc_id: r.rrf_score for r in swapped.collect()} == {r.doc_id: r.rrf_score for r in got}
    with pytest.raises(ValueError):
        fusion.fuse(a, b, weights=(0, 0))


def test_cross_query_fusion(spark):
    hits = spark.createDataFrame([("Q0", "a", 1), ("Q1", "a", 2), ("Q1", "b", 1), ("Q1", "a", 5)], "query_id string, child_id string, rank int")
    got = {r.child_id: r for r in fusion.fuse_queries(hits).collect()}
    assert got["a"].support == 2 and got["a"].score == round(1.5 / 61 + 1 / 62, 8) and got["a"].per_query_ranks == {"Q0": 1, "Q1": 2} and got["b"].merged_rank == 2


def test_rerank_sigmoid(spark):
    rows = spark.createDataFrame([("q", 1, 1, 0.0), ("q", 2, 2, 1.0)], "query_id string, doc_id int, fused_rank int, raw double")
    got = {r.doc_id: r for r in fusion.rerank(rows, F.col("raw")).collect()}
    assert got[2].rerank_score == pytest.approx(0.7310585786) and got[2].rank_change == 1 and got[1].rank_change == -1


def test_gate(spark):
    rows = spark.createDataFrame([(1, 0.45), (2, 0.46), (3, None)], "id int, distance double")
    assert [r.accepted for r in fusion.gate(rows, "hybrid").orderBy("id").collect()] == [True, False, False]
    with pytest.raises(ValueError):
        fusion.gate(rows, "other")


def test_budget(spark):
    rows = lambda *sizes: spark.createDataFrame([("q", f"p{i}", s, i) for i, s in enumerate(sizes)], "query_id string, parent_id string, char_count int, parent_rank int")
    run = lambda *sizes: [(r.selected, r.oversized) for r in fusion.within_budget(rows(*sizes), 10).orderBy("parent_rank").collect()]
    assert run(6, 5, 4) == [(True, False), (False, False), (True, False)]
    assert run(20, 1) == [(True, True), (False, False)]


def test_variants(spark):
    rows = spark.createDataFrame(
        [("q", 1, "Điều 5 là gì", "conditions"), ("q", 2, "Điều 5  là gì?", "conditions"), ("q", 3, "Điều 6", "conditions"), ("q", 4, "x", "odd"), ("q", 5, " ", "conditions"), ("q", 6, "y " * 200, "conditions"), ("p", 1, "no reference", "conditions")],
        "question_id string, place int, text string, focus string",
    )
    got = {(r.question_id, r.place): r.reason for r in fusion.valid_variants(rows, strings("Điều 5")).collect()}
    assert got == {("q", 1): None, ("q", 2): "repeat", ("q", 3): "reference", ("q", 4): "focus", ("q", 5): "empty", ("q", 6): "length", ("p", 1): "no_reference"}


def test_vectors(spark):
    faults = lambda v: column(spark, ranking.vector_faults(F.array(*map(F.lit, v)).cast("array<double>"), 2))
    assert [faults(v) for v in ([1.0, 2.0], [1.0], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0])] == [None, "size", "zero", "not_finite", "not_finite"]
    assert column(spark, ranking.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.5**0.5)


def test_search_terms(spark):
    assert column(spark, ranking.search_terms(strings("bb", "a", "cccc", "bb"))) == ["cccc", "bb", "a"]
    assert column(spark, ranking.search_terms(strings("bb", "a", "2016"))) == ["bb"]


# hierarchy


def chunks(spark, *rows):
    return spark.createDataFrame(list(rows), "chunk_id string, source string, text string")


def test_paths(spark):
    rows = chunks(spark, ("c1", "s", "Điều 7. Nội dung"), ("c2", "s", "tiếp theo Điều 9 ở giữa"), ("c10", "s", "Khoản 2 nữa"), ("c3", "s", "x"), ("c1", "t", "mở đầu"))
    got = {(r.source, r.chunk_id): r for r in hierarchy.resolve_paths(rows).collect()}
    assert got["s", "c1"].path.article == "Điều 7" and got["s", "c1"].resolution_method == "heading_inferred"
    assert got["s", "c2"].resolution_method == "carried_forward" and got["s", "c2"].path.article == "Điều 7"
    assert got["s", "c10"].path.article is None and got["s", "c10"].warnings == ["clause_without_article", "article_missing"]
    assert got["t", "c1"].resolution_method == "document_fallback"


def test_metadata_before_heading(spark):
    rows = chunks(spark, ("c1", "s", "Điều 7. Nội dung"))
    meta = hierarchy.structure_path(F.parse_json(F.lit('[{"type": "Article", "label": "Điều 8"}]')))
    r = hierarchy.resolve_paths(rows, metadata=meta).first()
    assert r.path.article == "Điều 8" and r.resolution_method == "metadata" and r.ambiguous and r.warnings == ["metadata_heading_conflict"]


def test_packing(spark):
    rows = chunks(spark, *[(f"c{i}", "s", "Điều 1. " + "x" * n if i == 1 else "x" * n) for i, n in enumerate((40, 50, 200, 10, 30), 1)])
    parents, packed = hierarchy.build_parents(hierarchy.resolve_paths(rows), 100)
    assert [r.window_index for r in packed.orderBy(T.natural_key(F.col("chunk_id"))).collect()] == [0, 0, 1, 2, 2]
    assert sorted(c for p in parents.collect() for c in p.child_ids) == ["c1", "c2", "c3", "c4", "c5"]
    assert hierarchy.twice_assigned(packed).count() == 0


def test_tree(spark):
    texts = ["mở đầu", "Chương I", "Điều 1", "nội dung", "1. khoản", "Điều 2", "Chương II", "a) điểm"]
    rows = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "page_id string, place int, text string")
    got = hierarchy.block_tree(rows).orderBy("place").collect()
    assert [r.level for r in got] == ["content", "chapter", "article", "content", "clause", "article", "chapter", "item"]
    assert [r.parent_id for r in got] == ["d", "d", "d:002", "d:003", "d:003", "d:002", "d", "d:007"]
    assert got[1].next_id == "d:007" and got[2].next_id == "d:006" and got[0].next_id == "d:002"


def test_articles(spark):
    docs = spark.createDataFrame([(1, "lời mở đầu của văn bản này\nĐiều 1. Phạm vi điều chỉnh\nnội  dung\n\nĐiều 2. x")], "doc_id int, text string")
    got = hierarchy.split_articles(docs).orderBy("chunk_no").collect()
    assert [(r.chunk_id, r.text) for r in got] == [("1_c001", "lời mở đầu của văn bản này"), ("1_c002", "Điều 1. Phạm vi điều chỉnh\nnội dung")]


# graph, relations


def test_trails(spark):
    edges = spark.createDataFrame([("a", "b", "X", 1), ("b", "c", "Y", 2), ("a", "b", "Z", 3)], "src string, dst string, kind string, edge_id int")
    seeds = spark.createDataFrame([("a",)], "node string")
    run = lambda h: {(r.node, r.hop, tuple(r.path)) for r in graph.expand(seeds, edges, h).collect()}
    assert run(0) == set() and run(1) == {("b", 1, ("X",)), ("b", 1, ("Z",))}
    assert run(2) == run(1) | {("c", 2, ("X", "Y")), ("c", 2, ("Z", "Y"))}
    assert {(r.node, r.hop) for r in graph.nearest(graph.expand(seeds, edges, 3)).collect()} == {("b", 1), ("c", 2)}
    with pytest.raises(ValueError):
        graph.expand(seeds, edges, 4)


def test_edge_validation(spark):
    rows = [(1, "a", "b", "R", "e"), (2, "A", "B", "R", "e"), (3, "a", "A", "R", "e"), (4, "", "b", "R", "nan"), (5, "a", "c", "Q", "e"), (6, "a", "b", "R", "")]
    e = spark.createDataFrame(rows, "id int, source string, target string, relationship_type string, evidence string")
    got = {r.id: r.reasons for r in relations.validate_edges(e, ["R"], [F.col("id")]).collect()}
    assert got == {1: [], 2: ["duplicate"], 3: ["self_loop"], 4: ["missing_source", "missing_evidence"], 5: ["unknown_type"], 6: ["missing_evidence", "duplicate"]}
    known = spark.createDataFrame([("b",)], "name string")
    got = {r.id: r.reasons for r in relations.validate_edges(e.filter("id in (1, 5)"), ["R", "Q"], [F.col("id")], known, ["R", "Q"]).collect()}
    assert got == {1: [], 5: ["unknown_entity"]}


def test_relation_direction(spark):
    docs = spark.createDataFrame([(1, "1/2020/X", "Luật này thay thế 73/2016/NĐ-CP."), (2, "2/2020/X", "Căn cứ 73/2016/NĐ-CP và 2/2020/X")], "doc_id int, number string, text string")
    found = relations.candidates(docs, own=F.col("number")).join(docs.select("doc_id", F.col("number").alias("source")), "doc_id")
    got = {(r.source, r.relationship_type, r.target, float(r.confidence)) for r in relations.typed(found).collect()}
    assert got == {("73/2016/NĐ-CP", "THAY_THE_BOI", "1/2020/X", 0.9), ("2/2020/X", "THAM_CHIEU", "73/2016/NĐ-CP", 0.85)}


def test_contained(spark):
    texts = spark.createDataFrame([(1, "so the big red dog ran away home"), (2, "xbig red dog ran awayx"), (3, "short")], "doc_id int, text string")
    patterns = spark.createDataFrame([(1, "big red dog ran away"), (2, "hort"), (3, "absent words in here now")], "item_id int, pattern string")
    assert {(r.doc_id, r.item_id) for r in relations.contained_in(texts, patterns).collect()} == {(1, 1), (2, 1), (3, 2)}


# security


def test_roles(spark):
    assert security.known_roles("nobody") == [] and security.known_roles("x", "Guest") == ["Guest"]
    assert security.known_roles(["staff", " risk manager"]) == ["Staff", "Risk_Manager"]
    rows = spark.createDataFrame([(1, ["Admin", "HR"]), (2, ["Staff"]), (3, None)], "doc_id int, allowed_roles array<string>")
    see = lambda r, **o: {x.doc_id for x in security.accessible(rows, r, **o).collect()}
    assert see("HR") == {1} and see("nobody") == set() and see(["HR", "Staff"]) == {1, 2} and see("HR", null_visible=True) == {1, 3}
    assert see("HR") <= see(["HR", "Admin"]) <= see(list(security.ROLES))


def test_tags_and_answers(spark):
    tag = lambda n, t: column(spark, security.tag(F.lit(n), F.lit(t)))
    assert [tag("01/2025/TT-NHNN", ""), tag(None, "Quản trị rủi ro và lương"), tag("", "nợ xấu"), tag("x", "y")] == ["HR", "HR", "RISK", "GENERAL"]
    hits = spark.createDataFrame([("q", 1, "t1", "c1", ["HR"]), ("q", 2, "t2", "c2", ["Staff"]), ("p", 1, "t3", "c3", ["HR"])], "query_id string, rank int, text string, citation string, allowed_roles array<string>")
    got = {r.query_id: (r.answer, r.status, r.filtered_count) for r in security.policy_answer(hits, "Staff").collect()}
    assert got == {"q": ("t2 [c2]", "answered", 1), "p": (None, "denied", 1)}


# evaluation, checks


def test_metrics(spark):
    p, r = strings("c1", "c2", "c3"), strings("c1", "c3")
    assert column(spark, evaluation.recall_at(p, r, 2)) == 0.5 and column(spark, evaluation.recall_at(p, strings(), 2)) == 0
    assert column(spark, evaluation.reciprocal_rank(p, strings("c3"), 3)) == pytest.approx(1 / 3) and column(spark, evaluation.reciprocal_rank(p, strings("x"), 3)) == 0
    assert column(spark, evaluation.ndcg(strings("x", "c1", "c2"), strings("c1", "c2"), 3)) == pytest.approx(0.6934264)
    assert column(spark, evaluation.ndcg(strings("c1"), strings("c1", "c2"), 3)) == 1
    assert column(spark, evaluation.ndcg(strings("c1"), strings("c1", "c2"), 3, "full")) == pytest.approx(1 / (1 + 1 / 1.5849625))


def test_relation_metrics(spark):
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "k int")
    r = evaluation.relation_scores(rows(1, 2, 3, 4), rows(1, 2, 5, 6, 7, 8, 9, 10), ["k"]).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (2, 2, 6, 0.5, 0.25) and r.f1 == pytest.approx(1 / 3)
    none = evaluation.relation_scores(rows(1).limit(0), rows(1).limit(0), ["k"]).first()
    assert (none.precision, none.recall, none.f1) == (0, 0, 0)


def test_checks(spark):
    pages = spark.createDataFrame([("a", "[[b]] [[x]]"), ("b", "[[a|A]] [[a]]"), ("c", "")], "id string, body string")
    assert {r.id: (r.n_out, r.n_in, r.n_broken) for r in integrity.link_check(pages).collect()} == {"a": (2, 2, 1), "b": (2, 1, 0), "c": (0, 0, 0)}
    p = {r.column: r for r in integrity.profile(spark.createDataFrame([("nan", 1), ("", None), (None, 2)], "a string, b int")).collect()}
    assert (p["a"].n_null, p["a"].n_empty, p["a"].n_marked, p["b"].n_null) == (1, 1, 1, 1)


def test_upsert_is_idempotent(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "id int, v string")
    once = graph.upsert(now, new, ["id"], [F.desc("v")])
    assert sorted(once.collect()) == [(1, "a"), (2, "d"), (3, "e")] == sorted(graph.upsert(once, new, ["id"], [F.desc("v")]).collect())
