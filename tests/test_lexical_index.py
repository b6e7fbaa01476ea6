"""An index that is added to, changed and deleted from against BM25 over the texts as they are."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import lexical_index, ranking



class Column:
    """Tokens of a column, made when there is a session."""

    def __init__(self, name):
        self.name = name

    def __call__(self):
        return T.legal_tokens(F.col(self.name))


TOKENS, ASKED = Column("text"), Column("question")


def made(rng, ids, topics=30):
    """Documents about one of some topics, neighbours about the same one, as in files of one subject."""
    out = []
    for i in ids:
        topic = i // 40 % topics
        words = [f"t{topic}w{rng.randrange(8)}" if rng.random() < 0.4 else f"common{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randint(0, 40))]
        out.append((i, " ".join(words), f"f{i // 40}"))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, file string").repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(3)
    rows = [(f"q{i}", " ".join([f"t{rng.randrange(30)}w{rng.randrange(8)}", f"common{rng.randrange(5)}", f"common{rng.randrange(60)}", "nowhere"])) for i in range(12)]
    return spark.createDataFrame(rows, "query_id string, question string")


def rows(df):
    return sorted((r.query_id, r.bm25_rank, r.doc_id, round(r.bm25_score, 8)) for r in df.collect())


def whole(docs, asked, k):
    return rows(ranking.bm25(docs, asked, TOKENS(), ASKED(), k=k, keep_zero=False))


def test_upkeep_equals_a_rebuild(spark, asked, tmp_path):
    path, rng = str(tmp_path), random.Random(5)
    now = {r[0]: r for r in made(rng, range(1200))}
    lexical_index.add_documents(frame(spark, list(now.values())), TOKENS(), path, origin=F.col("file"))
    first = whole(frame(spark, list(now.values())), asked, 7)
    assert rows(lexical_index.search(asked, ASKED(), path, k=7)) == first
    changed = made(rng, [*range(100, 130), *range(5000, 5040)])
    now |= {r[0]: r for r in changed}
    assert lexical_index.add_documents(frame(spark, changed), TOKENS(), path, origin=F.col("file")) == 2
    assert rows(lexical_index.search(asked, ASKED(), path, k=7)) == whole(frame(spark, list(now.values())), asked, 7)
    for i in (3, 110, 5001, 5002):
        del now[i]
    lexical_index.delete_documents(spark.createDataFrame([(3,), (110,), (5001,), (5002,), (999_999,), (None,)], "doc_id long"), path)
    want = whole(frame(spark, list(now.values())), asked, 7)
    assert rows(lexical_index.search(asked, ASKED(), path, k=7)) == want
    assert lexical_index.compact(spark, path) == 4
    assert rows(lexical_index.search(asked, ASKED(), path, k=7)) == want
    assert len(lexical_index.version(spark, path).segments) == 1
    # the first version is still there
    assert rows(lexical_index.search(asked, ASKED(), path, k=7, number=1)) == first


def test_changed_files(spark, asked, tmp_path):
    path, rng = str(tmp_path), random.Random(6)
    old = made(rng, range(400))
    lexical_index.add_documents(frame(spark, old), TOKENS(), path, origin=F.col("file"))
    new = [r for r in old if r[2] not in ("f2", "f3")] + made(rng, [*range(80, 100), *range(700, 720)])
    manifest = lambda rows_: spark.createDataFrame(sorted({(f, str(hash(tuple(r for r in rows_ if r[2] == f)))) for f in {r[2] for r in rows_}}), "file string, sha256 string")
    changes = lexical_index.changed_files(manifest(old), manifest(new))
    assert sorted(map(tuple, changes.collect())) == [("f17", "added"), ("f2", "changed"), ("f3", "deleted")]
    lexical_index.refresh(frame(spark, new), changes, TOKENS(), path)
    assert rows(lexical_index.search(asked, ASKED(), path)) == whole(frame(spark, new), asked, 10)
    last = lexical_index.version(spark, path)
    assert spark.read.parquet(f"{path}/segments/{last.segments[-1]}/documents").count() == 40


def test_blocks_that_cannot_matter_are_left_out(spark, asked, tmp_path):
    docs, shares = frame(spark, made(random.Random(7), range(6000))), []
    lexical_index.add_documents(docs, TOKENS(), str(tmp_path))
    for k in (1, 5, 3000):
        assert rows(lexical_index.search(asked, ASKED(), str(tmp_path), k=k, shares=shares)) == whole(docs, asked, k)
    assert shares[0] < 0.5 and shares[2] == 1.0


def test_edges(spark, asked, tmp_path):
    with pytest.raises(ValueError):
        lexical_index.search(asked, ASKED(), str(tmp_path / "none"))
    path = str(tmp_path / "few")
    docs = frame(spark, [(1, None, None), (2, "", "f"), (None, "common1", "f"), (3, "common1 common1 t1w1", "f")])
    lexical_index.add_documents(docs, TOKENS(), path)
    assert [r.doc_id for r in lexical_index.search(asked, ASKED(), path).select("doc_id").distinct().collect()] in ([3], [])
    assert lexical_index.version(spark, path).n == 3
    lexical_index.add_documents(docs.limit(0), TOKENS(), path)
    assert lexical_index.version(spark, path).n == 3


@pytest.mark.parametrize("held", [7, 10**6])
def test_search_shuffles_postings_once_for_all_questions(spark, asked, tmp_path, monkeypatch, held):
    """Questions in packs and passes, blocks in packs, a term whose documents are all dead; what tasks hand on follows ``k``."""
    for name, n in (("MOST_WEIGHTS", held), ("QUESTIONS", 5), ("BLOCKS", 3)):
        monkeypatch.setattr(lexical_index, name, n)
    path, rng = str(tmp_path), random.Random(9)
    now = {r[0]: r for r in made(rng, range(900))} | {900: (900, "nowhere common1", "f")}
    lexical_index.add_documents(frame(spark, list(now.values())), TOKENS(), path)
    changed = made(rng, range(200, 500))
    now |= {r[0]: r for r in changed}
    lexical_index.add_documents(frame(spark, changed), TOKENS(), path)
    for i in (*range(0, 100), 900):
        del now[i]
    lexical_index.delete_documents(spark.createDataFrame([(i,) for i in (*range(0, 100), 900)], "doc_id long"), path)
    handed, over = [], lexical_index._scores

    def counted(shared, *rest):
        inner = over(shared, *rest)
        total = spark.sparkContext.accumulator(0)
        handed.append(total)

        def run(batches):
            for b in inner(batches):
                total.add(b.num_rows)
                yield b

        return run

    monkeypatch.setattr(lexical_index, "_scores", counted)
    many = asked.unionByName(asked.selectExpr("concat(query_id, 'b') query_id", "concat(question, ' common2 common3') question"))
    assert rows(lexical_index.search(many, ASKED(), path, k=2)) == whole(frame(spark, list(now.values())), many, 2)
    if held > 7:
        pairs = 24 * len(now)
        assert 0 < handed[-1].value < pairs / 5


def test_postings_of_parts(spark):
    """Blocks that are cut by batches have a row for each part; their counts add up."""
    docs = spark.createDataFrame([(i // 4, i, 3, ["a", f"t{i % 2}"], [2, 1]) for i in range(30)], "block long, key long, length long, terms array<string>, times array<long>").coalesce(1)
    over, kind = lexical_index._postings(3.0, "bigint")
    got = docs.mapInArrow(over, kind).collect()
    assert {(r.term, e.key, e.tf, e.length) for r in got for e in r.entries} == {(t, i, n, 3) for i in range(30) for t, n in (("a", 2), (f"t{i % 2}", 1))}
    assert all(r.n == len(r.entries) and {e.key // 4 for e in r.entries} == {r.block} for r in got)
    assert all((r.most, r.least) == (max(e.tf for e in r.entries), 3) for r in got)


def test_rows_hold_many_postings_and_runs_are_sorted(spark, asked, tmp_path):
    """A term's row is for hundreds of documents, also where keys are texts; dead ones are found by block; words are taken apart in place."""
    docs = made(random.Random(11), range(3000))
    lexical_index.add_documents(frame(spark, docs), F.col("text"), str(tmp_path), words=T.legal_words)
    last = lexical_index.version(spark, str(tmp_path))
    postings = spark.read.parquet(f"{tmp_path}/segments/{last.segments[0]}/postings")
    n, total = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
    assert total == sum(len(set(text.split())) for _, text, _ in docs)
    assert n < total / 10
    for part in postings.select("term", "block").rdd.glom().collect():
        assert sorted(map(tuple, part)) == list(map(tuple, part))
    named = frame(spark, docs).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    path = str(tmp_path / "named")
    lexical_index.add_documents(named, F.col("text"), path, words=T.legal_words)
    lexical_index.delete_documents(named.filter("doc_id like '%7'"), path)
    assert rows(lexical_index.search(asked, ASKED(), path)) == whole(named.filter("doc_id not like '%7'"), asked, 10)
    last = lexical_index.version(spark, path)
    assert spark.read.parquet(f"{path}/dead/{last.dead[0]}").count() == 300
