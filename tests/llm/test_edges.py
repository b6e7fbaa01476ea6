"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

from docloom.llm import bpe, licenses, media, merkle, mixing, periods, pii, quality, sentencepieces, simhash, tokencount, toxicity, urls

BYTE = bpe.vocabulary("byte_bpe_50k.json")
PIECE = bpe.vocabulary("piece_bpe_32k.model")


def labels(spark, docs):
    return spark.createDataFrame([(1, 1), (5, 0), (6, 0), (None, 1), (7, None)], "doc_id long, toxic int")


OPERATORS = {
    "mix": lambda s, d: mixing.mix(d),
    "bpe": lambda s, d: bpe.round_trip(d, BYTE),
    "bpe ids": lambda s, d: bpe.encode_texts(d, BYTE),
    "pii": lambda s, d: pii.extract(d),
    "redact": lambda s, d: pii.redact(d),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.fit(d, labels(s, d))),
    "media": lambda s, d: media.text_media_digests(d),
    "licenses": lambda s, d: licenses.scan(d),
    "tokens": lambda s, d: tokencount.count_tokens(d, PIECE),
    "urls": lambda s, d: urls.filter_urls(d, url="text", keep=("doc_id",)),
    "quality": lambda s, d: quality.apply_rules(d),
    "simhash": lambda s, d: simhash.group(d, 4, 4),
    "pieces": lambda s, d: sentencepieces.round_trip(d, PIECE),
    "piece ids": lambda s, d: sentencepieces.encode_texts(d, PIECE),
    "manifest": lambda s, d: merkle.manifest(d),
    "runs": lambda s, d: periods.periodic_runs(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, docs, name):
    assert OPERATORS[name](spark, docs()).count() == 10


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, docs, name):
    assert OPERATORS[name](spark, docs([])).count() == 0


#: Names that operators use for their results or inside.
CLASHES = ("size", "target", "copies", "score", "n_words", "kept", "fp", "root", "spans", "candidates", "start", "belief", "n", "host", "__key", "__row")


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, docs, name):
    d = docs([(i, f"text number {i} of several words here", "en", "a", 1) for i in range(5)])
    wide = d.select("*", *[F.lit("mine").alias(c) for c in CLASHES])
    assert OPERATORS[name](spark, wide).count() == 5


FILTERS = {"quality": quality.filter_documents, "near duplicates": simhash.representatives, "redact": pii.redact, "mix": mixing.materialise}
#: Names that the filters use inside, a dotted one, and one that differs in case only.
INSIDE = (
    "__key", "__id", "__h", "__copies", "__copy", "__spans", "__row", "__at", "__text", "__d0", "__m", "__total", "__src", "__part", "__words", "__hash",
    "further", "spans_email", "candidates", "node", "root", "fp", "n_words", "kept", "base_failed", "size", "copies", "a.b", "TEXT",
)


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_values(spark, docs, name):
    text = "Write to anna.lee@mail.example.com or 10.0.0.1 about the {0}th of these several rather different words, and " + " ".join(f"{{0}}w{i}" for i in range(60))
    plain = docs([(i, text.format(i), "en", "a", i) for i in range(12)] + [(99, None, "en", "a", None)])
    names = plain.columns
    wide = plain.toDF(*names).select("*", *[F.lit(f"mine {c}").alias(f"x{i}") for i, c in enumerate(INSIDE)])
    wide = wide.toDF(*names, *INSIDE)
    want = sorted(tuple(map(str, r)) for r in FILTERS[name](plain).collect())
    out = FILTERS[name](wide)
    assert out.columns == wide.columns
    got = out.collect()
    assert want and sorted(tuple(map(str, r[: len(names)])) for r in got) == want
    assert all(tuple(r[len(names) :]) == tuple(f"mine {c}" for c in INSIDE) for r in got)


def test_filters_keep_columns(spark, docs):
    d = docs()
    assert quality.filter_documents(d).columns == d.columns
    assert simhash.representatives(d).columns == d.columns
    assert pii.redact(d).columns == d.columns
    assert mixing.materialise(d).columns == d.columns


def test_filters_on_empty_tables(spark, docs):
    for f in (quality.filter_documents, simhash.representatives, pii.redact, mixing.materialise):
        assert f(docs([])).count() == 0


def test_defined_results(spark, docs):
    rows = {r.doc_id: r for r in bpe.round_trip(docs(), BYTE).collect()}
    assert rows[2].n_tokens == rows[3].n_tokens == rows[8].n_tokens == 0
    assert {r.fp for r in simhash.group(docs(), 4, 4).filter("doc_id in (2, 3, 4, 8)").collect()} == {0}
    taken = {r.doc_id: r.taken for r in mixing.mix(docs()).filter("doc_id in (2, 3, 4, 8)").collect()}
    assert set(taken.values()) == {0}
    assert media.text_media_digests(docs()).filter("doc_id = 2").first().payload_bytes == 192
    assert quality.apply_rules(docs()).filter("doc_id = 3").first().n_words == 0
    kept = simhash.representatives(docs())
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 5, 6, 7]


def by_id(rows):
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
    return found


def test_toxicity_of_awkward_rows(spark, docs):
    """Every score is the sigmoid of the bias and the weights of the distinct words, which are none for null and empty texts."""
    import math

    some = docs([(i, f"some plain words {i} here", "en", "a", 1) for i in range(40)] + [(100 + i, f"awful nasty {i}", "en", "a", 1) for i in range(12)])
    model = toxicity.fit(some, spark.createDataFrame([(100 + i, 1) for i in range(12)], "doc_id long, toxic int"))
    weight = model.table()
    rows = docs().union(docs([(200, "awful nasty words", "en", "a", 1), (200, "awful nasty words", "en", "a", 1), (201, "y" * 1_000_000, "en", "a", 1)]))
    texts = {(r.doc_id, r.text) for r in rows.collect()}
    want = sorted((str(i), round(1 / (1 + math.exp(-(model.bias + sum(weight[h] for h in set(toxicity.word_hashes(t or "")) if h in weight)))), 9)) for i, t in texts)
    got = [(str(r.doc_id), round(r.score, 9)) for r in toxicity.score(rows, model).collect()]
    assert sorted(set(got)) == sorted(set(want)) and len(got) == 13
    of = by_id(toxicity.score(rows, model).collect())
    assert {r.score for i in (2, 3, 8) for r in of[i]} == {of[4][0].score}
    assert of[200][0] == of[200][1] and all(r.predicted == int(r.score >= 0.5) for x in of.values() for r in x)


def test_licences_of_awkward_rows(spark, docs):
    rows = docs([(1, None, "en", "a", 1), (2, "", "en", "a", 1), (3, "All rights\nRESERVED. all rights reserved", "en", "a", 1), (3, "All rights\nRESERVED. all rights reserved", "en", "a", 1), (None, "cc by and GENERAL public license", None, None, None), (4, "x" * 1_000_000, "en", "a", 1), (5, "ccby all-rights-reserved", "en", "a", 1)])
    of = by_id(licenses.scan(rows).collect())
    for i in (1, 2):
        assert of[i][0][1:8] == (0, 0, None, None, "", "", 0.0)
    assert len(of[3]) == 2 and of[3][0] == of[3][1] and of[3][0][1:6] == (6, 2, 0, 3, "reserved")
    assert of[None][0][1:6] == (6, 2, 0, 3, "cc-by,gpl") and of[None][0].score == 1.0
    assert of[4][0][1:8] == (1, 0, None, None, "", "", 0.0)
    assert of[5][0][1:6] == (4, 1, 1, 1, "reserved")


def test_token_counts_of_awkward_rows(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = docs().union(docs([(9, "z" * 1_000_000, "en", "a", 1), (10, " " * 5000, "en", "a", 1), (10, " " * 5000, "en", "a", 1)]))
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(library.encode(r.text or "")), len(library.encode(r.text or "")) > 4096) for r in rows.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(rows, PIECE).collect()) == want


def test_urls_of_awkward_rows(spark):
    long = "http://a.org/" + "a" * 1_000_000
    rows = [(1, None), (2, ""), (None, "HTTP://Sub.Example.COM/de/x?y"), (3, "http://example.net/en/"), (3, "http://example.net/en/"), (4, long), (5, "://"), (6, "http:///x")]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    of = {(r.page_id, len(r.path)): r[1:5] for r in got}
    assert len(got) == 8
    assert of[1, 0] == of[2, 0] == of[5, 0] == ("", "", None, "allow")
    assert of[None, 5] == ("sub.example.com", "/de/x", "example.com/de/", "block")
    assert of[3, 4] == ("example.net", "/en/", "example.net/en/", "allow")
    assert of[4, 1_000_001] == ("a.org", long[12:], None, "allow") and of[6, 2] == ("", "/x", None, "allow")


def test_spans_of_awkward_rows(spark, docs):
    """Null and empty texts have no spans, equal rows equal ones, and a text of one long word is read to its end."""
    text = "mail a.b@c.org or 10.0.0.1"
    rows = docs([(1, None, "en", "a", 1), (2, "", "en", "a", 1), (3, text, "en", "a", 1), (3, text, "en", "a", 1), (None, text, None, None, None), (4, "x" * 200_000 + " a@b.cc", "en", "a", 1)])
    of = by_id(pii.extract(rows).collect())
    assert of[1][0].spans == of[2][0].spans == "" and of[1][0].n_email == 0
    assert of[3][0] == of[3][1] and of[3][0][1:6] == of[None][0][1:6] and (of[3][0].n_email, of[3][0].n_ip) == (1, 1)
    assert of[4][0].n_email == 1 and "email:200001:200007" in of[4][0].spans
