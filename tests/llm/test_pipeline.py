"""The pipeline stage by stage against plain versions, on the smallest tables."""

import collections
import hashlib

import numpy as np
import pytest

import corpus_pipeline
from docloom.llm import bpe, mixing, quality, simhash
from test_methods import plain_spans


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
        if name != "bpe":
            assert docs.columns == out["input"].columns
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_stage(tables):
    kept = {r.doc_id for r in quality.apply_rules(tables["input"]).filter("kept").collect()}
    before, after = rows(tables["input"]), rows(tables["quality"])
    assert set(after) == kept and all(after[i] == before[i] for i in after)


def test_near_duplicate_stage(tables):
    """One document of each chain of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    before, after = rows(tables["quality"]), rows(tables["near_duplicates"])
    ids = sorted(before)
    sets = {i: set(simhash.shingle_hashes(before[i].text, 5).tolist()) for i in ids}
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if 1000 * both >= 800 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert set(after) == {find(i) for i in ids}
    assert all(after[i] == before[i] for i in after)


def test_personal_data_stage(tables):
    before, after = rows(tables["near_duplicates"]), rows(tables["pii"])
    assert set(before) == set(after)
    for i, r in after.items():
        assert not plain_spans(r.text) and r.n_chars == len(r.text)
        if not plain_spans(before[i].text):
            assert r.text == before[i].text


def test_mix_stage(tables):
    before, after = rows(tables["pii"]), tables["mix"].collect()
    words = lambda t: len(t.split())
    size, taken = collections.Counter(), collections.Counter()
    for r in before.values():
        size[r.source] += words(r.text)
    for r in after:
        taken[r.source] += words(r.text)
        assert r == before[r.doc_id]
    largest = {s: max(words(r.text) for r in before.values() if r.source == s) for s in size}
    share = {s: 1 + i % 3 for i, s in enumerate(sorted(size))}
    assert max(collections.Counter(r.doc_id for r in after).values()) <= mixing.CAP
    level = sum(size.values()) / sum(share.values())
    if all(level * share[s] <= 3 * size[s] for s in size):
        assert all(abs(taken[s] - level * share[s]) <= largest[s] / 2 + 1 for s in size)


def test_token_stage(tables):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary("byte_bpe_50k.json"))
    text = {r.doc_id: r.text for r in tables["mix"].collect()}
    got = tables["bpe"].collect()
    assert len(got) == tables["mix"].count()
    for r in got:
        ids = t.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_run_gives_the_same(spark, sf, tables):
    assert sorted(corpus_pipeline.run(spark, sf).collect()) == sorted(tables["bpe"].collect())
