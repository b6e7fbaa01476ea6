"""Sentencepiece by a chunk table, the Merkle manifest and periodic runs against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import bpe, merkle, periods, queries, sentencepieces

PIECE = bpe.vocabulary("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_text(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


ODD = ["a", "the", " ", "  ", "\n", "\t", "\r", "é", "▁", "中", "🎉", "\x00", "12", ".", "<s>", "<unk>", "<0x0A>", "x" * 300, "�", "\n\n", "\xa0", "ﬁ"]


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_chunks_equal_the_library(library):
    m = sentencepieces.model(PIECE)
    for t in odd_texts(2000):
        parts = m.segment(sentencepieces.chunks(t)) if t else []
        ids = np.concatenate(parts) if parts else np.array([], "<u4")
        assert ids.tolist() == library.encode(t)
        assert m.decode(ids) == library.decode(ids.tolist())
        assert m.decimals(ids).decode() == ",".join(map(str, ids.tolist()))


def test_decoding_of_any_ids(library):
    m, rnd = sentencepieces.model(PIECE), random.Random(2)
    some = [0, 1, 2, 3, 13, 0xE4 + 3, 0xB8 + 3, 0xAD + 3, 0xF0 + 3, 0x9F + 3, 0xC3 + 3, 259, 28705]
    for _ in range(2000):
        ids = np.array([rnd.choice([*some, rnd.randrange(32000)]) for _ in range(rnd.randint(0, 9))], "<u4")
        assert m.decode(ids) == library.decode(ids.tolist())


@pytest.mark.parametrize("limit", [128 << 20, 1500, 1], ids=["all at hand", "some joined", "all joined"])
def test_round_trip(spark, library, monkeypatch, limit):
    """Wherever the table's chunks come from, the ids are the library's."""
    monkeypatch.setattr(sentencepieces, "HEAD_BYTES", limit)
    monkeypatch.setattr(sentencepieces, "COUNTED", 50)
    texts = [*odd_texts(300, 3), None, "", "word " * 3000, "x" * 50_000, *["copies of one text"] * 40]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert by_text(sentencepieces.round_trip(docs, PIECE).collect()) == by_text(want)
    got = {(r.doc_id, tuple(r.ids), r.decoded) for r in sentencepieces.encode_texts(docs, PIECE).collect()}
    assert got == {(i, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t in rows}


def test_each_chunk_once(spark):
    table = sentencepieces.count_chunks(spark.createDataFrame([("b a b",), ("b\nb",), (None,)], "text string"))
    assert sorted((r.chunk, r.n) for r in table.collect()) == [("\n", 1), (" a", 1), (" b", 3), ("b", 1)]
    assert {r.chunk: r.ids for r in sentencepieces.segmented(table, PIECE).collect()}.keys() == {"\n", " a", " b", "b"}


def test_at_hand_by_hashes(library, monkeypatch):
    """Also where different chunks have one hash."""
    import pyarrow as pa

    names = [f" w{i}" for i in range(3000)]
    table = pa.table({"chunk": names, "n": list(range(3000)), "ids": pa.array([n.encode() for n in names], pa.binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        for batch in table.to_batches(100):
            out.write_batch(batch)
    monkeypatch.setattr(sentencepieces, "FIRST", 50)
    for same in (hash, lambda name: int(name[2:]) % 7):
        monkeypatch.setattr(sentencepieces, "hash", same, raising=False)
        known = sentencepieces._AtHand(sink.getvalue().to_pybytes())
        assert len(known.first) == 100
        assert known.others([" w7", " w2999", " w3000", " w100"]) == [None, b" w2999", None, b" w100"]


# --- manifest


def plain_leaf(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def plain_manifest(rows):
    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([sha("".join(below[i : i + 3])) for i in range(0, len(below), 3)])
        return levels

    def path(levels, i):
        found = []
        for below in levels[:-1]:
            first = i - i % 3
            found.append((below[first:i], below[i + 1 : first + 3]))
            i //= 3
        return found

    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    trees = []
    for k in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(groups[k], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r, r[1])))
        trees.append((own, up([plain_leaf(r, r[1]) for r in own])))
    top = up([levels[-1][0] for _, levels in trees])
    out = []
    for g, (own, levels) in enumerate(trees):
        for i, r in enumerate(own):
            whole, now = path(levels, i) + path(top, g), r[1]
            if now is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                now = now.replace("\n", "")
            folded = plain_leaf(r, now)
            for before, after in whole:
                folded = sha("".join([*before, folded, *after]))
            proof = sha("".join(x for before, after in whole for x in [*before, *after]))
            out.append((r[0], levels[0][i], levels[-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


def tampered():
    return "text", F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")


@pytest.mark.parametrize(("n", "sources", "levels"), [(1, 1, 6), (10, 1, 1), (200, 13, 1), (300, 2, 2), (800, 3, 6)])
def test_manifest_by_brute_force(spark, n, sources, levels):
    rnd = random.Random(n)
    names = [None, *(f"s{j}é" for j in range(sources))]
    rows = [(i if rnd.random() < 0.95 else None, rnd.choice([None, "", "a\nb", "x" * rnd.randint(0, 9)]), rnd.choice([None, "en"]), rnd.choice(names), rnd.choice([None, 4])) for i in range(n)]
    rows += rows[:3]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), tampered=tampered(), levels=levels)
    assert by_text(got.collect()) == by_text(plain_manifest(rows))


def test_manifest_of_an_untouched_table(spark, sf):
    got = merkle.manifest(spark.read.parquet(f"{sf}/documents.parquet"))
    assert got.filter("verified").count() == got.count() == 200
    assert got.select("root").distinct().count() == 1


def test_manifest_finds_what_changed(spark, sf):
    """Just the rows whose text has lost a line feed fail."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert by_text(queries.op12_merkle_manifest(spark, sf).collect()) == by_text(plain_manifest(rows))


# --- runs


def plain_runs(words, least, exponent):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, exponent * q):
                found.setdefault((start, i - start + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rnd):
    letters = rnd.choice([1, 2, 3, 10])
    words = [b"%d" % rnd.randrange(letters) for _ in range(rnd.randint(0, 50))]
    for _ in range(rnd.randint(0, 4)):
        unit = [b"%d" % rnd.randrange(letters) for _ in range(rnd.randint(1, 12))]
        words += unit * rnd.randint(1, 8) + unit[: rnd.randint(0, len(unit))]
    return words


@pytest.mark.parametrize(("least", "exponent"), [(24, 3), (6, 2), (1, 2), (10, 4)])
def test_runs_by_brute_force(least, exponent):
    rnd = random.Random(least)
    for _ in range(200):
        batch = [repetitive(rnd) for _ in range(rnd.randint(0, 6))]
        want = [plain_runs(w, least, exponent) for w in batch]
        assert periods.runs_of_texts(batch, least, exponent) == want
        for words, runs in zip(batch, want, strict=True):
            ids, found, width = periods.word_ids(words), set(), rnd.randint(1, 9)
            for low in range(1, len(words) // exponent + 1, width):
                found |= {(s, e - s, q) for s, e, q in periods.scan(ids, range(low, min(low + width, len(words) // exponent + 1)), least, exponent)}
            assert found == set(runs)


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w.decode() for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("lags", [16_384, 5], ids=["whole", "ranges"])
def test_periodic_runs(spark, monkeypatch, lags):
    """The same runs and texts whether a text's lags are scanned together or in ranges."""
    monkeypatch.setattr(periods, "LAGS", lags)
    rnd = random.Random(9)
    texts = [None, "", " \n", "one", *(b" ".join(repetitive(rnd)).decode() for _ in range(80)), "a b c\x0b\x0c\r" * 40, "é\xa0ü  " * 30, "x " * 30_000]
    texts += texts[-2:]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)]
    got = periods.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        runs = plain_runs(words, 24, 3) if len(words) < 10_000 else [(0, 30_000, 1)]
        want.append((i, len(words), runs, plain_collapse(words, runs)))
    assert by_text((r.doc_id, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in got) == by_text(want)


def test_periodic_runs_query(spark, sf):
    """The query of the contract, with its planted repeats, on every document."""
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = (r.text or "").encode().split()
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = periods.runs_of_texts([words], 24, 3)[0]
        if n < 600:
            assert runs == plain_runs(words, 24, 3)
        top = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        want.append((r.doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(plain_collapse(words, runs))))
    got = queries.op13_periodic_runs(spark, sf).collect()
    assert sum(r.n_runs for r in got) > 0
    assert by_text(got) == by_text(want)


def test_long_texts_take_near_linear_time():
    import time

    began = time.process_time()
    rnd = random.Random(1)
    assert periods.runs_of_texts([[b"x"] * 100_000], 24, 3) == [[(0, 100_000, 1)]]
    unit = [b"%d" % rnd.randrange(5000) for _ in range(20_000)]
    assert periods.runs_of_texts([unit * 5], 24, 3) == [[(0, 100_000, 20_000)]]
    assert time.process_time() - began < 30
