"""What is settled by rule: the last fraction of a mix, which of like rows stays, and how long staged tables live."""

import collections

import numpy as np
import pytest

from docloom.llm import mixing, quality, simhash
from docloom.llm.runtime import staged, staging


def test_a_long_document_is_made_up_for_by_short_ones(spark, docs):
    """Sources of one long document and many short ones end within half a short one."""
    rows = [(i, "w " * (3364 if i == 0 else 15 + 3 * (i % 40)), "en", "a", 1) for i in range(120)]
    rows += [(1000 + i, "w " * (5001 if i == 0 else 7), "en", "b", 1) for i in range(900)]
    rows += [(3000 + i, "w " * 11, "en", None, 1) for i in range(200)]
    got = mixing.mix(docs(rows)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs(rows[::-1]).repartition(5)).collect()))
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    for s, half in (("a", 7.5), ("b", 3.5), (None, 5.5)):
        assert abs(taken[s] - target[s]) <= half + 1e-6, s


@pytest.mark.parametrize("seed", range(30))
def test_correction_leaves_less_than_half_the_smallest(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.choice(np.arange(3, 90), 6, replace=False))
    miss = float(rng.integers(-900, 900)) + 0.25
    n = mixing.correction(miss, sizes, np.full(6, 1000))
    assert (n >= 0).all() and abs(abs(miss) - (n * sizes).sum()) <= sizes.min() / 2
    few = rng.integers(0, 3, 6)
    n = mixing.correction(miss, sizes, few)
    assert (n <= few).all() and abs(abs(miss) - (n * sizes).sum()) <= abs(miss)


def test_the_same_one_of_like_rows_stays(spark, docs):
    """Rows that agree in id and text, but not elsewhere, and null and empty texts."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, lang, "a", n) for lang in ("en", None, "de") for n in (3, 1, 2)] + [(2, "", "en", "a", 0), (2, None, "en", "a", 0)]
    for f in (simhash.representatives, mixing.materialise):
        results = [sorted(map(repr, f(docs(part).repartition(k)).collect())) for part, k in ((rows, 1), (rows[::-1], 3), (rows[4:] + rows[:4], 7))]
        assert results[0] == results[1] == results[2]
    kept = [tuple(r) for r in simhash.representatives(docs(rows)).collect()]
    assert sorted(kept) == [(1, text, "de", "a", 1), (2, "", "en", "a", 0)]
    assert {(r.lang, r.n_chars) for r in mixing.materialise(docs(rows)).collect()} == {("de", 1), ("en", 0)}


def test_results_outlive_the_staging_of_others(spark, docs, tmp_path):
    waiting = quality.filter_documents(docs())
    want = sorted(map(repr, quality.filter_documents(docs()).collect()))
    with staging(spark):
        inside = staged(docs())
        with staging(spark):
            quality.filter_documents(docs()).write.parquet(str(tmp_path / "done"))
        assert inside.count() == 10
    assert sorted(map(repr, waiting.collect())) == want
    with pytest.raises(Exception, match="(?i)not.*(exist|found)"):
        inside.collect()
    with pytest.raises(ZeroDivisionError), staging(spark):
        broken = staged(docs())
        1 / 0  # noqa: B018
    with pytest.raises(Exception, match="(?i)not.*(exist|found)"):
        broken.collect()
