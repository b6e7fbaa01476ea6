"""One pass over the texts for any number of strings."""

import random

import pytest

from docloom.operators import patterns


def frames(spark, texts, strings):
    return spark.createDataFrame(texts, "doc_id int, text string").repartition(3), spark.createDataFrame([(s,) for s in strings], "pattern string")


def made(seed):
    rng = random.Random(seed)
    letters = "aab é🎉\n."
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(120)] + [(500, None), (None, "aab"), (501, ""), (502, "aa" * 500), (502, "aa" * 500)]
    strings = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(80)} | {"aa", "aaa"}
    return texts, sorted(strings)


@pytest.mark.parametrize("most", [2_000_000, 40, 1])
def test_by_plain_search(spark, monkeypatch, most):
    """Alike for strings in one automaton and in many parts."""
    monkeypatch.setattr(patterns, "MOST", most)
    texts, strings = made(1)
    strings = strings[: 12 if most == 1 else None]
    a, b = frames(spark, texts, [*strings, strings[0], None, ""])
    want = [(i, s, t.count(s)) for i, t in texts if t for s in strings if s in t]
    order = lambda rows: sorted(map(str, map(tuple, rows)))
    assert order(patterns.find_patterns(a, b, hits=True).collect()) == order(want)
    assert order(patterns.find_patterns(a, b).collect()) == order([(i, s) for i, s, _ in want])


def test_nothing(spark):
    a, b = frames(spark, [(1, "abc"), (2, None)], [None, ""])
    assert patterns.find_patterns(a, b).count() == 0
    assert patterns.find_patterns(a.limit(0), frames(spark, [], ["a"])[1]).count() == 0
    assert patterns.find_patterns(a, b.limit(0), hits=True).columns == ["doc_id", "pattern", "hits"]


def test_cost_does_not_follow_the_number_of_strings():
    """Time within an automaton of 10 and of 10,000 strings over the same text."""
    import time

    rng = random.Random(4)
    text = " ".join("%05d" % rng.randrange(100_000) for _ in range(200_000))

    class Sent:
        def __init__(self, value):
            self.value = value

    def seconds(n):
        import pyarrow as pa

        strings = [f"no{i:06d}" for i in range(n - 1)] + ["00001 0"]
        over = patterns._matches(Sent(strings), "doc_id", False)
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["key", "__text"])
        list(over(iter([batch])))  # builds it
        began = time.process_time()
        for _ in range(5):
            list(over(iter([batch])))
        return time.process_time() - began

    assert seconds(10_000) < 4 * seconds(10) + 0.5
