"""Many strings searched for in one pass over each text.

All strings go into one automaton, so a text costs its own length and its matches, however many strings there are. Their
characters are counted first: a set within ``MOST`` is sent to the workers as it is, a larger one in parts of that size,
by a hash of the strings, and the texts are read once for each part. Texts stay where they are; only keys and strings go on.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.shipping import ship

#: Characters of the strings of one automaton.
MOST = 2_000_000
#: Matches that a task hands on at a time.
HANDED = 50_000

_AT_HAND: dict = {}


def _automaton(name: str, sent):
    """The automaton of a worker; the last one stays for its next tasks."""
    if name not in _AT_HAND:
        import ahocorasick

        _AT_HAND.clear()
        made = ahocorasick.Automaton()
        for i, p in enumerate(sent.value):
            made.add_word(p, i)
        if len(made):
            made.make_automaton()
        _AT_HAND[name] = made
    return _AT_HAND[name]


def find_patterns(texts: DataFrame, patterns: DataFrame, text: str = "text", pattern: str = "pattern", key: str = "doc_id", hits: bool = False) -> DataFrame:
    """(key, pattern) for each text and each string that occurs in it; with ``hits`` also how often, without overlaps.

    Case counts. Equal strings are one; null and empty ones are in no text, and null texts hold none. Repeated rows of texts
    have their matches each.
    """
    spark = texts.sparkSession
    ship(spark)
    wanted = patterns.select(F.col(pattern).alias("pattern")).filter(F.length("pattern") > 0).distinct()
    size = wanted.agg(F.sum(F.length("pattern"))).first()[0] or 0
    parts = -(-size // MOST)
    narrow = texts.select(F.col(key).alias("key"), F.col(text).alias("__text")).filter("__text is not null")
    kind = f"`{key}` {texts.schema[key].dataType.simpleString()}, pattern string" + (", hits long" if hits else "")
    found = spark.createDataFrame([], kind)
    for part in range(parts):
        some = wanted if parts == 1 else wanted.filter(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part)
        strings = sorted(r.pattern for r in some.collect())  # about ``MOST`` characters
        rows = narrow.mapInArrow(_matches(spark.sparkContext.broadcast(strings), key, hits), kind)
        found = rows if parts == 1 else found.unionByName(rows)
    return found


def _matches(sent, key: str, hits: bool):
    name = uuid.uuid4().hex

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, names = _automaton(name, sent), sent.value
        search = found.iter if len(found) else lambda text: ()
        sizes = [len(p) for p in names]
        rows: list[int] = []
        which: list[int] = []
        often: list[int] = []

        def handed(keys: pa.Array) -> pa.RecordBatch:
            columns = [keys.take(pa.array(rows, pa.int64())), pa.array([names[i] for i in which], pa.string())]
            made = pa.RecordBatch.from_arrays([*columns, pa.array(often, pa.int64())] if hits else columns, names=[key, "pattern", "hits"] if hits else [key, "pattern"])
            for held in (rows, which, often):
                held.clear()
            return made

        for batch in batches:
            for at, t in enumerate(batch.column(1)):
                if hits:
                    n: dict[int, int] = {}
                    free: dict[int, int] = {}
                    for end, i in search(t.as_py()):
                        if end + 1 - sizes[i] >= free.get(i, 0):
                            n[i] = n.get(i, 0) + 1
                            free[i] = end + 1
                    which += n
                    often += n.values()
                else:
                    which += {i for _, i in search(t.as_py())}
                rows += [at] * (len(which) - len(rows))
                if len(rows) >= HANDED:
                    yield handed(batch.column(0))
            if rows:
                yield handed(batch.column(0))

    return over
