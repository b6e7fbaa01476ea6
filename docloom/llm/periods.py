"""Periodic runs: stretches of words that repeat with some period several times over.

Every lag up to a text's words over the least exponent is scanned: a text's word ids are compared with themselves shifted
by the lag, and where they agree for long enough the true stretch, with the lag added, is a run. A stretch that counts is
longer than twice some block, so it covers one block of a fixed grid; the vectorised comparison of a lag begins at the
grid, and only where a block's probes agree is the stretch measured. A lag that is a multiple of a known run's period
agrees all along that run and gives it again, so such places are passed over. Together the lags of a text of n words
take about n log n comparisons.

Many texts are scanned at once, end to end with word ids of their own, so no stretch crosses from one to the next. The
lags of a long text are dealt out in ranges, each a row of its own, over the cluster; runs that several ranges find are
counted once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.runtime import slices, staged
from docloom.shipping import ship

#: Lags of a range at least; texts with fewer are scanned whole.
LAGS = 16_384
#: Ranges of a text at most: a longer text has longer ranges, since each one carries the text's word ids.
RANGES = 64
#: Texts and bytes that are scanned together.
TEXTS, BYTES = 4096, 4 << 20


def words(text: str) -> list[bytes]:
    """Words between the six ASCII white-space characters, as UTF-8."""
    return text.encode().split()


def word_ids(parts: Sequence[bytes], base: int = 0) -> np.ndarray:
    """Equal words have equal ids: ``base`` and the place of the first such word."""
    first: dict[bytes, int] = {}
    return np.fromiter(map(first.setdefault, parts, count(base)), np.int32, len(parts))


def _reach(a: np.ndarray, at: int, lag: int, end: int) -> tuple[int, int]:
    """The true stretch of ``a[i] == a[i + lag]`` around a place, within ``i + lag < end``; empty where it isn't true."""
    left, step = at, 64
    while left > 0:
        low = max(0, left - step)
        same = a[low:left] == a[low + lag : left + lag]
        if not same.all():
            left = low + int(np.flatnonzero(~same)[-1]) + 1
            break
        left, step = low, step * 4
    right, step, last = at, 64, end - lag
    while right < last:
        high = min(last, right + step)
        same = a[right:high] == a[right + lag : high + lag]
        if not same.all():
            right += int(np.flatnonzero(~same)[0])
            break
        right, step = high, step * 4
    return left, right


def _smallest(a: np.ndarray, start: int, end: int, period: int) -> int:
    """The smallest period of a stretch that has the given one at least twice: it divides that one."""
    small = [d for d in range(1, int(period**0.5) + 1) if period % d == 0]
    for d in sorted({*small, *(period // d for d in small)}):
        if a[start] == a[start + d] and a[end - 1 - d] == a[end - 1] and bool((a[start : end - d] == a[start + d : end]).all()):
            return d
    return period


def scan(a: np.ndarray, lags: range, least: int, exponent: int, active=None) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs that some lag of the range shows. ``active(lag)`` is how far the texts reach that
    are long enough for a lag; they stand first."""
    found: list[tuple[int, int, int]] = []
    known = np.zeros((0, 3), np.int64)
    for q in lags:
        m = len(a) if active is None else active(q)
        need = max(least, exponent * q) - q
        if m - q < need:
            break  # and so are all longer lags
        block = (need + 1) // 2
        n = (m - q) // block
        hits = np.flatnonzero(a[0 : n * block : block] == a[q : q + n * block : block]) * block
        for probe in (block - 1, block // 2, block // 4, 3 * block // 4):
            if not len(hits):
                break
            hits = hits[a[hits + probe] == a[hits + (probe + q)]]
        if not len(hits):
            continue
        if len(known) != len(found):
            known = np.array(found, np.int64)
            known = known[np.argsort(known[:, 0], kind="stable")]
        if len(known):
            same = known[(q % known[:, 2] == 0) & (known[:, 1] - known[:, 0] > q)]
            if len(same):
                # some such run begins at or before the place and goes on beyond it and the lag
                furthest = np.maximum.accumulate(same[:, 1])
                at = np.searchsorted(same[:, 0], hits, "right") - 1
                hits = hits[(at < 0) | (furthest[at] <= hits + q)]
        done = -1
        for x in hits.tolist():
            if x < done:
                continue
            left, done = _reach(a, x, q, m)
            if done - left >= need:
                found.append((left, done + q, q if lags.start == 1 else _smallest(a, left, done + q, q)))
    return found


def runs_of_texts(parts: Sequence[Sequence[bytes]], least: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, period), by start and period."""
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    sizes = np.array([len(parts[i]) for i in order], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    a = np.concatenate([word_ids(parts[i], int(s)) for i, s in zip(order, starts, strict=True)]) if len(parts) else np.zeros(0, np.int32)
    made: list[list[tuple[int, int, int]]] = [[] for _ in parts]
    longest = int(sizes[0]) if len(parts) else 0
    reach = np.concatenate(([0], ends))
    shorter = -sizes

    def active(q: int) -> int:
        return int(reach[np.searchsorted(shorter, -max(least, exponent * q), "right")])

    found = scan(a, range(1, longest // exponent + 1), least, exponent, active)
    at = np.searchsorted(starts, [s for s, _, _ in found], "right") - 1 if found else ()
    # empty texts stand last, so the last start at or before a run's is that of its text
    for k, (s, e, p) in zip(at, found, strict=True):
        made[order[k]].append((int(s - starts[k]), e - s, p))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in made]


def collapse(parts: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> str:
    """The words joined by spaces, of each run only its first period."""
    if not runs:
        return b" ".join(parts).decode()
    dropped = np.zeros(len(parts) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    return b" ".join([parts[i] for i in np.flatnonzero(np.cumsum(dropped)[:-1] == 0).tolist()]).decode()


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_KIND = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _columns(parts, runs) -> list[pa.Array]:
    return [
        pa.array([len(p) for p in parts], pa.int64()),
        pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], _RUNS),
        pa.array([collapse(p, r) for p, r in zip(parts, runs, strict=True)], pa.string()),
    ]


def periodic_runs(docs: DataFrame, least: int = 24, exponent: int = 3, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns of ``keep``, ``n_words``, ``runs`` (array of start, length, period, by start and period) and ``collapsed``.

    A run is a stretch of words with a smallest period q that is at least ``least`` words and ``exponent`` times q long and
    that no neighbouring word continues. ``collapsed`` is the text's words joined by one space without those that a run
    holds after its first q. ``exponent`` is a whole number of 2 or more. Null and empty texts have no words and no runs;
    repeated rows stay, null keys too; an empty table gives an empty one. Where names clash, those of the results win.
    """
    if exponent < 2 or least < 1:
        raise ValueError("exponent is 2 or more, least is 1 or more")
    ship(docs.sparkSession)
    keep = [c for c in keep if c not in ("n_words", "runs", "collapsed")]
    narrow = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    names = [*keep, "n_words", "runs", "collapsed"]
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]]
    fields = ", ".join([*kept, "n_words long", f"runs {_KIND}", "collapsed string"])
    # a word takes a byte and a space at least
    long = F.coalesce(F.octet_length("__text") > 2 * exponent * LAGS, F.lit(False))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in slices(batch.column(batch.num_columns - 1), TEXTS, BYTES):
                parts = [words(t) for t in part]
                rows = batch.slice(start, len(part))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *_columns(parts, runs_of_texts(parts, least, exponent))], names=names)

    short = narrow.filter(~long).mapInArrow(whole, fields)
    rest = staged(narrow.filter(long).withColumn("__row", F.monotonically_increasing_id()))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = word_ids(words(t.as_py()))
                most = len(ids) // exponent
                width = max(LAGS, -(-most // RANGES))
                for low in range(1, most + 1, width):
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([low], pa.int64()), pa.array([min(low + width, most + 1)], pa.int64()), pa.array([ids.tobytes()], pa.binary())], names=["row", "low", "high", "ids"])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, low, high, ids in zip(*(batch.column(i) for i in range(4)), strict=True):
                found = scan(np.frombuffer(ids.as_buffer(), np.int32), range(low.as_py(), high.as_py()), least, exponent)
                yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(found), pa.int64()), *(pa.array(c, pa.int64()) for c in ([s for s, _, _ in found], [e - s for s, e, _ in found], [p for _, _, p in found]))], names=["row", "start", "length", "period"])

    dealt = rest.select("__row", "__text").mapInArrow(ranges, "row long, low long, high long, ids binary").repartition("row", "low")
    found = dealt.mapInArrow(scanned, "row long, start long, length long, period long").groupBy("row", "start", "length").agg(F.min("period").alias("period"))
    listed = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("__found"))

    def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_columns - 2
            for i in range(batch.num_rows):
                parts = words(batch.column(k)[i].as_py())
                runs = [(r["start"], r["length"], r["period"]) for r in batch.column(k + 1)[i].as_py() or ()]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:-2], *_columns([parts], [runs])], names=names)

    met = rest.join(listed, F.col("__row") == F.col("row"), "left").select(*[F.col(f"`{c}`") for c in keep], "__text", "__found")
    return short.unionByName(met.mapInArrow(collapsed, fields))
