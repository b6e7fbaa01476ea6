"""SimHash near-duplicates, found by the generalised pigeonhole principle.

Fingerprints of 64 bits that differ in few bits must agree well in at least one group of bits. Correlated bits are
grouped into partitions; each partition gets a threshold of its own, and if the thresholds, each plus one, add up to the
distance plus one, no pair is missed. A dynamic program over estimated candidates chooses the thresholds, for each number
of partitions. Each fingerprint is filed under the values of a partition that are half the threshold away, so that two
within the threshold meet, and every candidate is verified on the whole fingerprint.

For a similarity of shingle sets a fingerprint goes on over further words of 64 bits. The distance that a similarity of
0.8 allows is too wide for a sum of thresholds to be of use, so the dynamic program spends thresholds, over several
partitionings of all bits, until a pair of that similarity meets with a stated probability; partitions become wider as
the number of texts grows, so candidates stay few. What decides on candidates is the exact similarity of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.runtime import cut, inner, map_texts, one_of, outer, ship, staged

BITS = 64
#: Fingerprints of one block of a large bucket.
BLOCK = 32_768
#: Rows of a bucket up to which all its pairs are compared at once; a larger one is searched breadth first.
SMALL = 256
#: Estimated cost of a filed row, against that of a verified candidate, of one word and of several.
ROW_COST, WIDE_ROW_COST = 1500.0, 200.0
#: Most partitions that are tried, and most flipped bits under which a fingerprint is filed.
PARTITIONS, FLIPS = 8, 2
#: A pair whose fingerprints lie one standard error further apart than its similarity makes expect meets with this
#: probability; candidates may lie so many standard errors further apart, in the first word and in all.
RECALL, ERRORS, FIRST_ERRORS = 0.95, 2.5, 4
#: Words of the finer fingerprints that choose the candidates of dense groups; shingle sets that are compared with one at a time.
FINE, COMPARED = 64, 1024
#: Bits of a partition of a fingerprint of several words, and steps in which probabilities are added up.
WIDTHS, STEPS = range(5, 33), 256
#: Texts that have links are found by a broadcast of their keys, up to so many; so many links are joined by one task.
FEW_LINKED, FEW_LINKS = 1_000_000, 1_000_000
#: The finaliser of splitmix64 and its step; they make further hashes of one.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)


def shingle_hashes(text: str, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats included; fewer words make one run, none make none."""
    words = text.encode().lower().split()  # of bytes: only A-Z change, only ASCII white space parts
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(line, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    return np.array([h(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Each bit is 1 if it is set in over half of the hashes; 0 without any."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 255 << 8):
        bits = np.unpackbits(hashes[at : at + (255 << 8)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        # eight bits, a byte each, are added up as one number, at most 255 times
        sums = np.add.reduceat(bits.view(np.uint64), np.arange(0, len(bits), 255), axis=0)
        ones += sums.view(np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def remix(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each hash."""
    with np.errstate(over="ignore"):
        z = hashes + np.uint64(k * MIX[2] & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX[0])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX[1])
    return z ^ (z >> np.uint64(31))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def word_columns(words: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, words))]


def fingerprints(docs: DataFrame, width: int = 5, text: str = "text", keep=("doc_id",), words: int = 1) -> DataFrame:
    """Columns of ``keep`` and ``fp``, the fingerprint as a signed 64-bit integer, with ``fp1``.. for further words.

    Null texts count as empty: 0.
    """

    def run(texts):
        hashes = [shingle_hashes(t, width) for t in texts]
        return [[_signed(simhash(remix(h, k) if k else h)) for h in hashes] for k in range(words)]

    return map_texts(docs, lambda: run, [(c, "long") for c in word_columns(words)], text, keep)


def most_bits(similarity: float, words: int, errors: float = 1) -> int:
    """Bits that sets of shingles of a Jaccard similarity differ in, with some standard errors above what is expected."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(BITS * words * share + errors * np.sqrt(BITS * words * share * (1 - share)))


def bit_counts(distinct: DataFrame, words: int = 1) -> np.ndarray:
    """How often two bits are set together, over all fingerprints: a matrix, summed up in Spark."""
    size = BITS * words

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            bits = np.concatenate([_bits(c.to_numpy()) for c in batch.columns], axis=1).astype(np.float32)
            total += bits.T @ bits
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((i * size + j).astype(np.int64)), pa.array(total[i, j].astype(np.int64))], names=["cell", "n"])

    out = np.zeros(size * size)
    cells = distinct.select(*word_columns(words)).mapInArrow(over, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for cell, n in cells.collect():  # at most a row for each pair of bits: 4,096, or 65,536 for four words
        out[cell] = n
    return out.reshape(size, size)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def correlations(counts: np.ndarray, n: int) -> np.ndarray:
    p = np.diag(counts) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    found = np.abs(counts / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(found, 0)
    return found


def group_bits(near: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to partitions of about equal width, each next bit the one nearest to its partition."""
    size = len(near)
    free, groups = np.ones(size, bool), []
    for k in range(parts):
        width = size // parts + (k < size % parts)
        group = [int(np.argmax(np.where(free, near @ free, -np.inf)))]
        free[group[0]] = False
        sums = near[:, group[0]].copy()
        while len(group) < width:
            best = int(np.argmax(np.where(free, sums, -np.inf)))
            group.append(best)
            free[best] = False
            sums += near[:, best]
        groups.append(sorted(group))
    return groups


def estimate(p: np.ndarray, group: list[int], n: int, flips: int) -> float:
    """Expected times that two fingerprints meet in a partition, from the bits' frequencies.

    Filed under all values within one flip, two that agree meet at every value, two within two bits at two of them.
    """
    distance = np.zeros(2 * flips + 1)
    distance[0] = 1
    for b in group:
        differ = 2 * p[b] * (1 - p[b])
        distance[1:] = distance[1:] * (1 - differ) + distance[:-1] * differ
        distance[0] *= 1 - differ
    w = len(group)
    meet = [sum(comb(d, i) * comb(w - d, j) for i in range(d + 1) for j in range(flips + 1) if max(i, d - i) + j <= flips) for d in range(2 * flips + 1)]
    return float((distance * meet).sum() * n * n / 2)


def allot(counts: np.ndarray, n: int, distance: int) -> tuple[float, list[tuple[list[int], int]]]:
    """The partitions and the flips that each is filed under, of least estimated cost.

    Flips of k hold a threshold of 2k. For each number of partitions a dynamic program goes over the partitions and the
    sum of thresholds, each plus one, so far; a partition may be left out.
    """
    p, near = np.diag(counts) / max(n, 1), correlations(counts, n)
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for parts in range(2, PARTITIONS + 1):
        groups = group_bits(near, parts)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g in groups:
            after: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in table.items():
                for flips in range(-1, FLIPS + 1):
                    reached = min(distance + 1, used + 2 * flips + 1) if flips >= 0 else used
                    filed = sum(comb(len(g), k) for k in range(flips + 1))
                    total = cost + (estimate(p, g, n, flips) + ROW_COST * n * filed if flips >= 0 else 0.0)
                    if reached not in after or total < after[reached][0]:
                        after[reached] = total, [*chosen, flips]
            table = after
        if distance + 1 in table and table[distance + 1][0] < best[0]:
            cost, chosen = table[distance + 1]
            best = cost, [(g, flips) for g, flips in zip(groups, chosen, strict=True) if flips >= 0]
    return best


def meets(bits: int, differ: int, width: int, threshold: int) -> float:
    """Probability that of two fingerprints of so many bits, of which some differ, a partition holds at most ``threshold`` of these."""
    return sum(comb(differ, k) * comb(bits - differ, width - k) for k in range(threshold + 1) if k <= width) / comb(bits, width)


def allot_probable(counts: np.ndarray, n: int, differ: int, recall: float) -> tuple[float, list[tuple[list[int], int]]]:
    """As ``allot``, for pairs that differ in so many bits and are to meet with a probability of ``recall``.

    All bits are partitioned again and again, each time with bits together that were not before. The dynamic program
    goes over these partitions and the probability so far, in steps of logarithms; a partition may be left out, get a
    threshold of 0, or be filed under one flip for a threshold of 2.
    """
    size = len(counts)
    p, near = np.diag(counts) / max(n, 1), correlations(counts, n)
    wanted = -log(1 - recall)
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for width in WIDTHS:
        gain = -log(1 - meets(size, differ, width, 0))
        tables = int(wanted / gain) + 1
        if WIDE_ROW_COST * n * tables >= best[0]:
            break  # wider ones need still more rows
        together, groups = np.zeros_like(near), []
        while len(groups) < tables:
            for g in group_bits(near - together, size // width):
                groups.append(g)
                together[np.ix_(g, g)] += 1
        value, cost = np.full((len(groups) + 1, STEPS + 1), np.inf), np.zeros(STEPS + 1, int)
        value[0, 0] = 0
        choice = np.full((len(groups) + 1, STEPS + 1), -1)
        for i, g in enumerate(groups):
            value[i + 1] = value[i]
            for flips in (0, 1):
                step = int(STEPS * -log(max(1 - meets(size, differ, len(g), 2 * flips), 1e-12)) / wanted)
                price = estimate(p, g, n, flips) + WIDE_ROW_COST * n * (1 + flips * len(g))
                for used in np.flatnonzero(np.isfinite(value[i])):
                    reached = min(STEPS, used + step)
                    if value[i, used] + price < value[i + 1, reached]:
                        value[i + 1, reached], choice[i + 1, reached] = value[i, used] + price, used * 2 + flips
        if value[-1, STEPS] < best[0]:
            at, plan = STEPS, []
            for i in range(len(groups), 0, -1):
                if choice[i, at] >= 0 and value[i, at] < value[i - 1, at]:
                    plan.append((groups[i - 1], int(choice[i, at] % 2)))
                    at = int(choice[i, at] // 2)
            best = float(value[-1, STEPS]), plan[::-1]
    return best


def _file(plan: list[tuple[list[int], int]], words: int, columns: list[str]):
    """A row for each fingerprint and value of each partition that it is filed under. ``columns`` begin with the words."""
    bit = [np.uint64(1 << (BITS - 1 - b)) for b in range(BITS)]
    zero = np.uint64(0)

    def mask(bits) -> list[np.uint64]:
        return [np.bitwise_or.reduce([zero, *(bit[b % BITS] for b in bits if b // BITS == k)]) for k in range(words)]

    masks = [mask(group) for group, _ in plan]
    flips = [[mask(some) for k in range(most + 1) for some in combinations(group, k)] for group, most in plan]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [batch.column(k).to_numpy().view(np.uint64) for k in range(words)]
            for k, own in enumerate(masks):
                part = pa.array(np.full(len(fps[0]), k, np.int32))
                for flip in flips[k]:
                    if words == 1:
                        value = (fps[0] ^ flip[0]) & own[0]
                    else:  # the bits of several words, as one hash
                        value = np.bitwise_xor.reduce([remix((f ^ x) & m, i + 1) for i, (f, x, m) in enumerate(zip(fps, flip, own, strict=True)) if m])
                    yield pa.RecordBatch.from_arrays([part, pa.array(value.view(np.int64)), *batch.columns], names=["part", "value", *columns])

    return over


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star from the least member of each connected class to its others."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        after = root.copy()
        np.minimum.at(after, root[x], low)
        np.minimum.at(after, root[y], low)
        while True:
            jumped = after[after]
            if (jumped == after).all():
                break
            after = jumped
        if (after == root).all():
            break
        root = after
    others = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[others], nodes[root[others]]


def _spanning(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the links of a forest that connects what the links do, nearest links first."""
    order = np.lexsort((b, a, d))
    nodes, ends = np.unique(np.concatenate((a[order], b[order])), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root, taken, open_ = np.arange(len(nodes)), [], np.arange(len(order))
    while True:
        open_ = open_[root[x[open_]] != root[y[open_]]]
        if not len(open_):
            break
        first = np.full(len(nodes), len(order))  # the first link, by distance, that leaves each class
        np.minimum.at(first, root[x[open_]], open_)
        np.minimum.at(first, root[y[open_]], open_)
        chosen = np.unique(first[first < len(order)])
        taken.append(chosen)
        while True:  # join the classes
            low = np.minimum(root[x[chosen]], root[y[chosen]])
            after = root.copy()
            np.minimum.at(after, root[x[chosen]], low)
            np.minimum.at(after, root[y[chosen]], low)
            while (jumped := after[after]).tolist() != after.tolist():
                after = jumped
            after = after[root]
            if (after == root).all():
                break
            root = after
    return order[np.concatenate(taken)] if taken else np.zeros(0, np.int64)


def alike(own: np.ndarray, sizes: np.ndarray, flat: np.ndarray, least: int) -> np.ndarray:
    """Which of some sets, of such sizes and one after the other, have a Jaccard similarity of ``least`` thousandths or more with a sorted one."""
    both = np.zeros(len(flat) + 1, np.int64)
    if len(own):
        np.cumsum(own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat, out=both[1:])
    ends = np.cumsum(sizes)
    return (both[ends] - both[ends - sizes]) * (1000 + least) >= least * (len(own) + sizes)


def _links(first_most: int, most: int, words: int, named: bool, labelled: bool, fine: int = 0, fine_most: int = 0, forest: bool = False, least: int = 0, rows: list[str] | None = None):
    """Verify the candidates of sorted buckets. Rows (a, b, bits) of pairs near enough in the first word and in all.

    Fingerprints are named by their first word, or by the column after the words. A forest of the pairs of each bucket
    is given, of the nearest ones; with labels, which follow the name, all pairs between different labels, or with ``forest``
    as many as connect what all would. A finer fingerprint of ``fine`` words, after the label, decides in the end and gives the
    bits; or with ``least`` the similarity, in thousandths, of the sets that follow it.

    With ``rows``, the columns of words, name and label, the filed rows that have such a candidate are given in place of pairs.
    """
    name = words + fine if named else 0

    def near(p: np.ndarray, i: np.ndarray, j) -> tuple[np.ndarray, np.ndarray]:
        """Which rows ``i`` are near row or rows ``j``, as places in ``i``, and the bits between them."""
        other = lambda at: j[at] if isinstance(j, np.ndarray) else j
        apart = lambda at, a, b: np.bitwise_count(p[i[at], a:b] ^ p[other(at), a:b]).sum(axis=1, dtype=np.int64)
        first = np.bitwise_count(p[i, 0] ^ p[j, 0]).astype(np.int64)
        at = np.flatnonzero(first <= first_most)
        d = first[at]
        if words > 1:
            d = d + apart(at, 1, words)
            at, d = at[d <= most], d[d <= most]
        if fine:
            d = apart(at, words, words + fine)
            at, d = at[d <= fine_most], d[d <= fine_most]
        return at, d

    def steps(bucket: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All pairs of many small buckets, as places of rows, by comparing rows one step apart, then two, and so on."""
        alive, step = np.arange(len(prints)), 1
        while len(alive):
            alive = alive[alive + step < len(prints)]
            alive = alive[bucket[alive] == bucket[alive + step]]
            some = alive[prints[alive, -1] != prints[alive + step, -1]] if labelled else alive
            at, d = near(prints, some, some + step)
            yield some[at], some[at] + step, d
            step += 1

    def slide(bucket: np.ndarray, prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return [(prints[i, name], prints[j, name], d) for i, j, d in steps(bucket, prints)]

    def meeting(prints: np.ndarray) -> np.ndarray:
        """Which rows of one large bucket are near a row of another label. Of a row's candidates the nearest looks for more rows
        that are still open, so a dense group costs few passes."""
        of = np.unique(prints[:, -1], return_inverse=True)[1]
        met, lone = np.zeros(len(of), bool), np.zeros(len(of), bool)
        for row in range(len(of)):
            if met[row]:
                continue
            others = np.flatnonzero(~lone & (of != of[row]))
            at, d = near(prints, others, row)
            lone[row] = not len(at)
            if len(at):
                met[row] = met[others[at]] = True
                nearest = int(others[at[d.argmin()]])
                open_ = np.flatnonzero(~met & ~lone & (of != of[nearest]))
                met[open_[near(prints, open_, nearest)[0]]] = True
        return met

    def search(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The classes of one large bucket. A row that is reached leaves the rest, so a dense group costs few passes."""
        found, rest = [], np.arange(len(prints))
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                row = queue.pop()
                at, d = near(prints, rest, row)
                if len(at):
                    reached = rest[at]
                    found.append((np.full(len(reached), prints[row, name]), prints[reached, name], d))
                    queue += reached[np.argsort(-d, kind="stable")].tolist()
                    rest = np.delete(rest, at)
        return found

    def across(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The pairs of one large bucket between labels: rows of all labels but the commonest against the others."""
        labels, of, n = np.unique(prints[:, -1], return_inverse=True, return_counts=True)
        found = []
        for row in np.flatnonzero(of != n.argmax()) if len(labels) > 1 else []:
            others = np.flatnonzero(of != of[row])
            at, d = near(prints, others, int(row))
            found.append((np.full(len(at), prints[row, name]), prints[others[at], name], d))
        return found

    def spanning(prints: np.ndarray, places: np.ndarray, sets: pa.Array | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Links of one bucket that connect its labels as all would. A label that is reached leaves the rest with all its rows;
        of a row's candidates the nearest of each label that is still apart come first."""
        labels, of = np.unique(prints[:, -1], return_inverse=True)
        found, rest = [], np.arange(len(prints)) if len(labels) > 1 else np.zeros(0, np.int64)

        def like(row: int, some: np.ndarray) -> np.ndarray:
            if sets is None:
                return np.ones(len(some), bool)
            own, out = sets[int(places[row])].values.to_numpy().view(np.uint64), []
            for at in range(0, len(some), COMPARED):
                others = sets.take(pa.array(places[some[at : at + COMPARED]]))
                out.append(alike(own, np.diff(others.offsets.to_numpy()).astype(np.int64), others.flatten().to_numpy().view(np.uint64), least))
            return np.concatenate(out)

        while len(rest):
            first = of[rest] == of[rest[0]]
            queue, rest = rest[first].tolist(), rest[~first]
            while queue and len(rest):
                row = queue.pop()
                at, d = near(prints, rest, row)
                order = np.argsort(d, kind="stable")
                open_, d, reached = rest[at[order]], d[order], []
                while len(open_):
                    nearest = np.unique(of[open_], return_index=True)[1]
                    held = nearest[like(row, open_[nearest])]
                    found.append((np.full(len(held), prints[row, name]), prints[open_[held], name], d[held]))
                    reached.append(of[open_[held]])
                    left = ~np.isin(of[open_], reached[-1])
                    left[nearest] = False
                    open_, d = open_[left], d[left]
                if reached:
                    gone = np.isin(of[rest], np.concatenate(reached))
                    queue += rest[gone].tolist()
                    rest = rest[~gone]
        return found

    def once(bucket: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows by bucket and name, without those that met in two ways, and their places before."""
        order = np.lexsort((prints[:, name], bucket))
        bucket, prints = bucket[order], prints[order]
        twice = np.concatenate(([False], (bucket[1:] == bucket[:-1]) & (prints[1:, name] == prints[:-1, name])))
        return bucket[~twice], prints[~twice], order[~twice]

    def candidates(keys: np.ndarray, bucket: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        bucket, prints, order = once(bucket, prints)
        _, starts, sizes = np.unique(bucket, return_index=True, return_counts=True)
        large, met = sizes > SMALL, np.zeros(len(bucket), bool)
        for s, n in zip(starts[large].tolist(), sizes[large].tolist(), strict=True):
            met[s : s + n] = meeting(prints[s : s + n])
        small = np.flatnonzero(np.repeat(~large, sizes))
        for i, j, _ in steps(bucket[small], prints[small]):
            met[small[i]] = met[small[j]] = True
        keys, prints = keys[order[met]], np.delete(prints[met], np.s_[words : words + fine], axis=1).view(np.int64)
        kinds = (np.int32, np.int64, np.int32)
        return pa.RecordBatch.from_arrays([*(pa.array(keys[:, i].astype(k)) for i, k in enumerate(kinds)), *(pa.array(np.ascontiguousarray(c)) for c in prints.T)], names=["part", "value", "block", *rows])

    def made(bucket: np.ndarray, prints: np.ndarray, sets: pa.Array | None = None) -> pa.RecordBatch:
        bucket, prints, order = once(bucket, prints)
        _, starts, sizes = np.unique(bucket, return_index=True, return_counts=True)
        large = sizes > (1 if forest else SMALL)
        of_large = (lambda s, n: spanning(prints[s : s + n], order[s : s + n], sets)) if forest else (lambda s, n: (across if labelled else search)(prints[s : s + n]))
        found = [link for s, n in zip(starts[large].tolist(), sizes[large].tolist(), strict=True) for link in of_large(s, n)]
        small = np.repeat(~large, sizes)
        found += [] if forest else slide(bucket[small], prints[small])
        a, b, d = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.uint64) for i in range(3))
        if len(a) and not labelled:
            if words == 1:
                a, b = _forest(a, b)
                d = np.zeros(len(a), np.int64)
            else:
                at = _spanning(a, b, d)
                a, b, d = a[at], b[at], d[at]
        a, b = a.view(np.int64), b.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d.astype(np.int64))], names=["a", "b", "bits"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, pa.Array | None]] = []  # the last bucket may go on in the next batch
        width = words + named + labelled
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)], axis=1)
            prints = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in range(3, 3 + width)], axis=1)
            if fine:
                more = np.frombuffer(b"".join(batch.column(3 + width).to_pylist()), np.uint64).reshape(-1, fine)
                prints = np.concatenate((prints[:, :words], more, prints[:, words:]), axis=1)
            sets = batch.column(batch.num_columns - 1) if least else None
            part = lambda a, b, sets=sets: None if sets is None else sets.slice(a, b - a)
            last = int(np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))[-1])
            if last or held and (keys[0] != held[-1][0][-1]).any():
                held.append((keys[:last], prints[:last], part(0, last)))
                yield closed(held)
                held = []
            held.append((keys[last:], prints[last:], part(last, len(keys))))
        if held:
            yield closed(held)

    def closed(held) -> pa.RecordBatch:
        keys, prints = np.concatenate([k for k, *_ in held]), np.concatenate([p for _, p, _ in held])
        bucket = np.cumsum(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
        if rows is not None:
            return candidates(keys, bucket, prints)
        return made(bucket, prints, pa.concat_arrays([s.cast(pa.large_list(pa.int64())) for *_, s in held]) if least else None)

    return over


class Index:
    """Fingerprints filed by a plan: ``distinct`` has the words, each combination once, or a column that names them."""

    def __init__(self, distinct: DataFrame, plan, first_most: int, most: int, words: int = 1, name: str | None = None):
        ship(distinct.sparkSession)
        self.distinct, self.plan, self.words, self.name = distinct, plan, words, name
        self.first_most, self.most = first_most, most
        self.columns = [*word_columns(words), *([name] if name else [])]
        self.key = name or "fp"

    def _filed(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        named = ", ".join(f"{c} long" for c in columns)
        return rows.select(*columns).mapInArrow(_file(self.plan, self.words, columns), f"part int, value long, {named}")

    def _large(self, filed: DataFrame) -> DataFrame:
        """Buckets of more than ``BLOCK`` rows, with their number of blocks."""
        sizes = filed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
        return cut(sizes.select(F.col("part").alias("__p"), F.col("value").alias("__v"), F.ceil(F.col("n") / BLOCK).cast("int").alias("__blocks")))

    @staticmethod
    def _dealt(filed: DataFrame, columns: list[str]) -> DataFrame:
        return filed.select("part", "value", "block", *columns).repartition("part", "value", "block").sortWithinPartitions("part", "value", "block")

    def _candidates(self, dealt: DataFrame, columns: list[str], fine: DataFrame, fine_most: int) -> DataFrame:
        """The filed rows that have a candidate of another label in their bucket, by finer fingerprints too."""
        found = _links(self.first_most, self.most, self.words, self.name is not None, True, FINE, fine_most, rows=columns)
        named = ", ".join(f"{c} long" for c in columns)
        met = dealt.join(fine.select(F.col("node").alias("__node"), "fine"), F.col(self.key) == F.col("__node"))
        return cut(self._dealt(met, [*columns, "fine"]).mapInArrow(found, f"part int, value long, block int, {named}"))

    def _verified(self, dealt: DataFrame, columns: list[str], labelled: bool, fine_most: int = 0, forest: bool = False, least: int = 0) -> DataFrame:
        fine = FINE if "fine" in columns else 0
        rows = self._dealt(dealt, columns)
        found = rows.mapInArrow(_links(self.first_most, self.most, self.words, self.name is not None, labelled, fine, fine_most, forest, least), "a long, b long, bits long")
        return found.groupBy("a", "b").agg(F.min("bits").alias("bits"))

    def forest(self) -> tuple[DataFrame, DataFrame | None]:
        """Links (a, b, bits) of a forest in each bucket, and the fingerprints of buckets that are too large for one task.

        Those are dealt into blocks, each time by another hash; what lies in different blocks is left to ``between``.
        """
        filed = self._filed(self.distinct, self.columns)
        large = self._large(self._filed(self.distinct, self.columns[: self.words]))
        if large.isEmpty():
            return cut(self._verified(filed.withColumn("block", F.lit(0)), self.columns, False)), None
        met = filed.join(large, (F.col("part") == F.col("__p")) & (F.col("value") == F.col("__v")), "left")
        dealt = met.withColumn("block", F.coalesce(F.pmod(F.xxhash64(self.key, "part"), F.col("__blocks")).cast("int"), F.lit(0)))
        crowded = met.filter("__blocks is not null").select(F.col(self.key).alias("node")).distinct()
        return cut(self._verified(dealt, self.columns, False)), cut(crowded)

    def between(self, labelled: DataFrame, fine: DataFrame | None = None, fine_most: int = 0, forest: bool = False, similarity: float = 0) -> DataFrame:
        """All links (a, b, bits) between rows (node, label) of different labels; with ``forest`` as many of each bucket as connect
        what all would, so they are fewer than the bucket's rows.

        In a bucket that is too large for one task, rows of the commonest label stay in a block each, and the others
        go to every block: the work follows the rows of other labels, not the square of the bucket. Finer fingerprints and sets
        (node, fine, shingles), where given, are compared too: these links hold a Jaccard similarity. Finer fingerprints meet only
        the rows of buckets with several labels, and sets only the rows that have a candidate by these.
        """
        columns = [*self.columns, "label"]
        rows = self.distinct.select(*self.columns, F.col(self.key).alias("__node")).join(labelled.select(F.col("node").alias("__node"), "label"), "__node")
        rows = cut(rows.select(*columns))
        filed = self._filed(rows, columns)
        wide, more, least = lambda dealt: dealt, [], 0
        if fine is not None:
            mixed = filed.groupBy("part", "value").agg(F.min("label").alias("__x"), F.max("label").alias("__y")).filter("__x <> __y").select("part", "value")
            filed = cut(filed.join(mixed, ["part", "value"], "left_semi"))
            more, least = ["fine", "shingles"], round(1000 * similarity)
            sets = fine.select(F.col("node").alias("__node"), *more)
            wide = lambda dealt: self._candidates(dealt, columns, fine, fine_most).join(sets, F.col(self.key) == F.col("__node"))
        large = self._large(filed if fine is not None else self._filed(rows, self.columns[: self.words]))
        if large.isEmpty():
            return self._verified(wide(filed.withColumn("block", F.lit(0))), [*columns, *more], True, fine_most, forest, least)
        met = filed.join(large, (F.col("part") == F.col("__p")) & (F.col("value") == F.col("__v")), "left")
        counted = met.filter("__blocks is not null").groupBy("part", "value", "label").agg(F.count(F.lit(1)).alias("n"))
        common = cut(counted.groupBy(F.col("part").alias("__p2"), F.col("value").alias("__v2")).agg(F.max_by("label", F.struct("n", "label")).alias("__common")))
        own = F.pmod(F.xxhash64(self.key), F.col("__blocks")).cast("int")
        every = F.sequence(F.lit(0), F.col("__blocks") - 1)
        blocks = F.when(F.col("__blocks").isNull(), F.array(F.lit(0))).when(F.col("label") == F.col("__common"), F.array(own)).otherwise(every)
        met = met.join(common, (F.col("part") == F.col("__p2")) & (F.col("value") == F.col("__v2")), "left")
        return self._verified(wide(met.withColumn("block", F.explode(blocks))), [*columns, *more], True, fine_most, forest, least)


def link(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) that connect all fingerprints (column ``fp``, each once) within the distance, directly or by others.

    Every pair within ``distance`` meets in some bucket. Of a bucket's links a spanning forest is returned, so the rows
    stay in proportion to the fingerprints even where thousands lie close together.
    """
    _, plan = allot(bit_counts(distinct), distinct.count(), distance)
    index = Index(distinct, plan, distance, distance)
    found, crowded = index.forest()
    if crowded is None:
        return found.select("a", "b")
    roots = components(found.select("a", "b")).select(F.col("node").alias("__n"), "root")
    labelled = crowded.join(roots, F.col("node") == F.col("__n"), "left").select("node", F.coalesce("root", "node").alias("label"))
    return found.select("a", "b").union(index.between(labelled, forest=True).select("a", "b")).distinct()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, root) of all links of a partition."""
    rows = [b for b in batches if b.num_rows]
    if rows:
        u, v = (np.concatenate([b.column(i).to_numpy() for b in rows]) for i in (0, 1))
        node, root = _forest(u, v)
        own = np.unique(root)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((node, own))), pa.array(np.concatenate((root, own)))], names=["node", "root"])


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """Rows (node, root) for every linked node: the least node that it reaches.

    At most ``few`` links, which are counted first, are joined by one task, a few tens of MB. Beyond that by alternating
    large and small stars: each round replaces links by shorter ones towards smaller nodes, without joining a node's
    neighbours to each other, until nothing changes; rounds grow with the logarithm of the longest chain.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    if edges.count() <= few:
        ship(links.sparkSession)
        return cut(edges.coalesce(1).mapInArrow(_stars, "node long, root long"))
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = cut(small.filter("u <> v").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def group(docs: DataFrame, width: int = 5, distance: int = 4, text: str = "text", id_column: str = "doc_id", keep=()) -> DataFrame:
    """Rows of (id, columns of ``keep``, fp, root, component_id), one for each document: root is the class by fingerprint.

    component_id is the smallest id reachable over links of at most ``distance`` differing bits, a document's own
    included. Empty and null texts have the fingerprint 0 and link like any other. Null ids never are the smallest;
    a class of null ids only has a null component_id. An empty table gives an empty one.
    """
    found = cut(fingerprints(docs, width, text, (id_column, *keep)))
    distinct = cut(found.groupBy("fp").agg(F.min(id_column).alias("__least")))
    roots = components(link(distinct, distance))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "__least", F.coalesce("root", "fp").alias("root"))
    whole = placed.groupBy("root").agg(F.min("__least").alias("component_id"))
    classes = placed.join(whole, "root").select(F.col("fp").alias("__fp"), "root", "component_id")
    return found.join(classes, F.col("fp") == F.col("__fp")).drop("__fp")


def hexadecimal(column: str = "fp"):
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def shingle_sets(docs: DataFrame, width: int, text: str, key: str) -> DataFrame:
    """The key and ``shingles``, the distinct hashes of a text's shingles."""
    run = lambda texts: ([np.unique(shingle_hashes(t, width)).view(np.int64) for t in texts],)
    return map_texts(docs, lambda: run, [("shingles", "array<long>")], text, (key,))


def finer(sets: DataFrame) -> DataFrame:
    """The node of each set, ``fine``, a fingerprint of ``FINE`` words over its distinct shingles, and these."""
    ship(sets.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy().view(np.uint64)
            made = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                made.append(np.array([simhash(remix(flat[a:b], 1000 + k)) for k in range(FINE)], np.uint64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), batch.column(1)], names=["node", "fine", "shingles"])

    return sets.select("node", "shingles").mapInArrow(over, "node long, fine binary, shingles array<long>")


def verified(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) between sets (node, shingles) of at least a Jaccard similarity, in thousandths. Two empty sets are alike."""
    sides = [sets.select(F.col("node").alias(c), F.col("shingles").alias(f"__{c}")) for c in ("a", "b")]
    both = F.size(F.array_intersect("__a", "__b")).cast("long")
    least = round(1000 * similarity)
    return links.join(sides[0], "a").join(sides[1], "b").filter(both * (1000 + least) >= least * (F.size("__a") + F.size("__b"))).select("a", "b")


def between_labels(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The links (a, b) whose ends have different labels (__n, label); a node without one is its own."""
    sides = [labels.select(F.col("__n").alias(f"__{c}"), F.col("label").alias(f"__label_{c}")) for c in ("a", "b")]
    met = links.select("a", "b").join(sides[0], F.col("a") == F.col("__a"), "left").join(sides[1], F.col("b") == F.col("__b"), "left")
    return met.filter(F.coalesce("__label_a", "a") != F.coalesce("__label_b", "b")).select("a", "b")


def classes(docs: DataFrame, distinct: DataFrame, width: int, similarity: float, words: int, text: str, key: str) -> DataFrame:
    """Rows (node, root) for texts with links: a link is a candidate pair whose exact similarity holds.

    ``distinct`` has a node and its fingerprint, once for each text; ``docs`` the texts by ``key``. Of the candidates of
    each bucket a forest of the nearest ones comes first: of these, the nearest of each text are verified, then those
    between the classes so found. Where candidates link classes that the verified ones don't, the candidates between
    these classes are verified in their buckets, but for those that others connect, so none is missed.
    """
    differ = most_bits(similarity, words)
    _, plan = allot_probable(bit_counts(distinct, words), distinct.count(), differ, RECALL)
    index = Index(distinct, plan, most_bits(similarity, 1, FIRST_ERRORS), most_bits(similarity, words, ERRORS), words, "node")
    forest, crowded = index.forest()
    loose = components(forest.select("a", "b"))
    members = loose.select("node") if crowded is None else loose.select("node").union(crowded)
    linked = cut(members.distinct().withColumnRenamed("node", key))
    few = F.broadcast(linked) if linked.count() <= FEW_LINKED else linked
    sets = shingle_sets(docs.join(few, key, "left_semi"), width, text, key).groupBy(F.col(key).alias("node")).agg(F.first("shingles").alias("shingles"))
    sets = staged(sets)

    def labels(firm: DataFrame) -> DataFrame:
        return components(firm).select(F.col("node").alias("__n"), F.col("root").alias("label"))

    ends = forest.select(F.col("a").alias("__end"), "a", "b", "bits").union(forest.select(F.col("b").alias("__end"), "a", "b", "bits"))
    nearest = ends.groupBy("__end").agg(F.min(F.struct("bits", "a", "b")).alias("l")).select("l.a", "l.b").distinct()
    firm = cut(verified(nearest, sets, similarity))
    tight = labels(firm)
    rest = between_labels(forest, tight).join(nearest, ["a", "b"], "left_anti")
    firm = cut(firm.unionByName(verified(rest, sets, similarity)))
    tight = labels(firm)
    every = loose if crowded is None else loose.unionByName(crowded.join(loose, "node", "left_anti").select("node", F.col("node").alias("root")))
    labelled = cut(every.join(tight, F.col("node") == F.col("__n"), "left").select("node", "root", F.coalesce("label", "node").alias("label")))
    apart = labelled.groupBy("root").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("root")
    open_ = labelled.join(apart, "root", "left_semi").select("node", "label")
    if crowded is not None:
        open_ = open_.unionByName(labelled.join(crowded, "node", "left_semi").select("node", "label")).distinct()
    open_ = cut(open_)
    if open_.isEmpty():
        return components(firm)
    # finer fingerprints leave few candidates; their sets are compared where they meet, and links that connect them go on
    some = sets.join(open_, "node", "left_semi")
    found = index.between(open_, staged(finer(some)), most_bits(similarity, FINE, ERRORS), True, similarity)
    return components(firm.union(found.select("a", "b")))


def representatives(docs: DataFrame, width: int = 5, similarity: float = 0.8, words: int = 4, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The columns of ``docs``, with one document of each class of texts of the given similarity of shingles or more.

    Fingerprints of ``words`` words choose candidates; the exact similarity links them, and classes are chains of links.
    The document of the smallest id stays, and of several texts under that id the one of the least hash. A row that is
    repeated stays once; of rows that agree in id and text but not elsewhere the least as JSON stays. A null id stays only in a class without others. Null and empty texts are alike. Columns may
    have any names; an empty table gives an empty one.
    """
    rows, at = inner(docs)
    id_column, text = at[id_column], at[text]
    keyed = rows.withColumn("__key", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    found = fingerprints(keyed, width, text, (id_column, "__key"), words).withColumnRenamed(id_column, "__id")
    named = word_columns(words)
    rows = found.groupBy("__key", "__id").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in named])
    least = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__key").alias("h"), "n")).alias("least")
    distinct = cut(rows.groupBy(F.col("__key").alias("node")).agg(least, *[F.first(c).alias(c) for c in named]))
    roots = classes(keyed.select("__key", text), distinct, width, similarity, words, text, "__key")
    placed = distinct.select(F.col("node").alias("__n"), "least").join(roots, F.col("__n") == F.col("node"), "left")
    kept = cut(placed.groupBy(F.coalesce("root", "__n").alias("root")).agg(F.min("least").alias("k")).select(F.col("k.id").alias("__id"), F.col("k.h").alias("__h"), "k.n"))
    rows = keyed.join(kept.select("__id", "__h"), keyed[id_column].eqNullSafe(kept["__id"]) & (keyed["__key"] == kept["__h"]), "left_semi")
    if not kept.filter("n > 1").isEmpty():
        rows = one_of(rows, [id_column, "__key"], text)
    return outer(rows.drop("__key"), docs)
