"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source is wanted ``target / source size`` times. The whole part is taken at once; the rest is a copy
probability. Two documents at a time, mass (probability times words) moves at random from one to the other until one
probability is 0 or 1; the direction is drawn so that each probability stays right in expectation, and the words that
the two contribute stay the same. Documents are dealt into small groups inside a source, each group leaves at most one
fractional document, and these go up a reduction tree of the same step until one is left in each source. That one goes
to its nearer side, not by chance. Since a large document can only be settled by as much mass, it is often the last, so
what its source then misses is made up by documents that are smaller: one copy more, or one less, of the largest that
fits, the next, and so on. A source's words differ from its target by at most half of the smallest document that has a
copy to give or take, and all documents but those few are taken as often as wanted in expectation. Rows that agree in key and text are one weighted row on
the way, so no group grows with how often a row is repeated.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.runtime import cut, inner, one_of, outer, ship
from docloom.shared import few, numbered

#: Documents in a leaf of the reduction tree, and residuals that meet in a node above.
LEAF, FAN = 512, 512
#: No document is taken more often, so no source gets more than this many times its size.
CAP = 3
#: Tables of at most so many sources are broadcast; more are joined by a shuffle.
FEW_SOURCES = 100_000
#: Rows that are written out from one weighted row in one task.
CHUNK = 10_000
#: Columns of a mix besides its key.
RESULT = ("source", "size", "source_size", "target", "copies", "taken")
WORD = r"[^\x20\x09-\x0D]+"


def allocate(sizes: DataFrame, cap: int = CAP, source: str = "source", size: str = "size", weights: DataFrame | None = None) -> DataFrame:
    """Columns source, source_size and target for a table of (source, size), one row for each source.

    Weights are 1, 2, 3, repeating over sources by code point with null last, or come from a table (source, weight).
    Targets share all words by weight, none above ``cap`` times its source's words; the share that a source cannot take
    goes to the others by weight. The common level of those rises by rounds of sums, until no further source is full.
    """
    if weights is None:
        placed = numbered(sizes, F.col(source).asc_nulls_last(), name="__place")
        weighed = placed.withColumn("__w", ((F.col("__place") - 1) % 3 + 1).cast("double")).drop("__place")
    else:
        weighed = sizes.join(weights.select(F.col("source").alias("__s"), F.col("weight").cast("double").alias("__w")), F.col(source).eqNullSafe(F.col("__s")), "left").drop("__s").fillna(0.0, ["__w"])
    weighed = cut(weighed)
    room = cap * F.col(size).cast("double")
    total = weighed.agg(F.coalesce(F.sum(F.col(size)), F.lit(0)).cast("double")).first()[0]
    level, full = 0.0, -1
    while True:
        over = room < level * F.col("__w")
        n, taken, open_ = weighed.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, room)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("__w"))), F.lit(0.0))).first()
        if n == full or not open_:
            break
        full, level = n, max(total - taken, 0.0) / open_
    return weighed.select(F.col(source), F.col(size).alias("source_size"), F.least(room, F.lit(level) * F.col("__w")).alias("target"))


def pivot(x: np.ndarray, words: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Round probabilities from the largest document down, keeping the sum of probability times words; gives the one left open, or -1.

    A small document that meets a large one is emptied into it or filled from it, so the one left open is often large.
    """
    x = x.tolist()
    w, u = words.tolist(), draw.tolist()
    held = -1
    for j in np.argsort(-words, kind="stable").tolist():
        if held < 0:
            held = j
            continue
        i = held
        room_i, mass_i, room_j, mass_j = (1 - x[i]) * w[i], x[i] * w[i], (1 - x[j]) * w[j], x[j] * w[j]
        to_i, to_j = min(room_i, mass_j), min(room_j, mass_i)
        if u[j] * (to_i + to_j) < to_j:  # towards i as often as the other way is long
            full, empty = room_i <= mass_j, mass_j <= room_i
            x[i] = 1.0 if full else x[i] + to_i / w[i]
            x[j] = 0.0 if empty else x[j] - to_i / w[j]
            done_i, done_j = full, empty
        else:
            full, empty = room_j <= mass_i, mass_i <= room_j
            x[j] = 1.0 if full else x[j] + to_j / w[j]
            x[i] = 0.0 if empty else x[i] - to_j / w[i]
            done_i, done_j = empty, full
        held = -1 if done_i and done_j else j if done_i else i
    if held >= 0 and not 0 < x[held] < 1:
        held = -1
    return np.array(x), held


def _node(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    words = table["__size"].to_numpy()
    draw = table["__draw"].to_numpy()
    # ties among equal sizes are broken by the draws, so the order that rows arrive in doesn't matter
    order = np.lexsort((draw, -words))
    table = table.take(pa.array(order))
    x, held = pivot(table["__x"].to_numpy(), words[order], draw[order])
    still = np.zeros(len(x), bool)
    if held >= 0:
        still[held] = True
    return table.set_column(table.schema.get_field_index("__x"), "__x", pa.array(x)).set_column(table.schema.get_field_index("__open"), "__open", pa.array(still))


def _rounded(docs: DataFrame, text: str, source: str, key: list[str], cap: int, seed: int, weights: DataFrame | None, count: str | None) -> DataFrame:
    """Rows (key, __source, __size, source_size, target, __m, __total): how often the ``__m`` rows of a key and text are taken in all."""
    ship(docs.sparkSession)
    size = F.coalesce(F.col(count).cast("long"), F.lit(0)) if count else F.when(F.col(text).isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")
    each = docs.select(*key, F.col(source).alias("__source"), size.alias("__size"), F.xxhash64(*key, F.lit(seed), F.length(text) if count else text).alias("__hash"))
    base = cut(each.groupBy(*key, "__source", "__size", "__hash").agg(F.count(F.lit(1)).alias("__m")))
    per = cut(base.groupBy("__source").agg(F.sum(F.col("__size") * F.col("__m")).alias("size"), F.count(F.lit(1)).alias("__n")))
    targets = allocate(per.select("__source", "size"), cap, "__source", weights=weights).join(per.select(F.col("__source").alias("__s"), "__n"), F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    targets = cut(targets)
    sources, most = targets.agg(F.count(F.lit(1)), F.coalesce(F.max("__n"), F.lit(0))).first()
    t = targets.select(F.col("__source").alias("__s"), "source_size", "target", F.ceil(F.col("__n") / LEAF).alias("__leaves"))
    if sources <= FEW_SOURCES:
        t = F.broadcast(t)
    wanted = F.when(F.col("source_size") > 0, F.col("target") * F.col("__m") / F.col("source_size")).otherwise(0.0)
    rows = base.join(t, F.col("__source").eqNullSafe(F.col("__s"))).drop("__s").withColumn("__wanted", wanted)
    rows = rows.withColumn("__whole", F.floor("__wanted")).withColumn("__x", F.col("__wanted") - F.col("__whole"))
    rows = rows.withColumn("__open", (F.col("__size") > 0) & (F.col("__x") > 0)).withColumn("__x", F.when(F.col("__open"), F.col("__x")).otherwise(0.0))
    rows = rows.withColumn("__node", F.pmod(F.xxhash64("__hash", F.lit(-1)), F.col("__leaves"))).drop("__wanted", "__leaves")
    closed = [rows.filter(~F.col("__open"))]
    rows = rows.filter("__open")
    nodes, depth = -(-most // LEAF), 0
    while True:
        drawn = rows.withColumn("__draw", F.pmod(F.xxhash64("__hash", F.lit(depth)), F.lit(1 << 53)) / float(1 << 53))
        level = cut(drawn.groupBy("__source", "__node").applyInArrow(_node, drawn.schema))
        closed.append(level.filter(~F.col("__open")).drop("__draw"))
        rows = level.filter("__open").drop("__draw")
        if nodes <= 1:
            break
        rows = rows.withColumn("__node", F.floor(F.col("__node") / FAN))
        nodes, depth = -(-nodes // FAN), depth + 1
    closed.append(rows.withColumn("__x", (F.col("__x") >= 0.5).cast("double")))
    out = closed[0]
    for part in closed[1:]:
        out = out.unionByName(part)
    taken = out.select(*key, "__source", "__size", "source_size", "target", "__m", "__hash", (F.col("__whole") + F.col("__x")).cast("long").alias("__total"))
    return _made_up(cut(taken), key, cap).drop("__hash")


def correction(miss: float, sizes: np.ndarray, there: np.ndarray) -> np.ndarray:
    """How many documents of each size, of those that are there, make up for a number of words: from the largest down as many as
    fit, then the one that is nearest to what is left, if it is nearer than none."""
    n, left = np.zeros(len(sizes), np.int64), abs(miss)
    for i in np.argsort(-sizes, kind="stable").tolist():
        n[i] = min(int(there[i]), int(left // sizes[i]))
        left -= n[i] * sizes[i]
    off = np.where(there > n, np.abs(sizes - left), np.inf)
    if len(off) and off.min() < left:
        n[int(off.argmin())] += 1
    return n


def _corrections(table: pa.Table) -> pa.Table:
    table = table.combine_chunks().sort_by("__size")
    n = correction(table["__miss"][0].as_py(), table["__size"].to_numpy(), table["__n"].to_numpy())
    table = table.set_column(table.schema.get_field_index("__n"), "__n", pa.array(n, pa.int64()))
    return table.filter(pa.array(n > 0))


def _made_up(rows: DataFrame, key: list[str], cap: int) -> DataFrame:
    """The rows with ``__total`` one more or less for those that make up for what their source misses.

    A source is a group of its sizes, as few as its longest document has words; rows of a size are dealt by hash, first in 64
    parts, since any number may be of one size. A row gives or takes one copy, whatever number of rows it stands for.
    """
    miss = cut(rows.groupBy("__source").agg((F.max("target") - F.sum(F.col("__total") * F.col("__size"))).alias("__miss")).filter(F.abs("__miss") > 0.5))
    able = F.when(F.col("__miss") > 0, F.col("__total") < cap * F.col("__m")).otherwise(F.col("__total") > 0)
    met = rows.join(few(miss.withColumnRenamed("__source", "__s")), F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    able_rows = met.filter((F.col("__size") > 0) & (F.col("__size") < 2 * F.abs("__miss")) & able).select(*key, "__source", "__size", "__miss", "__hash")
    sizes = able_rows.groupBy("__source", "__size", "__miss").agg(F.count(F.lit(1)).alias("__n"))
    wanted = cut(sizes.groupBy("__source").applyInArrow(_corrections, sizes.schema))
    most = wanted.agg(F.max("__n")).first()[0]
    if most is None:
        return rows
    asked = few(wanted.select(F.col("__source").alias("__s"), F.col("__size").alias("__z"), "__n"))
    dealt = able_rows.join(asked, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z"))).drop("__s", "__z")
    dealt = dealt.withColumn("__draw", F.xxhash64("__hash", F.lit(-2)))
    order = ["__draw", "__hash", *key]
    part = Window.partitionBy("__source", "__size", F.pmod("__draw", F.lit(64))).orderBy(*order)
    dealt = dealt.withColumn("__at", F.row_number().over(part)).filter(F.col("__at") <= most)
    dealt = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__source", "__size").orderBy(*order))).filter(F.col("__at") <= F.col("__n"))
    named = [*key, "__source", "__size", "__hash"]
    steps = few(cut(dealt.select(*[F.col(c).alias(f"__of{i}") for i, c in enumerate(named)], F.signum("__miss").cast("long").alias("__step"))))
    same = [rows[c].eqNullSafe(steps[f"__of{i}"]) for i, c in enumerate(named)]
    stepped = rows.join(steps, functools.reduce(operator.and_, same), "left")
    return stepped.withColumn("__total", F.col("__total") + F.coalesce("__step", F.lit(0))).select(*rows.columns)


def _written_out(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column ``times`` says; what is written out often is dealt to several tasks."""
    few, many = rows.filter(F.col(times) <= CHUNK), rows.filter(F.col(times) > CHUNK)
    if not many.isEmpty():
        part = many.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / CHUNK))))
        part = part.withColumn(times, F.least(F.lit(CHUNK).cast("long"), F.col(times) - F.col("__part") * CHUNK))
        few = few.unionByName(part.repartition("__part").drop("__part"))
    return few.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).drop("__copy")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key=("doc_id",), cap: int = CAP, seed: int = 7, weights: DataFrame | None = None, count: str | None = None) -> DataFrame:
    """Columns of ``key``, the source, ``size`` (words, or the column ``count``), ``source_size``, ``target``, ``copies`` and ``taken``.

    One row for each document. Null and empty texts have no words and take none. A null source is a source of its own.
    Rows that agree in key and text share what is taken of them evenly. An empty table gives an empty one. Draws come
    from hashes of key, text and level, so reruns agree. A column of ``key`` that is named like one of the result gives
    way to it.
    """
    shown = [c for c in key if c not in RESULT]
    at = [f"__k{i}" for i in range(len(key))]
    named = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(key, at, strict=True)], F.col(f"`{text}`").alias("__text"), F.col(f"`{source}`").alias("__of"), *([F.col(f"`{count}`").alias("__count")] if count else []))
    rounded = _rounded(named, "__text", "__of", at, cap, seed, weights, "__count" if count else None)
    each, rest = F.floor(F.col("__total") / F.col("__m")), F.col("__total") % F.col("__m")
    parts = F.filter(F.array(F.struct((each + 1).alias("copies"), rest.alias("n")), F.struct(each.alias("copies"), (F.col("__m") - rest).alias("n"))), lambda p: p["n"] > 0)
    rows = cut(rounded.withColumn("__p", F.explode(parts)).select(*at, "__source", "__size", "source_size", "target", "__p.copies", F.col("__p.n").alias("__n")))
    out = _written_out(rows, "__n")
    return out.select(*[F.col(a).alias(c) for c, a in zip(key, at, strict=True) if c in shown], F.col("__source").alias("source"), F.col("__size").alias("size"), "source_size", "target", F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("__size")).cast("long").alias("taken"))


def materialise(docs: DataFrame, text: str = "text", source: str = "source", id_column: str = "doc_id", cap: int = CAP, seed: int = 7, weights: DataFrame | None = None, count: str | None = None) -> DataFrame:
    """The mix itself: the columns of ``docs``, each document as often as it is taken.

    Rows that agree in id, text and source are interchangeable: their copies are summed and written out from the least of them as JSON.
    Columns may have any names; an empty table gives an empty one.
    """
    rows, at = inner(docs)
    text, source, id_column = at[text], at[source], at[id_column]
    keyed = rows.withColumn("__key", F.xxhash64(F.col(text)))
    chosen = _rounded(keyed, text, source, [id_column, "__key"], cap, seed, weights, at[count] if count else None)
    copies = cut(chosen.filter("__total > 0").select(F.col(id_column).alias("__id"), F.col("__key").alias("__h"), F.col("__source").alias("__src"), F.col("__total").alias("__copies"), "__m"))
    same = keyed[id_column].eqNullSafe(copies["__id"]) & (keyed["__key"] == copies["__h"]) & keyed[source].eqNullSafe(copies["__src"])
    taken = keyed.join(copies, same)
    if not copies.filter("__m > 1").isEmpty():
        taken = one_of(taken.drop("__key", "__m"), ["__id", "__h", "__src"], text)
    taken = taken.drop("__id", "__h", "__src", "__key", "__m")
    if copies.filter(F.col("__copies") > CHUNK).isEmpty():
        return outer(taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))), docs)
    return outer(_written_out(taken, "__copies"), docs)
