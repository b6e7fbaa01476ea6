"""Graphs as DataFrames of nodes and edges: expansion, hints, chains, orphans, upserts, reconciliation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docloom.operators.segments import segmented_scan
from docloom.shared import cut, few
from docloom.shipping import ship

def expand(seeds: DataFrame, edges: DataFrame, hops: int, seed: str = "node", source: str = "src", target: str = "dst", kind: str = "kind", edge: str = "edge_id", most_hops: int = 3) -> DataFrame:
    """(seed, node, hop, path): all undirected trails of up to ``hops`` edges from each seed, with the kinds on the way.

    No edge is used twice on a trail, nodes may be; the start itself is no result. One join for each hop, on edges
    written in both directions. Trails multiply with the degree, so hops are limited.
    """
    if hops > most_hops:
        raise ValueError(f"at most {most_hops} hops")
    both = edges.select(F.col(source).alias("__from"), F.col(target).alias("__to"), kind, edge).unionByName(edges.select(F.col(target).alias("__from"), F.col(source).alias("__to"), kind, edge))
    edge_type = edges.schema[edge].dataType.simpleString()
    at = seeds.select(F.col(seed).alias("seed"), F.col(seed).alias("node"), F.lit(0).alias("hop"), F.array().cast("array<string>").alias("path"), F.array().cast(f"array<{edge_type}>").alias("__used")).distinct()
    out = None
    for _ in range(hops):
        at = at.join(both, F.col("node") == F.col("__from")).filter(~F.array_contains("__used", F.col(edge)))
        at = at.select("seed", F.col("__to").alias("node"), (F.col("hop") + 1).alias("hop"), F.concat("path", F.array(F.col(kind).cast("string"))).alias("path"), F.concat("__used", F.array(F.col(edge))).alias("__used"))
        out = at if out is None else out.unionByName(at)
    if out is None:
        return at.select("seed", "node", "hop", "path").filter(F.lit(False))
    return out.filter("node <> seed").select("seed", "node", "hop", "path").distinct()


def nearest(expanded: DataFrame) -> DataFrame:
    """Each node once for each seed, by its shortest trail; ties by path."""
    return expanded.groupBy("seed", "node").agg(F.min(F.struct("hop", "path")).alias("b")).select("seed", "node", "b.hop", "b.path")


def limited(expanded: DataFrame, items: DataFrame, hops: int, per_hop: int = 5, node: str = "node", key: str = "chunk_id") -> DataFrame:
    """Items at the nodes reached, by hop and key, at most ``per_hop * hops`` for each seed."""
    met = expanded.join(items.select(F.col(node), key), node)
    order = Window.partitionBy("seed").orderBy("hop", key, F.array_join("path", ">"))
    return met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_hop * hops)


#: Edges of a node from which it is a hub, whose adjacency is dealt out in parts of about as many.
HUB = 10_000


def _both_ways(edges: DataFrame, source: str, target: str, kind: str, edge: str, hub: int) -> tuple[DataFrame, DataFrame]:
    """Edges in both directions (__from, __part, __to, kind, edge), and the hubs (node, __parts). What starts at a hub is dealt
    out by a hash of the edge."""
    both = edges.select(F.col(source).alias("__from"), F.col(target).alias("__to"), F.col(kind).cast("string").alias("__kind"), F.col(edge).alias("__edge")).unionByName(edges.select(F.col(target).alias("__from"), F.col(source).alias("__to"), F.col(kind).cast("string").alias("__kind"), F.col(edge).alias("__edge")))
    hubs = cut(both.groupBy("__from").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hub).select(F.col("__from").alias("__hub"), F.ceil(F.col("n") / hub).cast("int").alias("__parts")))
    part = F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("__edge", "__to"), F.col("__parts"))).cast("int")
    dealt = both.join(few(hubs), F.col("__from") == F.col("__hub"), "left").withColumn("__part", part).drop("__hub", "__parts")
    return cut(dealt), hubs


def expand_to_items(seeds: DataFrame, edges: DataFrame, items: DataFrame, hops: int, per_hop: int = 5, seed: str = "node", source: str = "src", target: str = "dst", kind: str = "kind", edge: str = "edge_id", node: str = "node", key: str = "chunk_id", hub: int = HUB, most_hops: int = 3) -> DataFrame:
    """(seed, node, hop, path, key, place): what ``limited`` keeps of ``expand``, without making every trail.

    Items come by hop, key and path, so a seed that has its ``per_hop * hops`` from nearer hops isn't followed any further,
    and the last hop goes straight to nodes that have items, the first of each task at a time. A hub's edges are joined in
    parts, so no task holds them all.
    """
    if hops > most_hops:
        raise ValueError(f"at most {most_hops} hops")
    limit = per_hop * hops
    both, hubs = _both_ways(edges, source, target, kind, edge, hub)
    kept = items.select(F.col(node).alias("__at"), F.col(key).alias("__key")).filter("__at is not null")
    counts = cut(kept.groupBy("__at").agg(F.count(F.lit(1)).alias("__items")))
    edge_type = edges.schema[edge].dataType.simpleString()
    at = seeds.select(F.col(seed).alias("seed"), F.col(seed).alias("node"), F.array().cast("array<string>").alias("path"), F.array().cast(f"array<{edge_type}>").alias("__used")).distinct()
    order = Window.partitionBy("seed").orderBy("hop", "__key", F.array_join("path", ">"))
    found, have = None, None
    for hop in range(1, hops + 1):
        placed = at.join(few(hubs), F.col("node") == F.col("__hub"), "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__hub", "__parts")
        step = placed.join(both, (F.col("node") == F.col("__from")) & (placed["__part"] == both["__part"])).filter(~F.array_contains("__used", F.col("__edge")))
        at = step.select("seed", F.col("__to").alias("node"), F.concat("path", F.array("__kind")).alias("path"), F.concat("__used", F.array("__edge")).alias("__used"))
        if hop < hops:
            at = cut(at)
        reached = at.filter("node <> seed").select("seed", "node", "path").distinct()
        rows = reached.join(kept, F.col("node") == F.col("__at")).select("seed", "node", F.lit(hop).alias("hop"), "path", "__key")
        rows = cut(rows.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= limit).drop("__n"))
        found = rows if found is None else found.unionByName(rows)
        if hop < hops:
            n = reached.join(counts, F.col("node") == F.col("__at")).groupBy("seed").agg(F.sum("__items").alias("__n"))
            have = cut(n if have is None else have.unionByName(n).groupBy("seed").agg(F.sum("__n").alias("__n")))
            at = at.join(have.filter(F.col("__n") >= limit).select("seed"), "seed", "left_anti")
    if found is None:
        return at.join(kept, F.lit(False)).select("seed", "node", F.lit(0).alias("hop"), "path", F.col("__key").alias(key), F.lit(0).alias("place"))
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).withColumnRenamed("__key", key)


def hop_summary(expanded: DataFrame) -> DataFrame:
    return expanded.groupBy("hop").agg(F.countDistinct("node").alias("n_nodes"), F.count(F.lit(1)).alias("n_trails"))


def visible(roles: Column, own: list[str], null_visible: bool = False) -> Column:
    """Whether a row may be seen by any of the roles; rows without roles only where that is said."""
    if not own:
        return F.lit(False)
    seen = F.arrays_overlap(roles, F.array(*[F.lit(r) for r in own]))
    return F.coalesce(seen, F.lit(null_visible))


def hints(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, roles: list[str], k: int = 10, null_visible: bool = True, key: str = "node", source: str = "src", target: str = "dst", kind: str = "kind") -> DataFrame:
    """One-hop relations of the seeds whose two ends may be seen, the first ``k`` by source, kind and target."""
    able = nodes.filter(visible(F.col("allowed_roles"), roles, null_visible)).select(key)
    near = edges.join(seeds.select(F.col(key).alias(source)), source, "left_semi").unionByName(edges.join(seeds.select(F.col(key).alias(target)), target, "left_semi")).distinct()
    seen = near.join(able.withColumnRenamed(key, source), source, "left_semi").join(able.withColumnRenamed(key, target), target, "left_semi")
    return seen.orderBy(source, kind, target).limit(k)


def chain(rows: DataFrame, by: list[str], order: list[str], key: str, steps: int = 3) -> DataFrame:
    """Pairs (key, next, distance) up to so many places further on in the same group."""
    w = Window.partitionBy(*by).orderBy(*order)
    far = rows.withColumn("__next", F.array(*[F.struct(F.lit(i).alias("distance"), F.lead(key, i).over(w).alias("next")) for i in range(1, steps + 1)]))
    return far.select(key, F.explode("__next").alias("n")).select(key, F.col("n.next").alias("next"), F.col("n.distance").alias("distance")).filter("next is not null")


def orphans(nodes: DataFrame, edges: DataFrame, key: str = "node", source: str = "src", target: str = "dst") -> DataFrame:
    """Nodes at no edge: two anti-joins, so no union of both ends is built."""
    return nodes.join(edges.select(F.col(source).alias(key)), key, "left_anti").join(edges.select(F.col(target).alias(key)), key, "left_anti")


#: Bytes of wide rows that a task makes, to which one more row may come; that go to Spark at a time; what a row takes beside.
DEALT, HANDED, NARROW = 32 << 20, 8 << 20, 64
#: Pairs of first neighbours that are broadcast.
PAIRS = 200_000


def _pieces(pairs: DataFrame, key: str, item: str, name: str, joined: str | None) -> DataFrame:
    """(key, __at, name): each key's different items in order, in pieces of an Arrow batch at most, which are in the order of ``__at``."""
    ship(pairs.sparkSession)
    value = F.col(item).cast("string") if joined is not None else F.col(item)
    ranged = pairs.distinct().repartitionByRange(key, item).sortWithinPartitions(key, item)
    rows = ranged.select(key, F.monotonically_increasing_id().alias("__at"), value.alias(item))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                keys = batch.column(0)
                changes = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                starts = np.append(0, np.flatnonzero(changes) + 1)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, n), pa.int32()), batch.column(2))
                first = pa.array(starts)
                yield pa.RecordBatch.from_arrays([keys.take(first), batch.column(1).take(first), lists if joined is None else pc.binary_join(lists, joined)], names=[key, "__at", name])

    kind = rows.schema[item].dataType.simpleString()
    return rows.mapInArrow(over, f"`{key}` {rows.schema[key].dataType.simpleString()}, __at long, `{name}` {kind if joined is not None else f'array<{kind}>'}")


def _packed(wide: DataFrame, key: str) -> DataFrame:
    """(key, __size, __row): each row's other columns as one compressed value, and its size before."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest := one.drop_columns([key]).schema) as out:
                    out.write_batch(one.select(rest.names))
                whole = sink.getvalue()
                yield pa.RecordBatch.from_arrays([one.column(key), pa.array([whole.size], pa.int64()), pa.array([codec.compress(whole, asbytes=True)], pa.binary())], names=[key, "__size", "__row"])

    return wide.mapInArrow(over, f"`{key}` {wide.schema[key].dataType.simpleString()}, __size long, __row binary")


def _unpacked(rows: DataFrame, wide: DataFrame, key: str) -> DataFrame:
    """The rows with the columns of ``wide`` instead of their packed form, some megabytes at a time."""
    narrow, other = [c for c in rows.columns if c not in ("__size", "__row")], [f for f in wide.schema.fields if f.name != key]
    names = [*narrow, *(f.name for f in other)]
    kinds = to_arrow_schema(T.StructType(other)).types

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, at, values = pa.Codec("zstd"), None, None
        for batch in batches:
            keys, sizes, packed = batch.column(key).to_pylist(), batch.column("__size").to_pylist(), batch.column("__row")
            held, size, start = [], 0, 0
            for i in range(batch.num_rows):
                size += sizes[i] or 0
                last = i + 1 == batch.num_rows
                if last or keys[i + 1] != keys[i] or size > HANDED:
                    if sizes[i] is None:
                        own = [pa.nulls(1, k) for k in kinds]
                    elif values is None or at != keys[i]:
                        whole = pa.ipc.open_stream(codec.decompress(packed[i].as_py(), sizes[i])).read_all()
                        at, values = keys[i], [c.combine_chunks().cast(k) for c, k in zip(whole.columns, kinds, strict=True)]
                        own = values
                    else:
                        own = values
                    same = batch.slice(start, i + 1 - start)
                    held.append(pa.RecordBatch.from_arrays([*(same.column(c) for c in narrow), *(pa.concat_arrays([c] * same.num_rows) for c in own)], names=names))
                    start = i + 1
                    if last or size > HANDED:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                        held, size = [], 0

    return rows.mapInArrow(over, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*(rows.schema[c] for c in narrow), *other]))


def widened(rows: DataFrame, wide: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of the row of ``wide`` that has their key, or nulls. Rows must differ, and be staged like ``wide``.

    Where many rows get a wide one, what comes out is far larger than what goes in, and the size of no shuffle shows it. So rows
    are dealt out by the bytes that they will have, about ``DEALT`` in a task, as what writes them may hold all rows of a
    task; and a wide row goes compressed, and once, to each task that has rows of its key.
    """
    bytes_of = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in wide.columns if c != key), F.lit(NARROW).cast("long"))
    sized = cut(rows.join(few(cut(wide.select(key, bytes_of.alias("__bytes")))), key, "left").fillna(NARROW, ["__bytes"]))
    total = sized.agg(F.sum("__bytes")).first()[0] or 0
    if total <= DEALT:
        return rows.join(wide, key, "left")
    ship(rows.sparkSession)
    at, most = sized.columns.index("__bytes"), DEALT

    def before(state: int | None, table: pa.Table) -> list[pa.Array]:
        size = table.column(at).to_numpy()
        return [pa.array(((state or 0) + np.cumsum(size) - size) // most, pa.int32())]

    order = [F.col(key), *(F.col(c) for c in rows.columns if c != key)]
    dealt = cut(segmented_scan(sized, [], order, lambda t: int(t.column(at).to_numpy().sum()), lambda state, n: (state or 0) + n, before, [("__part", "int")]).drop("__bytes"))
    tasks = int(total // most) + 1
    copies = cut(_packed(wide, key)).join(few(dealt.select(key, "__part").distinct()), key).repartitionById(tasks, "__part")
    met = dealt.repartitionById(tasks, "__part").join(copies.hint("merge"), ["__part", key], "left")
    return _unpacked(met.select(*rows.columns, "__size", "__row"), wide, key)


def seed_neighbourhood(seeds: DataFrame, first: DataFrame, second: DataFrame, key: str = "node", source: str = "src", target: str = "dst", by: list[str] | None = None, joined: str | None = None) -> DataFrame:
    """Two steps from each seed, missing ones kept: (columns of ``by``, seed, sorted first neighbours, sorted second neighbours).

    Seeds may come from any ranking, such as the nearest vectors of each question. A node's neighbours are found once, however
    many seeds name it, and each edge of the second step is met once for each node before its first end. A node's neighbours are
    put together from pieces of sorted ranges, so only finished lists lie in memory, and the result is dealt out by its size.
    ``joined`` is what stands between neighbours, for lists as text.
    """
    met = cut(seeds.select(*(by or []), key).distinct())
    nodes = met.select(key).filter(F.col(key).isNotNull()).distinct()
    a = cut(nodes.join(first.select(F.col(source).alias(key), F.col(target).alias("__one")).filter("__one is not null"), key).distinct())
    b = second.select(F.col(source).alias("__one"), F.col(target).alias("__two")).filter("__two is not null")
    twos = b.join(few(a, PAIRS), "__one").select(key, "__two")
    pieces = _pieces(a, key, "__one", "first", joined).unionByName(_pieces(twos, key, "__two", "second", joined), allowMissingColumns=True)

    def whole(c: str) -> Column:
        parts = F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("__at", c)))), lambda p: p[c])
        return (F.flatten(parts) if joined is None else F.array_join(parts, joined)).alias(c)

    near = cut(pieces.groupBy(key).agg(whole("first"), whole("second")))
    listed = lambda c: F.coalesce(c, F.lit("") if joined is not None else F.array().cast(near.schema[c].dataType)).alias(c)
    return widened(met, near, key).select(*(by or []), key, listed("first"), listed("second"))


def review_queue(edges: DataFrame, status: str = "status", confidence: str = "confidence") -> DataFrame:
    """Proposed edges, the least certain first; edges without a status count as verified."""
    return edges.filter(F.coalesce(F.col(status), F.lit("VERIFIED")) == "PROPOSED").orderBy(F.col(confidence).asc_nulls_first())


def upsert(current: DataFrame, changes: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Rows of both, the changes first; of several changes of a key the first by ``order``. A null key is one like any other.
    Doing it twice changes nothing."""
    latest = changes.withColumn("__place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__place = 1").drop("__place")
    named = latest.select(*[F.col(k).alias(f"__new{i}") for i, k in enumerate(key)])
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"__new{i}"))
    return current.join(named, same, "left_anti").unionByName(latest, allowMissingColumns=True)


def stub_nodes(nodes: DataFrame, edges: DataFrame, key: str = "node", source: str = "src", target: str = "dst") -> DataFrame:
    """Ends of edges that are no nodes yet."""
    ends = edges.select(F.col(source).alias(key)).unionByName(edges.select(F.col(target).alias(key))).distinct()
    return ends.join(nodes.select(key), key, "left_anti")


def reconcile(table: DataFrame, graph: DataFrame, by: str, tolerance: int = 0) -> DataFrame:
    """Counts on both sides for each kind, and whether they agree within the tolerance."""
    a = table.groupBy(by).agg(F.count(F.lit(1)).alias("in_table"))
    b = graph.groupBy(by).agg(F.count(F.lit(1)).alias("in_graph"))
    both = a.join(b, by, "full_outer").fillna(0, ["in_table", "in_graph"])
    return both.withColumn("agrees", F.abs(F.col("in_table") - F.col("in_graph")) <= tolerance)
