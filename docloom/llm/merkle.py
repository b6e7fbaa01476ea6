"""A Merkle manifest of a table: a tree of digests for each group, and one over the groups, with a proof for every row.

The trees are climbed in supersteps over RDDs. A vertex is a subtree of up to ``FAN ** levels`` neighbouring nodes: it
gets the digests of the nodes below as messages, and once they are there it hashes them level by level and sends its own
digest to the subtree above. In the supersteps back, a subtree gets the siblings on the way from its top to the root and
hands them on to each subtree below, with those that lie inside itself. So a row's digest is shuffled once, whatever the
height of its tree, the subtrees above are fewer by a factor of ``FAN ** levels`` each time, and no group is held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.shared import cut, few, numbered
from docloom.shipping import ship

#: Children of a node.
FAN = 3
#: Levels that a superstep climbs; a subtree has at most ``FAN ** LEVELS`` nodes at its foot.
LEVELS = 6


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Of values as text, each by its number of bytes, a colon and itself, or a hyphen if it is null."""
    each = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*each), 256)


def climb(nodes: Sequence[str], n: int, levels: int) -> list[list[str]]:
    """The levels of a subtree, from its foot up; ``n`` is the number of nodes at that level of the whole tree.

    ``FAN`` neighbours become one node, also where the last of them are fewer, until a tree is a single node.
    """
    made = [list(nodes)]
    for _ in range(levels):
        if n == 1:
            break
        below = made[-1]
        made.append([digest(*below[i : i + FAN]) for i in range(0, len(below), FAN)])
        n = -(-n // FAN)
    return made


def siblings(made: Sequence[Sequence[str]], at: int) -> list[tuple[str, str]]:
    """For the node ``at`` the foot of a subtree: what stands before and after it and each node above it among siblings."""
    path = []
    for below in made[:-1]:
        first = at - at % FAN
        path.append(("".join(below[first:at]), "".join(below[at + 1 : first + FAN])))
        at //= FAN
    return path


def fold(leaf: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in path:
        leaf = digest(before, leaf, after)
    return leaf


def _over(n: int, levels: int) -> int:
    """Nodes that are left of ``n`` after a superstep."""
    for _ in range(levels):
        n = -(-n // FAN)
    return n


class Forest:
    """Trees over (tree, place, n, digest, row) with places from 0, ``n`` leaves to a tree; ``row`` comes back with the proof."""

    def __init__(self, leaves: RDD, largest: int, partitions: int, levels: int = LEVELS):
        self.levels, self.parts = levels, partitions
        wide = FAN**levels

        def dealt(rows: Iterator[tuple]) -> Iterator[tuple]:
            # neighbours that are at hand together travel as one message
            for (tree, block, n), few_rows in groupby(rows, lambda r: (r[0], r[1] // wide, r[2])):
                for _, part in groupby(enumerate(few_rows), lambda x: x[0] // wide):
                    yield (tree, block), (n, [(r[1], r[3], r[4]) for _, r in part])

        def met(messages) -> tuple:
            messages = list(messages)
            nodes = sorted((x for _, part in messages for x in part), key=lambda x: x[0])
            return messages[0][0], [x[1] for x in nodes], [x[2] for x in nodes]

        def above(item) -> tuple:
            (tree, block), (n, nodes, _) = item
            return tree, block, _over(n, levels), climb(nodes, n, levels)[-1][0], None

        self.blocks: list[RDD] = []
        self.tops: list[RDD] = []  # of each superstep: the trees that it completes
        n, level = largest, leaves
        while True:
            blocks = level.mapPartitions(dealt).groupByKey(self.parts).mapValues(met)
            self.blocks.append(blocks)
            sent = blocks.map(above)
            self.tops.append(sent.filter(lambda m: m[2] == 1).map(lambda m: (m[0], m[3])))
            if _over(n, levels) <= 1:
                break
            n, level = _over(n, levels), sent.filter(lambda m: m[2] > 1)

    def roots(self) -> RDD:
        """(tree, root)"""
        return self.tops[0].context.union(self.tops)

    def proofs(self, beyond: RDD | None = None) -> RDD:
        """(row, digest, root of the tree, path, what was beyond) of each leaf.

        ``beyond`` has (tree, (path, anything)): siblings from the tree's root on, which are put behind those inside.
        """
        levels, wide = self.levels, FAN**self.levels
        coming = None
        for step in reversed(range(len(self.blocks))):
            ended = self.tops[step]
            ended = ended.mapValues(lambda root: (root, ([], None))) if beyond is None else ended.join(beyond, self.parts)
            here = ended.map(lambda t: ((t[0], 0), (t[1][0], *t[1][1])))
            coming = here if coming is None else here.union(coming)

            def down(item) -> Iterator[tuple]:
                (tree, block), ((n, nodes, rows), (root, path, more)) = item
                made = climb(nodes, n, levels)
                for at, (node, row) in enumerate(zip(nodes, rows, strict=True)):
                    yield (tree, block * wide + at), node, row, root, siblings(made, at) + path, more

            told = self.blocks[step].join(coming, self.parts).flatMap(down)
            if step:
                coming = told.map(lambda t: (t[0], (t[3], t[4], t[5])))
        return told.map(lambda t: (t[2], t[1], t[3], t[4], t[5]))


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), by: str = "source", key: str = "doc_id", tampered: tuple[str, Column, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified): a row's digest, those of its group and of the table,
    the digest of its siblings on the way up, and the root that they give with the row as it is now.

    ``columns`` are what a leaf covers. Groups are the values of ``by``, a null one too, in the order of their bytes with
    null first; a group's leaves ascend by ``key`` with null first, then by their digests, so repeated rows are leaves each,
    and which of two equal ones comes first makes no difference. ``tampered`` (column, which rows, the value they have now)
    stands for a changed copy of the table that is checked against the manifest. An empty table gives an empty one.

    Texts are read once, and only digests are sorted, shuffled and written.
    """
    spark = docs.sparkSession
    ship(spark)
    at = lambda c: F.col(f"`{c}`")
    now = F.lit(None).cast("string")
    if tampered is not None:
        column, which, value = tampered
        now = F.when(which, leaf_digest([value if c == column else at(c) for c in columns]))
    leaves = cut(docs.select(at(key).alias("__key"), at(by).cast("string").alias("__by"), leaf_digest([at(c) for c in columns]).alias("__leaf"), now.alias("__now")))
    order = [F.col("__by").asc_nulls_first(), F.col("__key").asc_nulls_first(), F.col("__leaf")]
    placed = numbered(leaves.withColumn("__row", F.monotonically_increasing_id()), *order, F.col("__row"), name="__place")
    groups = leaves.groupBy("__by").agg(F.count(F.lit(1)).alias("__n"))
    groups = numbered(groups, F.col("__by").asc_nulls_first(), name="__tree")
    # where a group begins: the least place of its rows
    groups = cut(groups.join(placed.groupBy(F.col("__by").alias("__b")).agg(F.min("__place").alias("__first")), F.col("__by").eqNullSafe(F.col("__b"))).drop("__b"))
    figures = groups.agg(F.count(F.lit(1)).alias("trees"), F.max("__n").alias("largest")).first()
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not figures.trees:
        return spark.createDataFrame([], schema)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = groups.withColumnRenamed("__by", "__b")
    rows = placed.join(few(groups), F.col("__by").eqNullSafe(F.col("__b"))).select("__tree", (F.col("__place") - F.col("__first")).alias("__at"), "__n", "__leaf", F.struct("__key", "__now").alias("__own"))
    trees = Forest(rows.rdd.map(tuple), figures.largest, parts, levels)
    whole = Forest(trees.roots().map(lambda r: (r[0] - 1, r[0] - 1, figures.trees, r[1], r[0])).map(lambda r: (0, *r[1:])), figures.trees, parts, levels)
    beyond = whole.proofs().map(lambda p: (p[0], (p[3], p[2])))

    def proved(item) -> tuple:
        (own, now_), leaf, subroot, path, root = item
        found = fold(now_ or leaf, path)
        return own, leaf, subroot, root, digest(*(b + a for b, a in path)), found, found == root

    return spark.createDataFrame(trees.proofs(beyond).map(proved), schema, verifySchema=False)
