"""Arrays in JSON files of any size: a file is split, and its parts are read by different tasks.

Whether a place lies within a string, and how deep, depends on all that stands before it. So each part first tells what
it does from either beginning, within a string or outside, to any depth; the driver passes over these figures, a row for
each part; and with what then is known at its start, each part gives the elements that begin and end in it. An element
that goes over parts is put together from its pieces, and only such pieces are shuffled. Lines end at ``}``, which never
follows a backslash that counts, so no escape is cut. The file is read twice, and three times if it has several parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.shipping import ship

END = "}"
QUOTES = re.compile(r'\\.|"', re.S)
MARKS = re.compile(r"[\[\]{},]")
#: How a level was last opened in a part: not at all, as an object, as an array, as the array under the asked name.
NOT, OBJECT, ARRAY, NAMED = -1, 0, 1, 2
#: Elements that a task hands on at a time, and characters of them after which it does so anyway.
HANDED, HANDED_CHARACTERS = 4096, 8 << 20


def _between_quotes(line: str) -> list[str]:
    if "\\" not in line:
        return line.split('"')
    cuts = [m.start() for m in QUOTES.finditer(line) if m.group() == '"']
    return [line[a + 1 : b] for a, b in zip([-1, *cuts], [*cuts, len(line)], strict=True)]


def _opened(mark: str, before: str, name: str, member: str | None) -> int:
    """How ``mark`` opens a level, by what stands before it since the last string, and that string."""
    if mark == "{":
        return OBJECT
    return NAMED if member is not None and name == member and before.strip() == ":" else ARRAY


@dataclass
class _Half:
    """What a part does if it begins at depth 0: depth at the end; for each level how it was last opened, and commas since."""

    depth: int = 0
    levels: dict[int, list[int]] = field(default_factory=dict)

    def read(self, run: str, name: str, member: str | None) -> None:
        for m in MARKS.finditer(run):
            mark = m.group()
            if mark == ",":
                self.levels.setdefault(self.depth, [NOT, 0])[1] += 1
            elif mark in "[{":
                self.depth += 1
                self.levels[self.depth] = [_opened(mark, run[: m.start()], name, member), 0]
            else:
                self.depth -= 1


@dataclass
class _Part:
    octets: int = 0
    lines: int = 0
    first: str = ""
    inside: bool = False
    last: str = ""
    halves: tuple[_Half, _Half] = field(default_factory=lambda: (_Half(), _Half()))

    def read(self, line: str, member: str | None) -> None:
        """``inside`` is for a part that begins outside of a string; otherwise it is the opposite throughout."""
        self.first = self.first or line.lstrip("﻿ \t\r\n")[:1]
        for i, run in enumerate(_between_quotes(line)):
            if i:
                self.inside = not self.inside
                self.halves[self.inside].read(run, self.last, member)
            else:
                self.halves[self.inside].read(run, "", member)
            self.last = run


SUMMARY = "path string, block long, size long, octets long, lines long, first string, inside boolean, halves array<struct<depth: int, levels: array<struct<level: int, opened: int, commas: long>>>>"
_LEVEL = pa.struct([("level", pa.int32()), ("opened", pa.int32()), ("commas", pa.int64())])
_HALF = pa.struct([("depth", pa.int32()), ("levels", pa.list_(_LEVEL))])


def _by_part(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Array]]:
    """Lines under their part's columns: those of a part stand together, in their order."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        change = table.select(range(keys)).to_pydict()
        rows = list(zip(*change.values(), strict=True))
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[start]:
                yield rows[start], batch.column(keys).slice(start, i - start)
                start = i


def _told(member: str | None):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part = None, None

        def row():
            halves = [{"depth": h.depth, "levels": [{"level": n, "opened": o, "commas": c} for n, (o, c) in h.levels.items()]} for h in part.halves]
            values = [*key, part.octets, part.lines, part.first, part.inside, halves]
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(_HALF)]
            names = ["path", "block", "size", "octets", "lines", "first", "inside", "halves"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        for k, lines in _by_part(batches, 3):
            if k != key:
                if part is not None:
                    yield row()
                key, part = k, _Part()
            part.octets += pa.compute.sum(pa.compute.binary_length(lines)).as_py() or 0
            part.lines += len(lines)
            for line in lines.to_pylist():
                part.read(line + END, member)
        if part is not None:
            yield row()

    return over


class _Elements:
    """Elements of the wanted array in a part whose beginning is known: (place, value, whether whole, whether at the array's end)."""

    def __init__(self, inside: bool, depth: int, level: int, wanted: bool, commas: int, member: str | None):
        self.inside, self.depth, self.level, self.wanted, self.commas, self.member = inside, depth, level, wanted, commas, member
        self.held, self.whole, self.name = [], False, ""

    def _close(self, rest: str, at_end: bool) -> tuple[int, str, bool, bool]:
        value, whole = "".join([*self.held, rest]), self.whole
        self.held, self.whole = [], True
        return self.commas, value, whole, at_end

    def read(self, line: str) -> Iterator[tuple[int, str, bool, bool]]:
        at, begin = 0, 0
        for i, run in enumerate(_between_quotes(line)):
            if i:
                at, self.inside = at + 1, not self.inside
            else:
                self.name = ""
            for m in () if self.inside else MARKS.finditer(run):
                mark, here = m.group(), at + m.start()
                if mark in "[{":
                    self.depth += 1
                    if self.depth == self.level:
                        opened = _opened(mark, run[: m.start()], self.name, self.member)
                        self.wanted = wants(opened, self.level)
                        self.commas, self.held, self.whole, begin = 0, [], True, here + 1
                elif self.depth != self.level:
                    self.depth -= mark != ","
                elif mark == ",":
                    if self.wanted:
                        yield self._close(line[begin:here], False)
                    self.commas, begin = self.commas + 1, here + 1
                else:
                    if self.wanted:
                        yield self._close(line[begin:here], True)
                    self.wanted, self.depth = False, self.depth - 1
            at += len(run)
            self.name = run
        if self.wanted:
            self.held.append(line[begin:])

    def rest(self) -> Iterator[tuple[int, str, bool, bool]]:
        if self.wanted and self.held:
            yield self.commas, "".join(self.held), False, False


def wants(opened: int, level: int) -> bool:
    return opened == NAMED if level == 2 else opened >= ARRAY


def _given(member: str | None, whole: bool):
    names = ["path", "block", "place", "value", "at_end"]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, out, size = None, None, [], 0

        def batch():
            columns = zip(*out, strict=True)
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        def take(found):
            nonlocal size
            for place, value, complete, at_end in found:
                if complete == whole:
                    out.append((key[0], key[1], place, value, at_end))
                    size += len(value)

        for k, lines in _by_part(batches, 7):
            if k != key:
                if part is not None:
                    take(part.rest())
                key, part = k, _Elements(*k[2:], member)
            for line in lines.to_pylist():
                take(part.read(line + END))
                if len(out) >= HANDED or size > HANDED_CHARACTERS:
                    yield batch()
                    out, size = [], 0
        if part is not None:
            take(part.rest())
        if out:
            yield batch()

    return over


def _beginnings(parts: list, member: str | None) -> tuple[list[tuple], str | None]:
    """(path, block, inside, depth, level, wanted, commas) for each part of a file, in order, and what is wrong with the file.

    Whether the file ends in ``}`` shows in its size; where it doesn't, the one read after its last line is one too many.
    """
    first = next((p.first for p in parts if p.first), "")
    level = 1 if first == "[" else 2
    found, inside, depth, wanted, commas = [], False, 0, False, 0
    for p in parts:
        found.append((p.path, p.block, inside, depth, level, wanted and depth >= level, commas))
        half = p.halves[inside]
        at = {n.level: n for n in half.levels}.get(level - depth)
        if at is not None:
            if at.opened != NOT:
                wanted, commas = wants(at.opened, level), 0
            commas += at.commas
        inside, depth = inside != p.inside, depth + half.depth
    over = sum(p.octets + p.lines for p in parts) - parts[0].size
    ends = {1: (-1,), -2: (-1,), 0: (0,), -3: (0,)}.get(over, (0, -1))  # a byte-order mark is three bytes; sizes of packed files tell nothing
    fault = "not JSON" if inside or depth not in ends or first not in ("[", "{") else "not an array" if member is None and first != "[" else None
    return found, fault


def elements(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """(input_file, place, value): elements of the array that each file holds, as JSON text, with their places from 0.

    With ``member`` a file may also hold an object with the array under that name; one without it gives no rows. Without,
    every file must hold an array. A file that is empty, ends too early or holds something else ends the call; an element
    that is no JSON is the reader's to find. What stands in an object outside of the array is looked at for balance only.
    Names with escapes aren't recognised. An array may be of any length; an element is a row and must fit one.
    """
    ship(spark)
    lines = spark.read.option("lineSep", END).text(path)
    meta = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    told = lines.select(*meta, F.col("_metadata.file_size").alias("size"), "value").mapInArrow(_told(member), SUMMARY).collect()  # a row for each part of a file
    files: dict[str, list] = {}
    for p in sorted(told, key=lambda p: (p.path, p.block)):
        files.setdefault(p.path, []).append(p)
    known, several = [], False
    for name, parts in files.items():
        found, fault = _beginnings(parts, member)
        if fault:
            raise ValueError(f"{fault}: {name}")
        known += found
        several |= len(parts) > 1
    if len(files) < len(lines.inputFiles()):
        raise ValueError(f"not JSON: an empty file in {path}")
    starts = spark.createDataFrame(known, "__path string, __block long, inside boolean, depth int, level int, wanted boolean, commas long")
    here = lines.select(*meta, "value").join(F.broadcast(starts), (F.col("path") == F.col("__path")) & (F.col("block") == F.col("__block")))
    here = here.select("path", "block", "inside", "depth", "level", "wanted", "commas", "value")
    schema = "path string, block long, place long, value string, at_end boolean"
    rows = here.mapInArrow(_given(member, True), schema).drop("block")
    if several:
        pieces = here.mapInArrow(_given(member, False), schema).groupBy("path", "place")
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "value"))), lambda p: p["value"]), "")
        rows = rows.unionByName(pieces.agg(joined.alias("value"), F.max("at_end").alias("at_end")).select("path", "place", "value", "at_end"))
    rows = rows.filter(~(F.col("at_end") & (F.col("place") == 0) & ~F.col("value").rlike(r"[^ \t\r\n]")))  # an array without elements
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("input_file"), "place", "value")
