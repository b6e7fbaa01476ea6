"""Running values over arrays, as Column expressions: linear in the array, and without leaving the row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block. A fold copies what it has made so far at each element, so it goes over blocks of this size.
BLOCK = 256


#: Bytes of texts, or elements of lists, that an Arrow function takes apart at a time.
TAKEN = 1 << 20


def pieces(column: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """A column of texts or lists in slices of about ``most`` bytes or elements: what is taken apart as Python objects stays small,
    however many rows a batch has."""
    most = TAKEN if most is None else most
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_list(column.type) else np.int32)[column.offset :][: len(column) + 1] if len(column) else np.zeros(1, np.int32)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + most, "right")) - 1)
        yield column.slice(at, end - at)
        at = end


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cut(items: Column, size: int) -> Column:
    """An array of at least one element as an array of blocks."""
    count = F.floor((F.size(items) + (size - 1)) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(items, i * size + 1, F.lit(size)))


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states of a fold after each element: as many as there are elements. A null array gives null.

    The type of ``zero`` must be that of the states.
    """

    def add(states: Column, item: Column) -> Column:
        return F.concat(states, F.array(step(F.element_at(states, -1), item)))

    def over(found: Column, block: Column) -> Column:
        last = F.element_at(F.element_at(found, -1), -1)
        return F.concat(found, F.array(F.aggregate(block, F.array(last), add, lambda s: F.slice(s, 2, F.size(block)))))

    def whole(every: Column) -> Column:
        # a slice costs as much as the array it is cut from, so blocks are cut from larger blocks
        blocks = F.flatten(F.transform(_cut(every, BLOCK * BLOCK), lambda part: bound(part, lambda p: _cut(p, BLOCK))))
        states = F.aggregate(blocks, F.array(F.array(zero)), over, lambda s: F.flatten(F.slice(s, 2, F.size(s))))
        return F.when(F.size(every) > 0, states).when(every.isNotNull(), F.slice(F.array(zero), 1, 0))

    return bound(items, whole)


def running_sum(numbers: Column, kind: str = "int") -> Column:
    return scan(numbers, F.lit(0).cast(kind), lambda total, x: (total + x).cast(kind))
