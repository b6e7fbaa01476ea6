"""Texts and blocks of HTML pages, by the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.shipping import arrow_function, ship

#: Elements that make a block, those whose content is no text, and those that have no end.
BLOCKS = frozenset(("p", "div", "table", "ol", "ul", "li", "tr", "td", "th"))
HIDDEN = frozenset(("script", "style", "link", "meta"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))


class _Reader(HTMLParser):
    """Collects text pieces, those of outermost blocks apart, the title and the first strong text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.blocks: list[tuple[str, list[str]]] = []
        self.open: list[str] = []
        self.depth_of_block = -1
        self.hidden = 0
        self.title: list[str] = []
        self.strong: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self._text("\n")
        if tag in HIDDEN and tag not in VOID:
            self.hidden += 1
        if tag in VOID:
            return
        if tag in BLOCKS and self.depth_of_block < 0:
            self.depth_of_block = len(self.open)
            self.blocks.append((tag, []))
        self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open:
                last = self.open.pop()
                if last in HIDDEN:
                    self.hidden -= 1
                if len(self.open) == self.depth_of_block:
                    self.depth_of_block = -1
                if last == tag:
                    break

    def handle_data(self, data):
        self._text(data)

    def _text(self, data):
        if self.hidden:
            return
        if "title" in self.open:
            self.title.append(data)
        elif "strong" in self.open and len(self.strong) < 1:
            self.strong.append(data)
        self.pieces.append(data)
        if self.depth_of_block >= 0:
            self.blocks[-1][1].append(data)


def _joined(pieces: list[str], by: str = " ") -> str:
    return re.sub(r"\s+", " ", by.join(p.strip() for p in pieces if p.strip())).strip()


def read(html: str | None) -> _Reader:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader


def _text(c: pd.Series) -> pd.Series:
    return c.map(lambda t: None if t is None else _joined(read(t).pieces))


def _lines(c: pd.Series) -> pd.Series:
    return c.map(lambda t: None if t is None else "\n".join(x for p in read(t).pieces for x in map(str.strip, p.split("\n")) if x))


def _title(c: pd.Series) -> pd.Series:
    def one(t):
        r = read(t)
        return _joined(r.title) or _joined(r.strong) or "Document"

    return c.map(one)


def html_text(c: Column) -> Column:
    """All text of a page, pieces joined by spaces. Null pages give null."""
    return arrow_function(_text, "string")(c)


def html_lines(c: Column) -> Column:
    """All text of a page, pieces on lines of their own."""
    return arrow_function(_lines, "string")(c)


def html_title(c: Column) -> Column:
    """The title, else the first strong text, else "Document"."""
    return arrow_function(_title, "string")(c)


def html_blocks(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Rows (key, place, tag, text) of the outermost blocks with text, in order; what lies in a block isn't parted."""
    ship(pages.sparkSession)
    narrow = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, t in zip(frame["key"], frame["html"], strict=True):
                for place, (tag, pieces) in enumerate(read(t).blocks, 1):
                    text = _joined(pieces)
                    if text:
                        rows.append((k, place, tag, text))
            yield pd.DataFrame(rows, columns=["key", "place", "tag", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return narrow.filter(F.col("key").isNotNull()).mapInPandas(over, f"key {kind}, place int, tag string, text string").withColumnRenamed("key", key)
