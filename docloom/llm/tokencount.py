"""Token counts of whole texts by a sentencepiece model, lengths only.

A piece of these models begins with its spaces and never holds a space after another character, so the place
before a run of spaces is a safe boundary: no merge crosses it. Texts are cut there into units, units that a
worker hasn't met are encoded in batches of about equal bytes, and a text's count is the sum over its units.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import groupby

from pyspark.sql import DataFrame

from docloom.llm.runtime import map_texts

#: Bytes of new units in one call of the library.
BATCH_BYTES = 1 << 20
#: Bytes of units that a worker remembers before it starts anew, besides those of the texts at hand, and of an entry.
MEMORY, ENTRY = 64 << 20, 200
#: Fixed value: the sign that stands for a space inside such models.
SPACE = "▁"


class Counter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("pieces of this model cross spaces: texts have no safe boundaries there")
        self.known, self.held = {"": 1}, 0  # a single space at the end

    def units(self, text: str) -> list[str]:
        """The text cut before each run of spaces; a unit's first space is left out, as the model adds it."""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " in text or text[-1:] == " " or text[:1] == " ":
            return [u[1:] for u in re.findall(" +[^ ]*", f" {text}")]
        return text.split(" ")

    def learn(self, new: list[str]) -> None:
        """Encode new units, in batches of about equal bytes."""
        held, batch = 0, 0
        dealt = []
        for u in new:
            dealt.append((batch, u))
            size = len(u.encode())
            held += size + 1
            self.held += size + ENTRY
            if held >= BATCH_BYTES:
                held, batch = 0, batch + 1
        for _, part in groupby(dealt, lambda x: x[0]):
            part = [u for _, u in part]
            self.known.update(zip(part, map(len, self.model.encode(part, num_threads=1)), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        if self.held > MEMORY:
            self.known, self.held = {"": 1}, 0
        cut = [self.units(t) if t else [] for t in texts]
        new = {u for units in cut for u in units if u not in self.known}
        if new:
            self.learn(sorted(new))
        known = self.known.__getitem__
        return [sum(map(known, units)) for units in cut]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Columns of ``keep``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of each whole text.

    Null texts count as empty: 0 tokens. Repeated rows stay; an empty table gives an empty one.
    """

    def start():
        c = counter(path)

        def run(texts):
            n = c.count(texts)
            return [len(t.encode()) for t in texts], n, [x > limit for x in n]

        return run

    return map_texts(docs, start, [("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")], text, keep)
