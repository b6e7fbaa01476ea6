"""Byte-pair encoding by backtracking over longest token matches, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary finds the longest token at every byte of a piece. Tokens are laid
down greedily; a token may follow another only if the two are compatible, that is if the merges of their joined
bytes give just these two tokens. Where no token fits, the last one is taken back and shortened. A sequence whose
neighbours are all compatible is the one that the merges give, so the result is exact, and each byte position is
given up at most once, so the time is linear in the piece.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from docloom.llm.runtime import map_texts

#: Fixed value: the published pattern that splits text before the merges of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of pieces and their encodings that a worker remembers before it starts anew; longer pieces aren't remembered.
MEMORY, LONG_PIECE = 64 << 20, 1 << 10
#: Bytes that an entry takes besides.
ENTRY = 200
#: Compatible pairs that a worker remembers; then it starts anew.
PAIRS = 1_000_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class _Memo(dict):
    """Encodings of pieces, made on first sight."""

    def __init__(self, make):
        super().__init__()
        self.make, self.held = make, 0

    def __missing__(self, piece):
        made = self.make(piece)
        if len(piece) <= LONG_PIECE:
            if self.held >= MEMORY:
                self.clear()
                self.held = 0
            self[piece] = made
            self.held += ENTRY + 4 * len(piece) + len(made)
        return made


class Codec:
    """Encoder and decoder for one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = {letter: b for b, letter in enumerate(byte_letters())}
        ids = spec["model"]["vocab"]
        raw = {i: bytes(of[c] for c in t) for t, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        raw |= {i: t.encode() for t, i in self.special.items()}
        n = max(raw) + 1
        self.bytes_of = [raw.get(i, b"") for i in range(n)]
        # offset table: all tokens end to end, with the start and length of each
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.length = self.lengths.tolist()
        self.rank = [-1] * n  # of the merge that makes a token; -1 for single bytes
        self.left, self.right = list(range(n)), list(range(n))
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j, k = ids[a], ids[b], ids[a + b]
            self.merged[i, j] = r, k
            if self.rank[k] < 0 and len(self.bytes_of[k]) > 1:
                self.rank[k], self.left[k], self.right[k] = r, i, j
        trie = ahocorasick.Automaton()
        for i in ids.values():
            if len(raw[i]) == 1 or self.rank[i] >= 0:
                trie.add_word(raw[i].decode("latin-1"), i)
        trie.make_automaton()
        self.trie = trie
        key = {raw[i]: i for i in ids.values()}
        self.shorter = [-1] * n  # the longest token that a token properly starts with
        for i in ids.values():
            b = raw[i]
            self.shorter[i] = next((key[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in key), -1)
        self.compatible: dict[int, bool] = {}
        self.memo = _Memo(lambda piece: array("I", self.encode_piece(piece.encode())).tobytes())
        self.pieces = regex.compile(SPLIT).findall
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges of the joined bytes of two tokens give the two tokens.

        Merges go by rank. Going back in time from the finished tokens, the last part of ``a`` meets the first
        part of ``b``; if their own merge has a lower rank than the merge that next swallows either of them,
        it comes first and the two tokens never arise. Of equal merges the leftmost comes first.
        """
        key = a << 32 | b
        known = self.compatible.get(key)
        if known is not None:
            return known
        x, y, before = a, b, float("inf")
        rank, left, right, merged = self.rank, self.left, self.right, self.merged
        while True:
            met = merged.get((x, y))
            if met and met[0] < before:
                ok = False
                break
            rx, ry = rank[x], rank[y]
            if rx < 0 and ry < 0:
                ok = True
                break
            if rx > ry:
                x, before = right[x], rx  # undone: the merge within a, which stands to the left of the meeting pair
            else:
                y, before = left[y], ry + 0.5
        if len(self.compatible) >= PAIRS:
            self.compatible.clear()
        self.compatible[key] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        n, length, shorter, fits = len(piece), self.length, self.shorter, self.fits
        longest = [-1] * n
        for end, i in self.trie.iter(piece.decode("latin-1")):
            start = end + 1 - length[i]
            if longest[start] < 0 or length[longest[start]] < length[i]:
                longest[start] = i
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0] if n else -1
        while at < n:
            while token >= 0 and (dead[at + length[token]] or out and not fits(out[-1], token)):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        return out

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known = self.memo.__getitem__
        if self.marks and any(s in text for s in self.special):
            parts = []
            for k, part in enumerate(self.marks.split(text)):
                parts.append(array("I", [self.special[part]]).tobytes() if k % 2 else b"".join(map(known, self.pieces(part))))
            return b"".join(parts)
        return b"".join(map(known, self.pieces(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids) -> bytes:
        """The bytes of ids, gathered from the offset table."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        return self.blob[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(docs: DataFrame, path: str, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Columns of ``keep``, the ids of each whole text (``ids``) and the text that they decode to (``decoded``).

    Null and empty texts have no ids. Repeated rows stay; an empty table gives an empty one.
    """

    def start():
        c = codec(path)

        def run(texts):
            ids = [np.frombuffer(c.encode_bytes(t), "<u4") for t in texts]
            return [i.astype(np.int64) for i in ids], [c.decode(i) for i in ids]

        return run

    return map_texts(docs, start, [("ids", "array<long>"), ("decoded", "string")], text, keep)


def round_trip(docs: DataFrame, path: str, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Columns of ``keep``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each whole text.

    As ``encode_texts``, but only digests leave the worker. Null texts count as empty.
    """

    def start():
        c = codec(path)

        def run(texts):
            n, a, b = [], [], []
            for t in texts:
                raw = c.encode_bytes(t)
                n.append(len(raw) // 4)
                a.append(hashlib.sha256(raw).hexdigest())
                b.append(hashlib.sha256(c.decode(np.frombuffer(raw, "<u4")).encode()).hexdigest())
            return n, a, b

        return run

    return map_texts(docs, start, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], text, keep)
