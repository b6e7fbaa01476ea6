"""Sentencepiece encoding through a table of distinct chunks, and decoding by an offset table.

Pieces of these models begin with their spaces and hold none after another character, and none holds a line feed beside
another character, so merges cross neither. Texts are cut there into chunks (marked words). Spark counts the distinct
chunks of all texts and each is segmented once. The ids come back by position: the most frequent chunks, up to a number
of bytes, lie in every worker and fill a text's ids in place. Where that holds all that occur twice or more, what is
missing occurs just once, and is segmented where it stands. Where it doesn't, a text keeps gaps for what is missing, those
chunks are joined with the rest of the table, and the ids that a text has got are put into its gaps in order.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.runtime import slices, staged
from docloom.llm.tokencount import SPACE
from docloom.shipping import ship

#: Bytes of the frequent chunks with their ids in each worker, and what an entry takes besides.
HEAD_BYTES, ENTRY = 128 << 20, 24
#: The most frequent of these, in a dictionary.
FIRST = 100_000
#: Characters of a chunk; longer ones hardly recur and are segmented where they stand, or they would swell the table.
LONG_CHUNK = 256
#: Distinct chunks that a task counts before it hands them on.
COUNTED = 500_000
#: A gap among the ids.
GAP = 0xFFFFFFFF
_CHUNKS = re.compile(" +[^ \n]*|\n|[^ \n]+")


def _each_byte(error):
    return "�" * (error.end - error.start), error.end


codecs.register_error("docloom_each_byte", _each_byte)


class Model:
    """The library's segmentation of single chunks, and tables of the pieces' bytes and decimal ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        pieces = [m.id_to_piece(i) for i in ids]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p and len(p) > 1 for p in pieces):
            raise ValueError("pieces of this model cross spaces or line feeds: texts have no safe boundaries there")

        def shown(i: int) -> bytes:
            if m.is_byte(i):
                return bytes([int(pieces[i][3:-1], 16)])
            if m.is_unknown(i):
                return " ⁇ ".encode()
            return b"" if m.is_control(i) else pieces[i].replace(SPACE, " ").encode()

        self.spaced = np.array([p.startswith(SPACE) for p in pieces])
        self.silent = np.array([m.is_control(i) for i in ids])
        self.bytes_of = _Offsets([shown(i) for i in ids])
        self.decimal_of = _Offsets([f"{i},".encode() for i in ids])

    def segment(self, chunks: Sequence[str]) -> list[np.ndarray]:
        """The ids of each chunk. The library puts a space before what it is given: a chunk that begins with one goes without
        it, any other one behind a line feed."""
        given = [c[1:] if c[0] == " " else f"\n{c}" for c in chunks]
        skip = [0 if c[0] == " " else 2 for c in chunks]
        # of a lone space nothing is left, and an empty text has no ids
        lone = self.model.piece_to_id(SPACE)
        return [np.array(ids[k:] if g else [lone], "<u4") for g, k, ids in zip(given, skip, self.model.encode(given, num_threads=1), strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """As the library: special pieces give nothing, a text's first space is the model's own, a byte that is no UTF-8
        gives a replacement character."""
        silent = np.flatnonzero(self.silent[ids])
        # bytes on either side of a special piece aren't read together
        parts = [self.bytes_of.join(p).decode("utf-8", "docloom_each_byte") for p in np.split(ids, silent)]
        shown = "".join(parts)
        heard = ids[~self.silent[ids]][:1]
        return shown[1:] if len(heard) and self.spaced[heard[0]] else shown

    def decimals(self, ids: np.ndarray) -> bytes:
        return self.decimal_of.join(ids)[:-1]


class _Offsets:
    """Byte strings end to end with the start and length of each, so that many are joined at once."""

    def __init__(self, strings: Sequence[bytes]):
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.blob = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        return self.blob[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def chunks(text: str) -> list[str]:
    """The chunks of a text, with the space that the model puts before it: runs of spaces with what follows, line feeds,
    and what follows those."""
    if not text:
        return []
    return _CHUNKS.findall(" " + (text.replace(SPACE, " ") if SPACE in text else text))


def _texts(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))


def count_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """(chunk, n): every distinct chunk of up to ``LONG_CHUNK`` characters and how often it occurs. Tasks sum up before the
    shuffle; the table is written to the shared folder."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["chunk", "n"])

        for batch in batches:
            for _, part in slices(batch.column(0)):
                for t in part:
                    parts = chunks(t)
                    seen.update(parts if not parts or max(map(len, parts)) <= LONG_CHUNK else [c for c in parts if len(c) <= LONG_CHUNK])
                    if len(seen) >= COUNTED:
                        yield handed()
                        seen.clear()
        yield handed()

    found = _texts(docs, text, ()).mapInArrow(count, "chunk string, n long")
    return staged(found.groupBy("chunk").agg(F.sum("n").alias("n")))


def segmented(table: DataFrame, path: str) -> DataFrame:
    """(chunk, n, ids): with the ids of each chunk as little-endian unsigned 32-bit integers."""
    ship(table.sparkSession)

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            ids = m.segment(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([i.tobytes() for i in ids], pa.binary())], names=["chunk", "n", "ids"])

    return table.select("chunk", "n").mapInArrow(segment, "chunk string, n long, ids binary")


class _Head:
    """The frequent chunks of a table, at most about ``limit`` bytes: segmented once and given to every worker.

    Counts are taken in steps of a quarter of a doubling, and a step goes in whole or not at all. ``least`` is the count from
    which chunks are at hand; ``whole`` says that these are all that occur twice or more.
    """

    def __init__(self, table: DataFrame, path: str, limit: int):
        self.name = uuid.uuid4().hex
        steps = table.filter("n > 1").groupBy(F.floor(4 * F.log2("n")).alias("step")).agg(F.sum(F.octet_length("chunk") * 2.5 + ENTRY).alias("bytes"), F.min("n").alias("n"))
        self.whole, self.least, held = True, 1 << 62, 0.0
        for r in steps.orderBy(F.desc("step")).collect():  # four rows for each doubling
            held += r.bytes
            if held > limit:
                self.whole = False
                break
            self.least = r.n
        found = segmented(table.filter(F.col("n") >= self.least), path).orderBy(F.desc("n")).toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, found.schema) as out:
            for batch in found.to_batches(50_000):
                out.write_batch(batch)
        self.sent = table.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())


class _AtHand:
    """A worker's frequent chunks: the first in a dictionary, the others by sorted hashes, compared in full where one meets."""

    def __init__(self, sent: bytes):
        self.first: dict[str, bytes] = {}
        hashes, chunks_, ids = [], [], []
        for batch in pa.ipc.open_stream(sent):
            names, made = batch.column(0), batch.column(2)
            if len(self.first) < FIRST:
                self.first.update(zip(names.to_pylist(), made.to_pylist(), strict=True))
            else:
                hashes.append(np.fromiter(map(hash, names.to_pylist()), np.int64, len(names)))
                chunks_.append(names)
                ids.append(made)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.order = self.hashes[order], order.astype(np.int32)
        strung = lambda parts: _Strung([p.cast(pa.large_binary()) for p in parts])
        self.chunks, self.ids = strung(chunks_), strung(ids)

    def others(self, wanted: list[str]) -> list[bytes | None]:
        """The ids of chunks that aren't among the first; None for those that aren't at hand."""
        if not len(self.hashes):
            return [None] * len(wanted)
        asked = np.fromiter(map(hash, wanted), np.int64, len(wanted))
        at = np.searchsorted(self.hashes, asked)
        same = self.hashes[np.minimum(at, len(self.hashes) - 1)] == asked
        out: list[bytes | None] = [None] * len(wanted)
        met = np.flatnonzero(same)
        rows = self.order[at[met]]
        names, ids = self.chunks.cut(rows), self.ids.cut(rows)
        for i, name, found, k in zip(met.tolist(), names, ids, at[met].tolist(), strict=True):
            raw = wanted[i].encode()
            out[i] = found if name == raw else self.next(raw, k)
        return out

    def next(self, raw: bytes, k: int) -> bytes | None:
        """Among the further chunks of the same hash."""
        h = self.hashes[k]
        while (k := k + 1) < len(self.hashes) and self.hashes[k] == h:
            if self.chunks[self.order[k]] == raw:
                return self.ids[self.order[k]]
        return None


class _Strung:
    """Byte strings end to end."""

    def __init__(self, parts: list[pa.Array]):
        sizes = [pa.compute.binary_length(p).to_numpy() for p in parts]
        self.ends = np.cumsum(np.concatenate([[0], *sizes])).astype(np.int64)
        self.blob = b"".join(b"".join(p.to_pylist()) for p in parts)

    def __getitem__(self, i: int) -> bytes:
        return self.blob[self.ends[i] : self.ends[i + 1]]

    def cut(self, rows: np.ndarray) -> list[bytes]:
        blob = self.blob
        return [blob[a:b] for a, b in zip(self.ends[rows].tolist(), self.ends[rows + 1].tolist(), strict=True)]


_LAST: dict[str, _AtHand] = {}


def _at_hand(name: str, sent) -> _AtHand:
    """The last one stays in a worker for its next tasks."""
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = _AtHand(sent.value)
    return _LAST[name]


class _Filler:
    """Ids of texts by the frequent chunks. Others are segmented in place if they occur once, or else leave gaps."""

    def __init__(self, path: str, known: _AtHand, whole: bool):
        self.model, self.known, self.whole, self.gap = model(path), known, whole, np.array([GAP], "<u4").tobytes()

    def fill(self, texts: Sequence[str]) -> list[tuple[bytes, list[str], list[int]]]:
        """For each text the ids, the distinct chunks that are missing, and which of them stands in each gap."""
        first = self.known.first.get
        parts = [chunks(t) for t in texts]
        found = [list(map(first, p)) for p in parts]
        # what isn't among the first, of all texts at once
        empty = [(k, i) for k, f in enumerate(found) if None in f for i, ids in enumerate(f) if ids is None]
        single: list[tuple[int, int]] = []
        missing: list[dict[str, int]] = [{} for _ in texts]
        gaps: list[list[int]] = [[] for _ in texts]
        for (k, i), ids in zip(empty, self.known.others([parts[k][i] for k, i in empty]), strict=True):
            if ids is not None:
                found[k][i] = ids
            elif self.whole or len(parts[k][i]) > LONG_CHUNK:
                single.append((k, i))
            else:
                gaps[k].append(missing[k].setdefault(parts[k][i], len(missing[k])))
                found[k][i] = self.gap
        if single:
            for (k, i), ids in zip(single, self.model.segment([parts[k][i] for k, i in single]), strict=True):
                found[k][i] = ids.tobytes()
        return [(b"".join(f), list(m), g) for f, m, g in zip(found, missing, gaps, strict=True)]


def _key(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def _mapped(docs: DataFrame, path: str, text: str, keep: Sequence[str], out: Sequence[tuple[str, str]], made) -> DataFrame:
    """Columns of ``keep`` and of ``out``, which ``made(model)`` gives for a list of id arrays."""
    ship(docs.sparkSession)
    keep = [c for c in keep if c not in {n for n, _ in out}]
    table = count_chunks(docs, text)
    head = _Head(table, path, HEAD_BYTES)
    name, sent, all_at_hand = head.name, head.sent, head.whole
    narrow = _texts(docs, text, keep)
    types = [{"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}[t] for _, t in out]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    fields = ", ".join(x for x in (kept, *(f"`{n}` {t}" for n, t in out)) if x)
    names = [*keep, *(n for n, _ in out)]

    def results(rows: pa.RecordBatch, ids: list[np.ndarray], make) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], *(pa.array(v, t) for v, t in zip(make(ids), types, strict=True))], names=names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler, make = _Filler(path, _at_hand(name, sent), all_at_hand), made(model(path))
        for batch in batches:
            for start, part in slices(batch.column(batch.num_columns - 1)):
                yield results(batch.slice(start, len(part)), [np.frombuffer(ids, "<u4") for ids, _, _ in filler.fill(part)], make)

    if head.whole:
        return narrow.mapInArrow(whole, fields)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler = _Filler(path, _at_hand(name, sent), all_at_hand)
        for batch in batches:
            for _, part in slices(batch.column(0)):
                keys, places, missing = [], [], []
                for t, (_, one, _) in zip(part, filler.fill(part), strict=True):
                    missing += one
                    places += range(len(one))
                    keys += [_key(t)] * len(one) if one else []
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(places, pa.int32()), pa.array(missing, pa.string())], names=["key", "place", "chunk"])

    def with_gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler, n = _Filler(path, _at_hand(name, sent), all_at_hand), 0
        pack = pa.Codec("zstd", 1).compress
        for batch in batches:
            for start, part in slices(batch.column(batch.num_columns - 1)):
                keys, ids, gaps = [], [], []
                for t, (filled, missing, at) in zip(part, filler.fill(part), strict=True):
                    n += 1
                    # a text without gaps meets nothing: any key that isn't a digest spreads such texts out
                    keys.append(_key(t) if missing else n.to_bytes(8, "little"))
                    ids.append(len(filled).to_bytes(8, "little") + pack(filled, asbytes=True))
                    gaps.append(np.array(at, "<u4").tobytes())
                rows = batch.slice(start, len(part))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(keys, pa.binary()), pa.array(ids, pa.binary()), pa.array(gaps, pa.binary())], names=[*keep, "__key", "__ids", "__gaps"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = made(model(path))
        unpack = pa.Codec("zstd").decompress
        for batch in batches:
            held, gaps, got = (batch.column(len(keep) + i).to_pylist() for i in range(3))
            for start in range(0, batch.num_rows, 256):
                ids = []
                for k in range(start, min(start + 256, batch.num_rows)):
                    one = np.frombuffer(unpack(held[k][8:], int.from_bytes(held[k][:8], "little"), asbytes=True) if len(held[k]) > 8 else b"", "<u4")
                    if gaps[k]:
                        holes = np.flatnonzero(one == GAP)
                        parts = np.split(one, np.sort(np.concatenate((holes, holes + 1))))  # stretches and gaps in turn
                        parts[1::2] = [np.frombuffer(got[k][p], "<u4") for p in np.frombuffer(gaps[k], "<u4")]
                        one = np.concatenate(parts)
                    ids.append(one)
                yield results(batch.slice(start, len(ids)), ids, make)

    lacking = _texts(docs, text, ()).mapInArrow(asked, "key binary, place int, chunk string")
    found = lacking.join(segmented(table.filter(F.col("n") < head.least), path).drop("n"), "chunk").groupBy("key").agg(F.array_sort(F.collect_set(F.struct("place", "ids"))).alias("__got"))
    found = found.select(F.col("key").alias("__got_key"), F.transform("__got", lambda g: g["ids"]).alias("__got"))
    held = narrow.mapInArrow(with_gaps, ", ".join(x for x in (kept, "__key binary, __ids binary, __gaps binary") if x))
    met = held.join(found, F.col("__key") == F.col("__got_key"), "left")
    return met.select(*[F.col(f"`{c}`") for c in keep], "__ids", "__gaps", "__got").mapInArrow(filled, fields)


def encode_texts(docs: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns of ``keep``, the ids of each whole text (``ids``) and the text that they decode to (``decoded``).

    Null and empty texts have no ids and decode to the empty text. Repeated rows stay, null keys too; an empty table gives
    an empty one. Where names clash, those of the results win.
    """
    return _mapped(docs, path, text, keep, [("ids", "array<long>"), ("decoded", "string")], lambda m: lambda ids: ([i.astype(np.int64) for i in ids], [m.decode(i) for i in ids]))


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns of ``keep``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas) and ``decoded_sha256``.

    As ``encode_texts``, but only digests leave the worker.
    """
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def made(m: Model):
        return lambda ids: ([len(i) for i in ids], [sha(m.decimals(i)) for i in ids], [sha(m.decode(i).encode()) for i in ids])

    return _mapped(docs, path, text, keep, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], made)
