"""Media columns: signature sniffing, validation, type correction, carving, and a lossless sample form.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass. At each hit a validator of the format
walks its structure (chunks, blocks, segments, lengths, checksums) and gives the length of the file, or refuses.
A valid file at the start fixes the type of the column value, whatever was declared; valid files further in, inside
others too, are carved out as embedded media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.runtime import SLICE_BYTES, SLICE_ROWS, map_texts, ship

#: The first bytes of each format.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "png",
    b"GIF87a": "gif",
    b"GIF89a": "gif",
    b"\xff\xd8\xff": "jpeg",
    b"BM": "bmp",
    b"RIFF": "riff",
    b"fLaC": "flac",
    b".snd": "au",
}
#: The sample rate and the channels of the stored form.
RATE, CHANNELS = 16_000, 1
#: Payloads are padded to a positive multiple of this.
BLOCK = 192


def _png(b: bytes, at: int) -> int:
    at, first, data = at + 8, True, False
    while at + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        end = at + 12 + n
        if end > len(b) or (first and (kind != b"IHDR" or n != 13)) or zlib.crc32(b[at + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return -1
        first, data, at = False, data or kind == b"IDAT", end
        if kind == b"IEND":
            return at if data and n == 0 else -1
    return -1


def _gif(b: bytes, at: int, known: dict | None = None) -> int:
    known = {} if known is None else known  # where walks from a place end: hits in one value share their ways

    def blocks(i: int) -> int:
        way = []
        while 0 <= i < len(b) and b[i] and i not in known:
            way.append(i)
            i += 1 + b[i]
        end = known[i] if i in known else i + 1 if i < len(b) else -1
        known.update(dict.fromkeys(way, end))
        return end

    if at + 13 > len(b):
        return -1
    flags, i, images = b[at + 10], at + 13, 0
    i += 3 << (flags & 7) + 1 if flags & 0x80 else 0
    way, end = [], -1
    while 0 <= i < len(b):
        step = ("gif", i, images > 0)
        if step in known:
            end = known[step]
            break
        way.append(step)
        kind = b[i]
        if kind == 0x3B:
            end = i + 1 if images else -1
            break
        if kind == 0x21:
            i = blocks(i + 2)
        elif kind == 0x2C and i + 10 <= len(b):
            local = b[i + 9]
            i = blocks(i + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))
            images += 1
        else:
            break
    known.update(dict.fromkeys(way, end))
    return end


def _jpeg(b: bytes, at: int) -> int:
    i, frame = at + 2, False
    while i + 4 <= len(b) and b[i] == 0xFF:
        kind = b[i + 1]
        if kind == 0xD9:
            return i + 2 if frame else -1
        if kind == 0xFF:
            i += 1
            continue
        n = struct.unpack_from(">H", b, i + 2)[0]
        if n < 2 or i + 2 + n > len(b):
            return -1
        frame |= kind in (0xC0, 0xC1, 0xC2)
        i += 2 + n
        if kind == 0xDA:  # the scan's data last up to the next real marker
            while True:
                i = b.find(b"\xff", i)
                if i < 0 or i + 1 >= len(b):
                    return -1
                if b[i + 1] and not 0xD0 <= b[i + 1] <= 0xD7:
                    break
                i += 2
    return i + 2 if frame and b[i : i + 2] == b"\xff\xd9" else -1


def _bmp(b: bytes, at: int) -> int:
    if at + 54 > len(b):
        return -1
    size, zero, offset, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if zero or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or header not in (40, 52, 56, 108, 124) or width <= 0 or not height:
        return -1
    row = (width * bits + 31) // 32 * 4
    return at + size if 14 + header <= offset <= size and at + size <= len(b) and (struct.unpack_from("<I", b, at + 30)[0] or offset + row * abs(height) <= size) else -1


def _riff(b: bytes, at: int) -> int:
    if at + 12 > len(b):
        return -1
    n, kind = struct.unpack_from("<I4s", b, at + 4)
    end = at + 8 + n
    if end > len(b) or kind not in (b"WAVE", b"WEBP", b"AVI "):
        return -1
    i, found = at + 12, set()
    while i + 8 <= end:
        name, size = struct.unpack_from("<4sI", b, i)
        found.add(name)
        i += 8 + size + (size & 1)
        if i > end + 1:
            return -1
    need = {b"WAVE": {b"fmt ", b"data"}, b"WEBP": {b"VP8 ", b"VP8L", b"VP8X"}, b"AVI ": {b"LIST"}}[kind]
    return end if (need <= found if kind == b"WAVE" else need & found) else -1


def _crc_table(polynomial: int, bits: int) -> list[int]:
    top, full, table = 1 << bits - 1, (1 << bits) - 1, []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1 ^ (polynomial if x & top else 0)) & full
        table.append(x)
    return table


#: Polynomials of the checksums of frame headers and of frames.
CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_frame(b: bytes, at: int) -> tuple[int, int] | None:
    """Samples in a frame and the end of its header, if a frame begins here."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8 or b[at + 3] & 1:
        return None
    size, rate, i = b[at + 2] >> 4, b[at + 2] & 15, at + 4
    more = 0 if b[i] < 0x80 else 8 - (b[i] ^ 0xFF).bit_length()  # bytes of the coded number
    if more == 1 or more > 7 or size == 0 or rate == 15:
        return None
    i += max(more, 1)
    extra = {6: 1, 7: 2}.get(size, 0)
    samples = int.from_bytes(b[i : i + extra], "big") + 1 if extra else 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8
    i += extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if i >= len(b):
        return None
    crc = 0
    for x in b[at:i]:
        crc = CRC8[crc ^ x]
    return (samples, i + 1) if crc == b[i] else None


def _flac(b: bytes, at: int) -> int:
    """Metadata blocks, then frames up to the number of samples that the first block states; each by its checksum.

    A file that states no number of samples ends with the value, or with its last sound frame.
    """
    i, first, total = at + 4, True, 0
    while True:
        if i + 4 > len(b):
            return -1
        head, n = b[i], int.from_bytes(b[i + 1 : i + 4], "big")
        if (first and (head & 0x7F or n != 34)) or i + 4 + n > len(b):
            return -1
        if first:
            total = int.from_bytes(b[i + 4 + 13 : i + 4 + 18], "big") & (1 << 36) - 1
        first, i = False, i + 4 + n
        if head & 0x80:
            break
    done = 0
    while (frame := _flac_frame(b, i)) is not None:
        samples, past = frame
        done += samples
        last = total and done >= total
        crc, j = 0, i
        end = -1
        for j in range(i, len(b)):
            crc = (crc << 8 & 0xFF00) ^ CRC16[crc >> 8 ^ b[j]]
            if crc == 0 and j + 1 > past + 2 and (last or j + 1 == len(b) or _flac_frame(b, j + 1) is not None):
                end = j + 1
                break
        if end < 0:
            return -1
        i = end
        if last or i == len(b):
            break
    return i if done and (not total or done >= total) else -1


def _au(b: bytes, at: int) -> int:
    if at + 24 > len(b):
        return -1
    offset, size, coding, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    ok = offset >= 24 and 1 <= coding <= 27 and rate and 1 <= channels <= 8 and size != 0xFFFFFFFF and at + offset + size <= len(b)
    return at + offset + size if ok else -1


VALID = {"png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "riff": _riff, "flac": _flac, "au": _au}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (len(magic), kind))
    a.make_automaton()
    return a


def sniff(b: bytes) -> list[tuple[int, int, str]]:
    """(start, end, type) of every valid file in the bytes, leftmost first, and of those inside found ones too."""
    found, known = [], {}
    for last, (n, kind) in _automaton().iter(b.decode("latin-1")):
        at = last + 1 - n
        end = _gif(b, at, known) if kind == "gif" else VALID[kind](b, at)
        if end > 0:
            name = {b"WAVE": "wav", b"WEBP": "webp", b"AVI ": "avi"}[b[at + 8 : at + 12]] if kind == "riff" else kind
            found.append((at, end, name))
    return sorted(found)


def sniff_media(df: DataFrame, media: str = "media", declared: str | None = None, keep=("doc_id",)) -> DataFrame:
    """Columns of ``keep``, the confirmed ``media_type`` and ``media_length`` of each binary value, whether that corrects
    the declared type (``corrected``), and the embedded files, ``carved`` as structs of type, start, bytes and whether it
    lies inside another found file (``nested``).

    A null or empty value, and one that no validator confirms, has a null type and length; it corrects nothing.
    Repeated rows stay; an empty table gives an empty one; a column of ``keep`` named like one of the result gives way to it.
    """
    ship(df.sparkSession)
    import pyarrow as pa

    names = ["media_type", "media_length", "corrected", "carved"]
    kept = [c for c in keep if c not in names]
    narrow = df.select(*[F.col(f"`{c}`") for c in kept], (F.col(f"`{declared}`") if declared else F.lit(None).cast("string")).alias("__declared"), F.col(f"`{media}`").alias("__media"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[: len(kept)])
    struct_type = pa.struct([("type", pa.string()), ("start", pa.int64()), ("bytes", pa.binary()), ("nested", pa.bool_())])

    def over(batches):
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(len(kept) + 1)), 0).to_pylist()
            start = 0
            while start < batch.num_rows:
                end, held = start + 1, sizes[start]
                while end < batch.num_rows and end - start < SLICE_ROWS and held + sizes[end] <= SLICE_BYTES:
                    held, end = held + sizes[end], end + 1
                yield made(batch.slice(start, end - start))
                start = end

    def made(part):
        kinds, sizes, fixed, carved = [], [], [], []
        for b, said in zip(part.column(len(kept) + 1).to_pylist(), part.column(len(kept)).to_pylist(), strict=True):
            found = sniff(b or b"")
            head = next((f for f in found if f[0] == 0), None)
            kinds.append(head and head[2])
            sizes.append(head and head[1])
            fixed.append(bool(head and said is not None and said != head[2]))
            reach, inside = 0, []
            for s, e, k in found:
                if s:
                    inside.append({"type": k, "start": s, "bytes": b[s:e], "nested": s < reach})
                reach = max(reach, e)
            carved.append(inside)
        return pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(kinds, pa.string()), pa.array(sizes, pa.int64()), pa.array(fixed, pa.bool_()), pa.array(carved, pa.list_(struct_type))], names=[*kept, *names])

    out = "media_type string, media_length long, corrected boolean, carved array<struct<type: string, start: bigint, bytes: binary, nested: boolean>>"
    return narrow.mapInArrow(over, (fields + ", " if fields else "") + out)


def payload(text: str) -> bytes:
    b = text.encode()
    return b + b" " * (max(1, -(-len(b) // BLOCK)) * BLOCK - len(b))


def to_wav(samples: bytes) -> bytes:
    """A RIFF file of unsigned 8-bit samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, CHANNELS, RATE, RATE * CHANNELS, CHANNELS, 8, b"data", len(samples))
    return head + samples


def from_wav(b: bytes) -> bytes:
    """The samples of the file that sniffing confirms at the start of the bytes."""
    found = sniff(b)
    if not found or found[0][0] or found[0][2] != "wav":
        raise ValueError("no valid wav file")
    at = 12
    while True:
        name, n = struct.unpack_from("<4sI", b, at)
        if name == b"data":
            return b[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)


def features(samples: bytes) -> str:
    """Type, length, mean, root mean square about the middle, sign changes about the middle, and embedded files."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    c = x - 128
    crossings = int(np.count_nonzero((c[1:] < 0) != (c[:-1] < 0)))
    inside = ",".join(f"{k}@{s}+{e - s}" for s, e, k in sniff(samples))
    return f"wav;rate={RATE};channels={CHANNELS};bits=8;samples={len(x)};sum={int(x.sum())};energy={int((c * c).sum())};crossings={crossings};embedded={inside}"


def store_texts(docs: DataFrame, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Columns of ``keep`` and the stored form (``media``) of each whole text; null texts count as empty."""
    return map_texts(docs, lambda: lambda texts: ([to_wav(payload(t)) for t in texts],), [("media", "binary")], text, keep)


def text_media_digests(docs: DataFrame, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Columns of ``keep`` and the digests of each whole text's stored form, read back by sniffing.

    Null texts count as empty and give one block of padding. Equal texts give equal values.
    """

    def run(texts):
        rows = []
        for t in texts:
            stored = to_wav(payload(t))
            back = from_wav(stored)
            n = len(t.encode())
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), features(back)))
        return list(zip(*rows, strict=True))

    out = [("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")]
    return map_texts(docs, lambda: run, out, text, keep)
