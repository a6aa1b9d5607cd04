"""Media columns: signature sniffing, structural validation, type correction and carving.

One Aho-Corasick automaton finds the magic bytes of all formats in a single pass over a
blob; each hit is then handed to its format's validator, which walks the structure (chunk
lengths, checksums, block chains) and returns the exact length of the media, or nothing.
Only validated media count, so magic bytes that occur in ordinary text change nothing.

A blob is sniffed in time linear in its length: what a format searches for is located once
for all its hits, and validators that walk from hit to hit share an allowance of EFFORT
steps for each byte of the blob. Only a blob made to exhaust it (thousands of overlapping,
nearly whole media) has later hits left unconfirmed.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.shared import arrow_map

#: Rows that are held as Python objects at a time.
BATCH = 256
ROW = 576
#: Bytes and steps that the validators of one blob may spend, for each of its bytes.
EFFORT = 256


class Media(NamedTuple):
    kind: str
    offset: int
    length: int


class Seen:
    """What is known of one blob: places found so far, and the steps spent."""

    def __init__(self, b: bytes) -> None:
        self.b, self.spent, self.allowed = b, 0, EFFORT * (len(b) + 4096)
        self.last: dict[bytes, int] = {}

    def find(self, mark: bytes, at: int) -> int:
        """The first place of mark at or after at, or -1; calls come with ascending at."""
        if mark not in self.last or 0 <= self.last[mark] < at:
            self.last[mark] = self.b.find(mark, at)
        return self.last[mark]

    @cached_property
    def archives(self) -> dict[int, int]:
        """The ends of zip archives by their starts, which each end record tells."""
        out: dict[int, int] = {}
        b, end = self.b, self.b.find(b"PK\x05\x06")
        while 0 <= end <= len(b) - 22:
            size, start, note = struct.unpack_from("<IIH", b, end + 12)
            at = end - size - start
            if at >= 0 and b[at + start : at + start + 4] in (b"PK\x01\x02", b"PK\x05\x06") and end + 22 + note <= len(b):
                out.setdefault(at, end + 22 + note)
            end = b.find(b"PK\x05\x06", end + 1)
        return out


def _png(b: bytes, at: int, seen: Seen) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or first and (kind != b"IHDR" or n != 13):
            return None
        seen.spent += n + 12
        if zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at if n == 0 else None
    return None


def _riff(form: bytes):
    def check(b: bytes, at: int, seen: Seen) -> int | None:
        if len(b) < at + 12 or b[at + 8 : at + 12] != form:
            return None
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        if end > len(b):
            return None
        p, chunks = at + 12, set()
        while p + 8 <= end:
            kind, n = struct.unpack_from("<4sI", b, p)
            seen.spent += 8
            chunks.add(kind)
            p += 8 + n + n % 2
        need = {b"fmt ", b"data"} if form == b"WAVE" else set()
        return end - at if p in (end, end + 1) and chunks >= need and chunks else None

    return check


def _bmp(b: bytes, at: int, seen: Seen) -> int | None:
    if len(b) < at + 54:
        return None
    size, zero, start, header, width, height, planes, bits, packing = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if zero or header not in (40, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or at + size > len(b):
        return None
    if packing == 0 and start + (width * bits + 31) // 32 * 4 * abs(height) > size or start < 14 + header:
        return None
    return size


def _gif(b: bytes, at: int, seen: Seen) -> int | None:
    if len(b) < at + 14:
        return None
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p += 2
        elif b[p] == 0x2C and p + 10 < len(b):
            p += 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0)
        else:
            return None
        while p < len(b) and b[p]:
            seen.spent += 8
            p += 1 + b[p]
        p += 1
    return None


def _jpeg(b: bytes, at: int, seen: Seen) -> int | None:
    p, frame = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        marker = b[p + 1]
        if marker == 0xFF:  # fill
            p += 1
            continue
        if marker in (0x00, 0x01, 0xD8) or 0xD0 <= marker <= 0xD7 or marker == 0xD9:
            return None
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or p + 2 + n > len(b):
            return None
        frame |= 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if marker == 0xDA:  # entropy-coded data: up to a marker that is no restart and no stuffed byte
            while True:
                start, p = p, b.find(b"\xff", p)
                seen.spent += (p if p >= 0 else len(b)) - start + 8
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] == 0xD9:
                    return p + 2 - at if frame else None
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                elif b[p + 1] == 0xFF:
                    p += 1
                else:
                    break
    return None


def _gzip(b: bytes, at: int, seen: Seen) -> int | None:
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return None
    expand = zlib.decompressobj(31)
    try:
        data = memoryview(b)[at:]
        for i in range(0, len(data), 1 << 16):
            part = data[i : i + (1 << 16)]
            while part and not expand.eof and seen.spent <= seen.allowed:
                seen.spent += len(part) + len(expand.decompress(part, 1 << 20)) // 16  # no more at a time, whatever it expands to
                part = expand.unconsumed_tail
            if expand.eof:
                return min(i + (1 << 16), len(data)) - len(expand.unused_data)
            if seen.spent > seen.allowed:
                break
    except zlib.error:
        pass
    return None


def _pdf(b: bytes, at: int, seen: Seen) -> int | None:
    if not b[at + 5 : at + 6].isdigit():
        return None
    end, table = seen.find(b"%%EOF", at), seen.find(b"startxref", at)
    return end + 5 - at if 0 <= table <= end - 9 else None


def _zip(b: bytes, at: int, seen: Seen) -> int | None:
    return seen.archives[at] - at if at in seen.archives else None


#: Magic bytes, media type, validator.
FORMATS = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"RIFF", "audio/wav", _riff(b"WAVE")),
    (b"RIFF", "image/webp", _riff(b"WEBP")),
    (b"RIFF", "video/avi", _riff(b"AVI ")),
    (b"BM", "image/bmp", _bmp),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
]


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic in {m for m, _, _ in FORMATS}:
        found.add_word(magic.decode("latin-1"), (len(magic), [(kind, check) for m, kind, check in FORMATS if m == magic]))
    found.make_automaton()
    return found


_AUTOMATON = _automaton()


def sniff(blob: bytes) -> list[Media]:
    """Validated media in the blob, in order; what lies inside one of them is part of it."""
    found, done, seen = [], 0, Seen(blob)
    for last, (n, checks) in _AUTOMATON.iter(blob.decode("latin-1")):
        at = last + 1 - n
        if at >= done:
            for kind, check in checks:
                if seen.spent <= seen.allowed and (length := check(blob, at, seen)):
                    found.append(Media(kind, at, length))
                    done = at + length
                    break
    return found


def detect(blob: bytes, declared: str | None) -> tuple[str | None, list[Media]]:
    """The corrected type, and the media embedded further on.

    The type is that of the media at the blob's start; failing that, a declared type that
    names one of FORMATS is wrong and becomes application/octet-stream, and any other stays.
    """
    media = sniff(blob)
    if media and media[0].offset == 0:
        return media[0].kind, media[1:]
    known = {kind for _, kind, _ in FORMATS}
    return "application/octet-stream" if declared in known else declared, media


_SNIFFED = "corrected string, embedded array<struct<kind:string,offset:long,length:long,content:binary>>"


def sniff_column(df: DataFrame, key: str, blob: str, declared: str) -> DataFrame:
    """(key, declared, corrected, embedded) for each row of df: every embedded media is carved out whole.

    A null blob has no media and keeps its declared type. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                rows = batch.slice(i, BATCH)
                types, carved = [], []
                for b, d in zip(rows.column("b").to_pylist(), rows.column("declared").to_pylist(), strict=True):
                    kind, media = detect(b, d) if b is not None else (d, [])
                    types.append(kind)
                    carved.append([{"kind": m.kind, "offset": m.offset, "length": m.length, "content": b[m.offset : m.offset + m.length]} for m in media])
                struct_type = pa.list_(pa.struct([("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("content", pa.binary())]))
                yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("declared"), pa.array(types, pa.string()), pa.array(carved, struct_type)], ["key", "declared", "corrected", "embedded"])

    inner = df.select(F.col(key).alias("key"), F.col(declared).cast("string").alias("declared"), F.col(blob).cast("binary").alias("b"))
    return inner.transform(arrow_map, run, f"key {df.schema[key].dataType.simpleString()}, declared string, {_SNIFFED}")


def to_png(samples: bytes) -> bytes:
    """8-bit grey PNG, ROW samples wide."""
    lines = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    raw = np.concatenate([np.zeros((len(lines), 1), np.uint8), lines], axis=1).tobytes()
    chunk = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(lines), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def from_png(b: bytes) -> bytes:
    p, data = 8, []
    while p < len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if kind == b"IHDR":
            width = struct.unpack_from(">I", b, p + 8)[0]
        elif kind == b"IDAT":
            data.append(b[p + 8 : p + 8 + n])
        p += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are read")
    return lines[:, 1:].tobytes()


def to_wav(samples: bytes) -> bytes:
    """8-bit mono PCM at 8 kHz."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 36 + len(samples), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(samples)) + samples


def from_wav(b: bytes) -> bytes:
    p = 12
    while b[p : p + 4] != b"data":
        n = struct.unpack_from("<I", b, p + 4)[0]
        p += 8 + n + n % 2
    return b[p + 8 : p + 8 + struct.unpack_from("<I", b, p + 4)[0]]


def to_bmp(samples: bytes) -> bytes:
    """8-bit grey BMP, ROW samples wide, top line first."""
    palette = b"".join(bytes([i, i, i, 0]) for i in range(256))
    start = 54 + len(palette)
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", start + len(samples), 0, start, 40, ROW, -(len(samples) // ROW), 1, 8, 0, len(samples), 0, 0, 256, 0) + palette + samples


def from_bmp(b: bytes) -> bytes:
    return b[struct.unpack_from("<I", b, 10)[0] : struct.unpack_from("<I", b, 2)[0]]


#: The stored form is chosen by the payload's crc32.
STORED = [("image/png", to_png, from_png), ("audio/wav", to_wav, from_wav), ("image/bmp", to_bmp, from_bmp)]
DECLARED = ["image/jpeg", "image/png", "application/pdf", "text/plain"]


def payload_of(raw: bytes) -> bytes:
    """Padded with bytes 255 to a positive multiple of ROW."""
    return raw + b"\xff" * ((-len(raw)) % ROW if raw else ROW)


def store(raw: bytes) -> tuple[bytes, str]:
    """A record as crawls have them: a text header, the media, and the text again, with an unreliable declared type."""
    payload = payload_of(raw)
    crc = zlib.crc32(payload)
    media = STORED[crc % len(STORED)][1](payload)
    return b"Content-Length: %d\r\n\r\n" % len(media) + media + b"\r\n" + raw, DECLARED[crc // 3 % len(DECLARED)]


def store_texts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_bytes, declared, record binary); a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                rows = batch.slice(i, BATCH)
                raw = [x or b"" for x in rows.column("raw").to_pylist()]
                records, declared = zip(*map(store, raw), strict=True)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(declared, pa.string()), pa.array(records, pa.binary())], ["doc_id", "n_bytes", "declared", "record"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw"))
    return texts.transform(arrow_map, run, "doc_id long, n_bytes long, declared string, record binary")


def media_digests(stored: DataFrame) -> DataFrame:
    """Records from store_texts(), sniffed and carved -> a row of digests each: the payload is decoded from the carved media."""
    types = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    decode = {kind: back for kind, _, back in STORED}

    def one(doc_id: int, n_bytes: int, declared: str, record: bytes) -> tuple:
        corrected, media = detect(record, declared)
        carved = record[media[0].offset : media[0].offset + media[0].length]
        payload = decode[media[0].kind](carved)
        share = np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=8)
        feature = f"declared={declared};corrected={corrected};carved={media[0].kind}@{media[0].offset}+{media[0].length};embedded={len(media)};histogram={','.join(map(str, share))}"
        return doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(carved), hashlib.sha256(carved).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                rows = batch.slice(i, BATCH)
                made = zip(*map(one, *(rows.column(c).to_pylist() for c in ("doc_id", "n_bytes", "declared", "record"))), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(made, types, strict=True)], [n for n, _ in types])

    return stored.transform(arrow_map, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
