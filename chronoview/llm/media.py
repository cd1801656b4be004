"""Media columns: what a binary value really is, whether it is whole, and what else it holds.

An Aho-Corasick automaton finds the magic bytes of every known format in one pass. A hit counts only if
the format's validator confirms structure and length there. The hit at the start gives the type of the
value; others give media to carve out.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_of, slices, with_columns, without

PAD = 64
SAMPLE_RATE = 8000


class Value:
    """A binary value with what validators have found out about it: a walk that meets a place where another one was
    ends as that one did, so many false starts take no longer than one."""

    def __init__(self, data: bytes):
        self.data = data
        self._marks: dict[bytes, list[int]] = {}
        self.walks: dict[tuple[str, int], tuple] = {}

    def after(self, mark: bytes, at: int) -> int:
        """The first place of a mark from ``at`` on; -1 where there is none. All places are found once."""
        if mark not in self._marks:
            self._marks[mark] = [m.start() for m in re.finditer(b"(?=" + re.escape(mark) + b")", self.data)]
        places = self._marks[mark]
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def settle(self, kind: str, visited: list[int], result: tuple) -> tuple:
        for at in visited:
            self.walks[kind, at] = result
        return result


def _png(value: Value, at: int) -> int | None:
    data, pos, visited, end = value.data, at + 8, [], None
    if data[pos : pos + 8] != b"\0\0\0\rIHDR":
        return None
    while pos + 12 <= len(data):
        if ("png", pos) in value.walks:
            end = value.walks["png", pos][0]
            break
        visited.append(pos)
        size, kind = struct.unpack_from(">I4s", data, pos)
        stop = pos + 12 + size
        if stop > len(data) or zlib.crc32(memoryview(data)[pos + 4 : stop - 4]) != struct.unpack_from(">I", data, stop - 4)[0]:
            break
        if kind == b"IEND":
            end = stop
            break
        pos = stop
    value.settle("png", visited, (end,))
    return end - at if end else None


def _riff(value: Value, at: int) -> int | None:
    """WAV: the outer length, a format chunk and a data chunk that lies within."""
    data = value.data
    if at + 12 > len(data) or data[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    pos, seen = at + 12, set()
    while pos + 8 <= end <= len(data):
        kind, size = struct.unpack_from("<4sI", data, pos)
        if pos + 8 + size > end:
            return None
        seen.add(kind)
        pos += 8 + size + size % 2
    return end - at if {b"fmt ", b"data"} <= seen and pos >= end else None


def _gif(value: Value, at: int) -> int | None:
    data = value.data
    if at + 13 > len(data):
        return None
    flags = data[at + 10]
    pos = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    end, drawn = _gif_blocks(value, pos)
    return end - at if end and drawn else None


def _gif_blocks(value: Value, pos: int) -> tuple[int | None, bool]:
    """Where the blocks from ``pos`` on end, and whether one of them is an image."""
    data, steps, result = value.data, [], (None, False)
    while pos < len(data):
        if ("gif", pos) in value.walks:
            result = value.walks["gif", pos]
            break
        kind, start = data[pos], pos
        if kind == 0x3B:
            result = (pos + 1, False)
            steps.append((start, False))
            break
        if kind == 0x2C and pos + 10 < len(data):
            inner = data[pos + 9]
            pos += 11 + (3 << ((inner & 7) + 1) if inner & 0x80 else 0)
        elif kind == 0x21:
            pos += 2
        else:
            steps.append((start, False))
            break
        steps.append((start, kind == 0x2C))
        pos = _gif_chain(value, pos)
    end, drawn = result
    for start, image in reversed(steps):
        drawn = drawn or image
        value.walks["gif", start] = (end, drawn)
    return end, drawn


def _gif_chain(value: Value, pos: int) -> int:
    """The place after a chain of data blocks."""
    data, visited = value.data, []
    while pos < len(data) and data[pos]:
        if ("chain", pos) in value.walks:
            return value.settle("chain", visited, value.walks["chain", pos])[0]
        visited.append(pos)
        pos += data[pos] + 1
    return value.settle("chain", visited, (pos + 1,))[0]


def _jpeg(value: Value, at: int) -> int | None:
    data, pos, visited, end = value.data, at + 2, [], None
    while end is None and pos + 4 <= len(data) and data[pos] == 0xFF:
        if ("jpeg", pos) in value.walks:
            end = value.walks["jpeg", pos][0]
            break
        visited.append(pos)
        kind = data[pos + 1]
        pos += 2 + struct.unpack_from(">H", data, pos + 2)[0]
        if kind == 0xDA:
            while (pos := data.find(b"\xff", pos)) >= 0 and pos + 1 < len(data):
                if data[pos + 1] == 0xD9:
                    end = pos + 2
                    break
                if data[pos + 1] and not 0xD0 <= data[pos + 1] <= 0xD7:
                    break
                pos += 2
            if pos < 0:
                break
    value.settle("jpeg", visited, (end,))
    return end - at if end else None


def _bmp(value: Value, at: int) -> int | None:
    data = value.data
    if at + 26 > len(data):
        return None
    size, spare, offset, header = struct.unpack_from("<IIII", data, at + 2)
    return size if not spare and header in (12, 40, 52, 56, 108, 124) and 14 + header <= offset <= size <= len(data) - at else None


def _gzip(value: Value, at: int) -> int | None:
    data = value.data
    inflate = zlib.decompressobj(31)
    pos = at
    try:
        while pos < len(data) and not inflate.eof:
            inflate.decompress(data[pos : pos + 65536], 0)
            pos += 65536
    except zlib.error:
        return None
    return min(pos, len(data)) - len(inflate.unused_data) - at if inflate.eof else None


def _pdf(value: Value, at: int) -> int | None:
    end = value.after(b"%%EOF", at)
    return end + 5 - at if end > 0 and 0 < value.after(b"startxref", at) <= end - 9 else None


def _zip(value: Value, at: int) -> int | None:
    data, end = value.data, value.after(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(data):
        return None
    size, offset, note = struct.unpack_from("<IIH", data, end + 12)
    return end + 22 + note - at if at + offset + size == end and end + 22 + note <= len(data) else None


#: The magic bytes of each format, with its media type and its validator.
FORMATS: list[tuple[bytes, str, Callable[[Value, int], int | None]]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"RIFF", "audio/wav", _riff),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
]


class Sniffer:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for k, (magic, _, _) in enumerate(FORMATS):
            self.automaton.add_word(magic.decode("latin-1"), k)
        self.automaton.make_automaton()

    def find(self, data: bytes) -> list[tuple[str, int, int]]:
        """(type, offset, length) of confirmed media, in order: the outermost of nested ones, and those
        within a value that starts at 0."""
        out: list[tuple[str, int, int]] = []
        value, covered = Value(data), 0
        for last, k in self.automaton.iter(data.decode("latin-1")):
            magic, kind, check = FORMATS[k]
            at = last - len(magic) + 1
            if at >= covered and (size := check(value, at)):
                out.append((kind, at, size))
                covered = at + size if at else 0
        return out


def sniff(df: DataFrame, media: str = "media", declared: str = "declared_type") -> DataFrame:
    """Adds media_type (the confirmed one; else the declared one if no validator knows it; else null),
    type_corrected boolean, valid_bytes (length that the structure gives, null if none) and embedded
    array<struct<type,offset,length,sha256>> of carved media.

    A null value has null type, no length and nothing embedded. A declared type that a validator knows but
    does not confirm is dropped. Input columns of the added names are replaced.
    """
    source = without(df, "media_type", "type_corrected", "valid_bytes", "embedded")
    known = {kind for _, kind, _ in FORMATS}
    part = pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for batch in (x for b in batches for x in slices(b, media)):
            types, corrected, sizes, embedded = [], [], [], []
            claims = batch.column(batch.schema.get_field_index(declared)).to_pylist()
            for data, claim in zip(batch.column(batch.schema.get_field_index(media)).to_pylist(), claims, strict=True):
                hits = sniffer.find(data) if data is not None else []
                whole = hits[0] if hits and hits[0][1] == 0 else None
                kind = whole[0] if whole else claim if claim not in known and data is not None else None
                types.append(kind)
                corrected.append(kind != claim)
                sizes.append(whole[2] if whole else None)
                inner = [h for h in hits if h is not whole]
                embedded.append([{"type": k, "offset": o, "length": n, "sha256": hashlib.sha256(data[o : o + n]).hexdigest()} for k, o, n in inner])
            yield with_columns(
                batch,
                [],
                media_type=pa.array(types, pa.string()),
                type_corrected=pa.array(corrected, pa.bool_()),
                valid_bytes=pa.array(sizes, pa.int64()),
                embedded=pa.array(embedded, pa.list_(part)),
            )

    added = "media_type string, type_corrected boolean, valid_bytes bigint, embedded array<struct<type:string,offset:bigint,length:bigint,sha256:string>>"
    return source.mapInArrow(run, schema_of(source, added))


def wav(payload: bytes) -> bytes:
    """One channel of unsigned 8-bit samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples(data: bytes) -> bytes:
    """The data chunk of a WAV value."""
    pos = 12
    while pos + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, pos)
        if kind == b"data":
            return data[pos + 8 : pos + 8 + size]
        pos += 8 + size + size % 2
    raise ValueError("no data chunk")


def store_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces ``text`` by media binary: its UTF-8 bytes (null: none), zeros up to a positive multiple of
    64, as 8-bit samples of a WAV value; adds n_bytes and declared_type, which says no more than "bytes"."""
    source = without(df, "media", "n_bytes", "declared_type")
    kept = without(source, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, text)):
            texts = [(t or "").encode() for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            stored = [wav(t + bytes(-len(t) % PAD if t else PAD)) for t in texts]
            yield with_columns(batch, [text], n_bytes=pa.array([len(t) for t in texts], pa.int64()), media=pa.array(stored, pa.binary()))

    return source.mapInArrow(run, schema_of(kept, "n_bytes bigint, media binary")).withColumn("declared_type", F.lit("application/octet-stream"))


def describe(df: DataFrame, media: str = "media") -> DataFrame:
    """Reads the samples of sniffed WAV values back: replaces ``media`` by payload_bytes, payload_sha256,
    tail_crc32 (of the last 64 bytes), media_bytes, media_sha256 and feature. A value that is no confirmed
    WAV of full length is an error."""
    added = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    source = without(df, *[x.split()[0] for x in added.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, media)):
            rows = []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (media, "media_type", "valid_bytes", "embedded")]
            for data, kind, size, inner in zip(*columns, strict=True):
                if kind != "audio/wav" or size != len(data):
                    raise ValueError(f"stored media is {kind} of {size} bytes")
                payload = samples(data)
                level = np.frombuffer(payload, np.uint8)
                loud = int(np.abs(level.astype(np.int16) - 128).max())
                feature = f"{kind};rate={SAMPLE_RATE};bits=8;samples={len(payload)};sum={int(level.sum(dtype=np.int64))};peak={loud};embedded={len(inner)}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split()[0] for x in added.split(", ")]
            yield with_columns(batch, [media], **{n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})

    return source.mapInArrow(run, schema_of(without(source, media), added))
