"""Byte-level BPE: encoding and decoding with the tokenizers library over Arrow batches.

A rank file maps byte strings to ids. The library works on characters, so each byte is written as one
printable character (``byte_characters``) and the ranks become a vocabulary and a list of merges. Text
is first split by the tokenizer's pattern; pieces are remembered, up to MEMO_BYTES a worker. A worker
loads the definition once and keeps it from task to task.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .common import slices, schema_of, with_columns, without

#: What the pieces that a worker remembers may weigh, with about PIECE_BYTES of upkeep each; then it starts afresh.
MEMO_BYTES, PIECE_BYTES = 32 << 20, 250
#: Texts longer than this are split piece by piece, not all at once.
LONG = 1 << 20


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(spare)) for b in range(256)}


def tokenizer_json(ranks_path: str) -> str:
    """The rank file as a definition that the tokenizers library loads.

    The ranks say which byte strings may be joined, in whatever way they came about; so every way to cut
    a string into two earlier ones becomes a merge, in the order of the ranks.
    """
    from tokenizers import Tokenizer, models

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    letter = byte_characters()
    shown = {t: "".join(letter[b] for b in t) for t in ranks}
    merges = [
        (shown[t[:k]], shown[t[k:]])
        for t, r in sorted(ranks.items(), key=lambda x: x[1])
        for k in range(1, len(t))
        if ranks.get(t[:k], r) < r and ranks.get(t[k:], r) < r
    ]
    return Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)).to_str()


class Pieces:
    """Splits texts by the pattern and gives the ids of each piece as little-endian bytes."""

    def __init__(self, definition: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(definition).model
        self.any = regex.compile(pattern)
        # On ASCII text the standard library matches the same with these classes, in half the time.
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        self.ascii = re.compile(plain, re.ASCII) if r"\p" not in plain else self.any
        self.letters = {b: c for b, c in byte_characters().items()}
        self.memo: dict[str, bytes] = {}
        self.weight = 0
        self.table = ByteTable(definition)

    def of_piece(self, piece: str) -> bytes:
        found = self.memo.get(piece)
        if found is None:
            mapped = piece.encode().decode("latin-1").translate(self.letters)
            found = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
            self.weight += PIECE_BYTES + 4 * len(piece) + len(found)
            if self.weight > MEMO_BYTES:
                self.memo.clear()
                self.weight = PIECE_BYTES + 4 * len(piece) + len(found)
            if self.weight <= MEMO_BYTES:
                self.memo[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        pattern = self.ascii if text.isascii() else self.any
        if len(text) <= LONG:
            return b"".join(map(self.of_piece, pattern.findall(text)))
        out, found = bytearray(), (m.group() for m in pattern.finditer(text))
        while part := list(islice(found, 50_000)):
            out += b"".join(map(self.of_piece, part))
        return bytes(out)


class ByteTable:
    """The bytes of each id: the character table read backwards."""

    def __init__(self, definition: str):
        back = {c: b for b, c in byte_characters().items()}
        vocab = json.loads(definition)["model"]["vocab"]
        self.known = np.zeros(max(vocab.values(), default=-1) + 1, bool)
        self.bytes = [b""] * len(self.known)
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token)
            self.known[i] = True
        self.lengths = np.array([len(t) for t in self.bytes], np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; an id that the table does not hold is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError(f"unknown token id among {len(ids)} ids")
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


#: What this worker process has loaded: the last definition and pattern.
_loaded: dict[str, Pieces | ByteTable] = {}


def _load(kind: type, definition: Broadcast, digest: str, *more: str):
    key = f"{kind.__name__}:{digest}:{more}"
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = kind(zlib.decompress(definition.value).decode(), *more)
    return _loaded[key]


def _shared(df: DataFrame, ranks_path: str) -> tuple[Broadcast, str]:
    """The definition, packed (a few MB, whatever the data), and its digest."""
    packed = zlib.compress(tokenizer_json(ranks_path).encode())
    return df.sparkSession.sparkContext.broadcast(packed), hashlib.sha256(packed).hexdigest()


def character_spans(ids: np.ndarray, lengths: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token and the one after its last. A token that holds a part of a character
    spans the whole of it, so neighbours may share one."""
    ends = np.cumsum(lengths[ids])
    if not len(ends):
        return ends, ends
    character = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
    return character[ends - lengths[ids]], character[ends - 1] + 1


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", offsets: bool = False, keep_text: bool = True, keep_ids: bool = True, decoded: bool = False) -> DataFrame:
    """Adds token_ids array<int>, n_tokens bigint and ids_sha256 (of the ids as little-endian unsigned
    32-bit integers); with ``offsets`` also token_spans array<struct<start,end>> in characters, and with
    ``decoded`` decoded_sha256, of the bytes that the ids give when they are decoded again.

    A null or empty text has no tokens. Whole texts are encoded, whatever their length. Equal rows stay
    apart and are treated alike; an empty table gives an empty one. Input columns of the same names are
    replaced; all others stay.
    """
    added = {"token_ids": "array<int>"} if keep_ids else {}
    added |= {"n_tokens": "bigint", "ids_sha256": "string"}
    added |= {"token_spans": "array<struct<start:int,end:int>>"} if offsets else {}
    added |= {"decoded_sha256": "string"} if decoded else {}
    source = without(df, *added)
    shared, digest = _shared(df, ranks_path)
    dropped = [] if keep_text else [text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _load(Pieces, shared, digest, pattern)
        for batch in (part for b in batches for part in slices(b, text)):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            encoded = [pieces.encode(t) for t in texts]
            counts = np.array([len(e) // 4 for e in encoded], np.int64)
            at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            more = {"n_tokens": pa.array(counts), "ids_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in encoded], pa.string())}
            if keep_ids:
                more["token_ids"] = pa.ListArray.from_arrays(at, pa.array(np.frombuffer(b"".join(encoded), "<i4"), pa.int32()))
            if offsets:
                spans = [character_spans(np.frombuffer(e, "<i4"), pieces.table.lengths, t.encode()) for e, t in zip(encoded, texts, strict=True)]
                both = [pa.array(np.concatenate([s[k] for s in spans] or [[]]).astype(np.int32)) for k in (0, 1)]
                more["token_spans"] = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(both, ["start", "end"]))
            if decoded:
                back = (hashlib.sha256(pieces.table.decode(np.frombuffer(e, "<u4"))) for e in encoded)
                more["decoded_sha256"] = pa.array([h.hexdigest() for h in back], pa.string())
            yield with_columns(batch, dropped, **{n: more[n] for n in added})

    kept = source if keep_text else without(source, text)
    return source.mapInArrow(run, schema_of(kept, ", ".join(f"{n} {t}" for n, t in added.items())))


def decode(df: DataFrame, ranks_path: str, ids: str = "token_ids", keep_ids: bool = True) -> DataFrame:
    """Adds decoded_bytes binary and decoded_text string (bytes that are no UTF-8 become U+FFFD there, as
    happens when ids end inside a character). A null or empty list decodes to nothing; an unknown, negative
    or null id is an error. Input columns of the added names are replaced; an empty table gives an empty one."""
    source = without(df, "decoded_bytes", "decoded_text")
    shared, digest = _shared(df, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _load(ByteTable, shared, digest)
        for batch in batches:
            rows = max(1, batch.num_rows // (1 + batch.nbytes // (8 << 20)))
            for part in (batch.slice(k, rows) for k in range(0, batch.num_rows, rows)):
                column = part.column(part.schema.get_field_index(ids))
                if any(v.is_valid and v.values.null_count for v in column):
                    raise ValueError("null token id")
                data = [table.decode(v.values.to_numpy(zero_copy_only=False)) if v.is_valid else b"" for v in column]
                yield with_columns(
                    part,
                    [] if keep_ids else [ids],
                    decoded_bytes=pa.array(data, pa.binary()),
                    decoded_text=pa.array([d.decode("utf-8", "replace") for d in data], pa.string()),
                )

    kept = source if keep_ids else without(source, ids)
    return source.mapInArrow(run, schema_of(kept, "decoded_bytes binary, decoded_text string"))
