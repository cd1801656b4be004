"""Fuzzy search: the vocabulary entries most like each keyword by their longest common subsequence.

Blocks of keywords meet blocks of entries in the cells of a grid. In a cell, letters that two texts have in common,
counted in bins, bound their common subsequence; entries are looked at from the highest bound down, and as soon as the k-th
best score is out of the bound's reach, the rest of the block is done. Subsequences are found by bit-parallel steps, one for each letter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import on_grid

#: Texts of a block, of one side of a cell, and bins of letters.
KEYWORDS, ENTRIES, SIDE, BINS = 256, 4096, 8192, 64


def common(masks: dict[str, int], size: int, text: str) -> int:
    """Length of the longest common subsequence of a text and one of ``size`` letters, whose places masks holds."""
    every = (1 << size) - 1
    row = every
    for c in text:
        met = row & masks.get(c, 0)
        row = ((row + met) | (row - met)) & every
    return size - row.bit_count()


def places(text: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(text):
        masks[c] = masks.get(c, 0) | (1 << i)
    return masks


def ratio(shared: int, size: int) -> int:
    """0 to 100: twice the common letters over all letters; two empty texts are alike, one is not."""
    return 100 if not size else int(math.floor(200 * shared / size + 0.5))


def _bins(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), BINS), np.int32)
    for i, t in enumerate(texts):
        np.add.at(out[i], np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") % BINS, 1)
    return out


def best(keyword: str, entries: list[str], lowered: list[str], bins: np.ndarray, lengths: np.ndarray, k: int) -> list[tuple[int, str]]:
    """The k highest (score, entry) of a block, ties to the smaller entry."""
    own = keyword.lower()
    masks, size = places(own), len(own)
    shared = np.minimum(bins, _bins([own])[0]).sum(1)
    sizes = lengths + size
    bounds = np.where(sizes == 0, 100, np.floor(200 * shared / np.maximum(sizes, 1) + 0.5)).astype(int)
    found: list[tuple[int, str]] = []
    for i in np.argsort(-bounds, kind="stable"):
        if len(found) == k and bounds[i] < found[-1][0]:
            break
        found.append((ratio(common(masks, size, lowered[i]), int(sizes[i])), entries[i]))
        found = sorted(found, key=lambda f: (-f[0], f[1].encode("utf-8", "surrogatepass")))[:k]
    return found


def _pack(texts: DataFrame, column: str, most: int, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= most:
                yield pa.RecordBatch.from_arrays([pa.array([held[:most]], pa.list_(pa.string()))], names=[name])
                held = held[most:]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.list_(pa.string()))], names=[name])

    return texts.select(column).mapInArrow(run, f"{name} array<string>")


def fuzzy_top_k(vocab: DataFrame, keywords: DataFrame, k: int = 5) -> DataFrame:
    """keyword, rank, candidate, score: the k distinct candidates of the highest 0-100 ratio for each distinct
    keyword, as many keywords as there are; ties to the smaller candidate. Case does not count; null texts are left out."""
    entries = vocab.select("candidate").where("candidate is not null").distinct()
    asked = keywords.select("keyword").where("keyword is not null").distinct()
    rows, columns = (max(1, math.ceil(df.count() / SIDE)) for df in (asked, entries))
    q, c = on_grid(_pack(asked, "keyword", KEYWORDS, "q_ids"), _pack(entries, "candidate", ENTRIES, "c_ids"), rows, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked_for, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lowered = [t.lower() for t in texts]
                bins, lengths = _bins(lowered), np.array([len(t) for t in lowered])
                rows = [(w, c, float(s)) for w in asked_for for s, c in best(w, texts, lowered, bins, lengths, k)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["keyword", "candidate", "score"])

    lists = q.join(c, ["row", "column"]).select("q_ids", "c_ids").mapInArrow(run, "keyword string, candidate string, score double")
    by = Window.partitionBy("keyword").orderBy(F.desc("score"), "candidate")
    return lists.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("keyword", "rank", "candidate", "score")
