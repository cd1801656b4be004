"""Toxicity: logistic regression over hashed word n-grams and skip-grams, learned by FTRL-proximal.

FTRL-proximal keeps a rate per coordinate and holds coordinates at zero until their gradients outweigh
the L1 term, so the weights that come out are few and go to every task. Besides words, pairs and pairs
with one word between, the features have the first letters of words, which inflected forms share.
A feature counts once per text, so a long text is not more toxic for its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, draw, schema_of, slices, with_columns, without
from .words import U, Words, scramble

BITS = 20
STEMS = (3, 4, 5, 6)


def _arrays(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, coordinate) of one kind of feature after another."""
    words = Words(texts, STEMS)
    for doc, h in [(words.doc, words.hash), *[(words.doc, words.stem[n]) for n in STEMS], words.grams(1), words.grams(2)]:
        yield doc, (scramble(h) >> U(64 - BITS)).astype(np.int64)


def features(texts: list[str | None], at_once: int = 100) -> list[np.ndarray]:
    """The coordinates of each text, each once."""
    out: list[np.ndarray] = []
    for k in range(0, len(texts), at_once):
        part = texts[k : k + at_once]
        pair = np.unique(np.concatenate([(doc << BITS) | at for doc, at in _arrays(part)]))
        at = (pair & ((1 << BITS) - 1)).astype(np.int32)
        out += np.split(at, np.searchsorted(pair, np.arange(1, len(part), dtype=np.int64) << BITS))
    return out


def ftrl(texts: list[np.ndarray], label: np.ndarray, epochs: int = 6, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights (2**BITS) and bias, from one pass per epoch over the texts in their order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bz, bn = 0.0, 0.0
    for _ in range(epochs):
        for k, y in zip(texts, label, strict=True):
            zk, nk = z[k], n[k]
            root = np.sqrt(nk)
            w = np.where(np.abs(zk) > l1, (np.sign(zk) * l1 - zk) / ((beta + root) / alpha + l2), 0.0)
            b = -bz / ((beta + bn**0.5) / alpha)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            z[k] = zk + g - (np.sqrt(nk + g * g) - root) / alpha * w
            n[k] = nk + g * g
            bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / alpha * b
            bn += g * g
    weights = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    return weights, -bz / ((beta + bn**0.5) / alpha)


def held_out(doc_id: Column) -> Column:
    """The third of the rows that no label is learned from: crc32 of doc_id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_labels(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, y): labels to learn from, about ``max_rows`` of them, chosen by hash; one per doc_id."""
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    usable = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = usable.count()
    return usable if n <= max_rows else usable.where(draw(f"sample-{label}", F.col("doc_id")) < max_rows / n)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000) -> tuple[np.ndarray, float]:
    """Weights from a hash sample of about ``max_rows`` labelled texts, which bounds what the one learning
    task reads. Rows that repeat a doc_id count once, with the least text. Without labels of both kinds, as
    of empty tables, all weights and the bias are 0."""
    chosen = cut(sample_labels(labels, "toxic", max_rows), "toxic-sample")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(order=scramble(rows["doc_id"].to_numpy().astype(np.int64).view(U))).sort_values("order")
        label = rows["y"].to_numpy(float)
        weights, bias = ftrl(features(rows["text"].tolist()), label) if 0 < label.sum() < len(label) else (np.zeros(1 << BITS), 0.0)
        k = np.flatnonzero(weights)
        return pd.DataFrame({"at": np.append(k, -1), "w": np.append(weights[k], bias)})

    learned = texts.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn, "at long, w double").toPandas()
    weights, own = np.zeros(1 << BITS), learned["at"] >= 0
    weights[learned["at"][own]] = learned["w"][own]
    return weights, float(learned["w"][~own].sum())


def score(docs: DataFrame, weights: np.ndarray, bias: float, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds score in [0, 1]. Whole texts are read; a null or empty text has the score of the bias alone."""
    source = without(docs, "score")
    at = np.flatnonzero(weights)
    model = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weights[at]))
    kept = source if keep_text else without(source, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS)
        dense[model.value[0]] = model.value[1]
        for batch in (x for b in batches for x in slices(b, text, 1 << 20)):
            sums = sums_of(batch.column(batch.schema.get_field_index(text)).to_pylist(), dense)
            value = 1.0 / (1.0 + np.exp(-np.clip(sums + bias, -35, 35)))
            yield with_columns(batch, [] if keep_text else [text], score=pa.array(value))

    return source.mapInArrow(run, schema_of(kept, "score double"))


def sums_of(texts: list[str | None], dense: np.ndarray) -> np.ndarray:
    """Per text the sum of the weights of its features. Coordinates of weight 0, nearly all, fall out first."""
    doc, at = [], []
    for d, where in _arrays(texts):
        some = dense[where] != 0
        doc.append(d[some])
        at.append(where[some])
    pair = np.unique((np.concatenate(doc) << BITS) | np.concatenate(at))
    return np.bincount(pair >> BITS, dense[pair & ((1 << BITS) - 1)], len(texts))[: len(texts)]
