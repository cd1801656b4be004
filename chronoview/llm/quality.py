"""Quality of documents: a linear-chain conditional random field labels every line good or bad.

Each line is described by shares of kinds of characters and by repetition, and by the same of its
neighbours. Forward-backward gives each line's probability of being good; their mean, weighted by line
length, is the score. Lines of a labelled document all have its label for training.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, schema_of, slices, with_columns, without
from .toxicity import sample_labels
from .words import U, Words

_b = np.arange(256)
#: Kinds of bytes; letters beyond ASCII count at their first byte.
KINDS = {
    "upper": (_b >= 65) & (_b <= 90),
    "lower": (_b >= 97) & (_b <= 122),
    "other": _b >= 0xC0,
    "digit": (_b >= 48) & (_b <= 57),
    "space": (_b == 32) | (_b == 9),
    "stop": np.isin(_b, list(b".,;:?'\"-()")),
}
KINDS["symbol"] = ~np.any(list(KINDS.values()), axis=0) & (_b < 128) & (_b > 32)


#: Lines that are described at a time.
CHUNK = 1 << 14


def describe(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Length in characters of each line, and a row of features of its own."""
    encoded = [line.encode() for line in lines]
    b = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    ends = np.cumsum([len(e) + 1 for e in encoded])
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[ends - 1] - total[begins]).astype(float)

    shares = {k: per_line(m[b]) for k, m in KINDS.items()}
    # capitals of two bytes, such as those with accents
    shares["upper"] += per_line(np.concatenate([(b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E), [False]]))
    length = per_line((b & 0xC0) != 0x80)
    size = np.maximum(length, 1)
    words = Words(lines)
    n = np.bincount(words.doc, minlength=len(lines)).astype(float)
    same = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    again = np.bincount(words.doc[1:][same], minlength=len(lines))
    line_word = np.unique(words.doc.astype(U) << U(40) | words.hash >> U(24))
    distinct = np.bincount((line_word >> U(40)).astype(np.int64), minlength=len(lines))
    letters = np.maximum(shares["upper"] + shares["lower"] + shares["other"], 1)
    own = np.column_stack([
        *[shares[k] / size for k in KINDS],
        shares["upper"] / letters,
        again / np.maximum(n - 1, 1),
        1 - distinct / np.maximum(n, 1),
        np.log1p(length) / 8,
        np.log1p(n) / 6,
        np.minimum(size / np.maximum(n, 1), 30) / 30,
        length == 0,
    ])
    return length, own


class Lines:
    """The lines of texts: where each text's begin, how many there are, lengths, and what ``use`` makes of the
    features of a chunk of lines, one row each. A line's whole row ``x`` is its own features, those of the
    line before, those of the line after (0 at the ends of a text), and 1."""

    def __init__(self, texts: list[str | None], use: Callable[[np.ndarray], np.ndarray] = lambda own: own):
        parts = [(t or "").split("\n") for t in texts]
        self.count = np.array([len(p) for p in parts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.count)])[:-1].astype(np.int64)
        lines = [line for p in parts for line in p]
        lengths, used = [np.zeros(0)], []
        for k in range(0, max(1, len(lines)), CHUNK):
            length, own = describe(lines[k : k + CHUNK] or [""])
            lengths.append(length)
            used.append(use(own))
        self.length = np.concatenate(lengths)[: len(lines)]
        self.used = np.concatenate(used)[: len(lines)]

    def beside(self, values: np.ndarray, step: int) -> np.ndarray:
        """Of each line the value of the line before (step 1) or after (-1) in its text, 0 where there is none."""
        out = np.zeros_like(values)
        if step > 0:
            out[1:] = values[:-1]
            out[self.start] = 0
        else:
            out[:-1] = values[1:]
            out[self.start + self.count - 1] = 0
        return out

    def x(self) -> np.ndarray:
        return np.column_stack([self.used, self.beside(self.used, 1), self.beside(self.used, -1), np.ones(len(self.used))])


def line_scores(texts: list[str | None], theta: np.ndarray) -> tuple[Lines, np.ndarray]:
    """The lines of texts, and what each says of itself. Three numbers a line are kept, not its features."""
    n = (len(theta) - 6) // 3
    by_place = np.column_stack([theta[:n], theta[n : 2 * n], theta[2 * n : 3 * n]])
    lines = Lines(texts, lambda own: own @ by_place)
    own, before, after = lines.used.T
    return lines, own + lines.beside(before, 1) + lines.beside(after, -1) + theta[3 * n]


def marginals(s: np.ndarray, t: np.ndarray, first: float, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once, in log odds of good against bad.

    s: what each line says of itself; t[i, j]: weight of going from i to j; first: weight of a good first
    line. Returns the probability of good, and the forward and backward log odds.
    """
    order = np.argsort(-count, kind="stable")
    start, count = start[order], count[order]
    live = [int(np.searchsorted(-count, -p, "left")) for p in range(int(count.max(initial=0)))]
    a, b = np.empty_like(s), np.zeros_like(s)
    several = max(1, sum(n > 1 for n in live))  # places that more than one chain has
    for p, n in enumerate(live[:several]):
        i = start[:n] + p
        a[i] = s[i] + (first if p == 0 else np.logaddexp(a[i - 1] + t[1, 1], t[0, 1]) - np.logaddexp(a[i - 1] + t[1, 0], t[0, 0]))
    if len(live) > several:  # the rest of the longest chain
        i, end = int(start[0]) + several, int(start[0]) + len(live)
        a[i:end] = _along(float(a[i - 1]), s[i:end].tolist(), t.T.tolist())
        behind = _along(0.0, [0.0] + s[i:end][::-1].tolist(), t.tolist(), after=True)
        b[i - 1 : end] = behind[::-1]
    for p in range(several - 1, 0, -1):
        i = start[: live[p]] + p
        out = s[i] + b[i]
        b[i - 1] = np.logaddexp(out + t[1, 1], t[1, 0]) - np.logaddexp(out + t[0, 1], t[0, 0])
    return 1 / (1 + np.exp(-np.clip(a + b, -35, 35))), a, b


def _along(value: float, own: list[float], t: list[list[float]], after: bool = False) -> list[float]:
    """One chain, place by place. t[i][j]: weight of i here and j where the value comes from. Own weights are
    added after each step, or, with ``after``, before it; then the first of them stands for the end."""
    out = []
    exp, log1p = math.exp, math.log1p
    for k, x in enumerate(own):
        if after:
            value += x if k else 0.0
            if not k:
                out.append(value)
                continue
        p, q, r, u = value + t[1][1], t[1][0], value + t[0][1], t[0][0]
        value = max(p, q) + log1p(exp(-abs(p - q))) - max(r, u) - log1p(exp(-abs(r - u)))
        if not after:
            value += x
        out.append(value)
    return out


def fit(texts: list[str | None], label: np.ndarray, steps: int = 100, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Weights by Adam on the mean log likelihood of the label sequences; each document counts once.
    The vector holds the line weights, then t (4), then first."""
    lines = Lines(texts)
    x = lines.x()
    f = x.shape[1]
    mean, spread = x.mean(0), x.std(0)
    mean[-1], spread = 0, np.where(spread > 1e-9, spread, 1)
    x = (x - mean) / spread
    doc = np.repeat(np.arange(len(texts)), lines.count)
    y, share = label[doc], 1.0 / lines.count[doc] / len(texts)
    inner = np.ones(len(doc), bool)
    inner[lines.start] = False
    at = np.flatnonzero(inner)
    theta, m, v = np.zeros(f + 5), np.zeros(f + 5), np.zeros(f + 5)
    for step in range(1, steps + 1):
        s, t = x @ theta[:f], theta[f : f + 4].reshape(2, 2)
        p, a, b = marginals(s, t, theta[f + 4], lines.start, lines.count)
        g = np.empty_like(theta)
        g[:f] = ((y - p) * share) @ x
        joint = np.stack([i * a[at - 1] + t[i, j] + j * (s[at] + b[at]) for i in (0, 1) for j in (0, 1)])
        joint = np.exp(joint - joint.max(0))
        joint /= joint.sum(0)
        for k, (i, j) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
            g[f + k] = (((y[at - 1] == i) & (y[at] == j)) - joint[k]) @ share[at]
        g[f + 4] = ((y - p) * share)[lines.start].sum()
        g -= decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    theta[:f] /= spread
    theta[f - 1] -= mean @ theta[:f]
    return theta


def quality(texts: list[str | None], theta: np.ndarray) -> np.ndarray:
    """The score of each text: the mean of its lines' probabilities by length; of a text without any
    character, that of its empty line."""
    lines, s = line_scores(texts, theta)
    p, _, _ = marginals(s, theta[-5:-1].reshape(2, 2), theta[-1], lines.start, lines.count)
    weight = lines.length + 1e-9
    return np.add.reduceat(p * weight, lines.start) / np.add.reduceat(weight, lines.start) if len(texts) else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 3000) -> np.ndarray:
    """Weights from a hash sample of about ``max_rows`` labelled texts; this bound holds for what the one
    training task reads. Rows that repeat a doc_id count once, with the least text. Without labels of both
    kinds, as of empty tables, the weights are 0 and every score is 0.5."""
    chosen = cut(sample_labels(labels, "quality", max_rows), "quality-sample")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        y = rows["y"].to_numpy(np.int64)
        return pd.DataFrame({"theta": [fit(rows["text"].tolist(), y).tolist() if 0 < y.sum() < len(y) else []]})

    found = texts.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn, "theta array<double>").collect()
    width = Lines([""]).x().shape[1] + 5
    return np.array(found[0][0]) if found and found[0][0] else np.zeros(width)


def score(docs: DataFrame, theta: np.ndarray, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds score in [0, 1], from whole texts of any length, whose lines are described CHUNK at a time. A null
    text counts as an empty one; equal rows score alike; an empty table gives an empty one; an input column
    named score is replaced."""
    source = without(docs, "score")
    kept = source if keep_text else without(source, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, text, 1 << 20)):
            value = quality(batch.column(batch.schema.get_field_index(text)).to_pylist(), theta)
            yield with_columns(batch, [] if keep_text else [text], score=pa.array(value))

    return source.mapInArrow(run, schema_of(kept, "score double"))
