"""Official names in texts: joins by letter groups in both directions, first match by vocabulary order, first places.

That a name lies within a text is found without comparing all names with all texts. A name of Q letters or more is
known by one group of Q letters, the one that fewest texts have; a shorter one by all of it. Texts are looked up by
their groups of these lengths, and only pairs that share a name's group are compared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..sources.shared import freed, written

#: Letters of a group; hashes that a task counts at once; bits of a filter of hashes (1 MB), and of one row of it.
Q, HELD, BITS, PART = 4, 1 << 20, 1 << 23, 32768


def _hashes(text: str, q: int) -> np.ndarray:
    """A 64-bit hash of the group of ``q`` letters at each place of the text, in time by its length. Groups that share a
    hash cost time, no more: containment is looked at in the texts."""
    letters = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    n = max(len(letters) - q + 1, 0)
    h = np.full(n, q, np.uint64)
    for i in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + letters[i : n + i]
    return h


def _bits(h: np.ndarray) -> np.ndarray:
    return (h ^ h >> np.uint64(32)) & np.uint64(BITS - 1)


def _hashed(names: DataFrame) -> DataFrame:
    """(n, h, bit): the distinct hashes of each name's groups, which have Q letters, or all of a shorter name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                h = np.unique(_hashes(n, min(len(n), Q)))
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(_bits(h).astype(np.int64))], names=["n", "h", "bit"])

    return names.where(F.length("n") > 0).select("n").mapInArrow(run, "n string, h long, bit long")


def _marks(bits: DataFrame) -> Broadcast[np.ndarray]:
    """The bits (bit) as a bitmap of fixed size, by which tasks leave out most other groups; the joins that follow decide."""
    parts = bits.groupBy(F.floor(F.col("bit") / PART).alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % PART).alias("bits"))
    whole = np.zeros((BITS // PART, PART // 8), np.uint8)
    for part, some in parts.collect():  # BITS / PART rows at most
        whole[part] = np.frombuffer(some, np.uint8)
    return bits.sparkSession.sparkContext.broadcast(whole.ravel())


def _found(texts: DataFrame, marks: Broadcast[np.ndarray], lengths: Sequence[int], counted: bool) -> DataFrame:
    """(id, h): the marked hashes of each text (id, t); or, ``counted``, (h, c): how many of a task's texts have each. No
    row carries its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, held, size = np.unpackbits(marks.value, bitorder="little").view(bool), [], 0

        def out(ids: list[int]) -> pa.RecordBatch:
            h = np.concatenate(held or [np.empty(0, np.uint64)]).view(np.int64)
            if counted:
                h, c = np.unique(h, return_counts=True)
                return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], names=["h", "c"])
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), [len(x) for x in held])), pa.array(h)], names=["id", "h"])

        for batch in batches:
            ids: list[int] = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                some = [h[marked[_bits(h)]] for h in (_hashes(t, q) for q in lengths)]
                held.append(np.unique(np.concatenate(some)))
                ids.append(i)
                size += len(held[-1])
                if size >= HELD:
                    yield out(ids)
                    held, size, ids = [], 0, []
            if not counted:
                yield out(ids)
                held, size = [], 0
        yield out([])

    return texts.select("id", "t").where("t is not null").mapInArrow(run, "h long, c long" if counted else "id long, h long")


def within(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, n, at): all pairs of texts (id, t) and distinct names (n, not empty) in which the text contains the name, and
    its first place from 1. A text is joined by its id, so that it moves once, however many groups it has."""
    lengths = sorted(r["q"] for r in names.where(F.length("n") > 0).select(F.least(F.length("n"), F.lit(Q)).alias("q")).distinct().collect())  # Q rows at most
    if not lengths:
        return texts.select("id", F.col("t").alias("n"), F.lit(1).alias("at")).where("false")
    each = written(_hashed(names), "names-groups")
    counts = _found(texts, _marks(each), lengths, True).groupBy("h").agg(F.sum("c").alias("texts"))
    # A name with a group that no text has is in none: the left join makes that group its scarcest.
    scarcest = each.join(counts, "h", "left").groupBy("n").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "h", "bit")).alias("_m"))
    signed = written(scarcest.where("_m.texts > 0").select("n", "_m.h", "_m.bit"), "names-signed")
    pairs = _found(texts, _marks(signed), lengths, False).join(signed, "h").select("id", "n")
    return texts.select("id", "t").join(pairs, "id").select("id", "n", F.position(F.col("n"), F.col("t")).alias("at")).where("at > 0")


def _numbered(texts: DataFrame, name: str) -> DataFrame:
    """``texts`` with an id, written so that it stays, in parts enough for all cores."""
    cores = texts.sparkSession.sparkContext.defaultParallelism
    dealt = texts if texts.rdd.getNumPartitions() >= cores else texts.repartition(cores)
    return written(dealt.withColumn("id", F.monotonically_increasing_id()), name)


def first_match(texts: DataFrame, vocabulary: DataFrame, name: str, position: str) -> DataFrame:
    """texts (t), distinct and normalised -> (t, match): the name that equals it after normalising, else the first of
    those that hold it or that it holds, by ``position``. Texts without either are left out, and empty ones match nothing."""
    entries = vocabulary.select(normalize_text(F.col(name)).alias("n"), F.struct(F.col(position).alias("p"), F.col(name).alias("name")).alias("e"))
    entries = written(entries.where("n <> ''").groupBy("n").agg(F.min("e").alias("e")), "names-vocabulary")
    some = texts.where("t <> ''")
    exact = some.join(entries, some["t"] == entries["n"]).select("t", "e")
    rest = _numbered(some.join(exact.select("t"), "t", "left_anti"), "names-texts")
    holds = within(rest, entries.select("n")).join(entries, "n").groupBy("id").agg(F.min("e").alias("e")).join(rest, "id").select("t", "e")
    numbered = _numbered(entries.withColumnRenamed("n", "t"), "names-numbered")
    held = within(numbered, rest.select(F.col("t").alias("n"))).join(numbered.select("id", "e"), "id").select(F.col("n").alias("t"), "e")
    near = holds.unionByName(held).groupBy("t").agg(F.min("e").alias("e"))
    out = written(exact.unionByName(near).select("t", F.col("e.name").alias("match")), "names-matches")
    for table in (entries, rest, numbered):
        freed(table)
    return out


def align_to_official(said: DataFrame, name: str, vocabulary: DataFrame, official: str, position: str) -> DataFrame:
    """``said`` with aligned: the official name of its ``name`` (``first_match``), else the name as it is. Each
    distinct name is looked up once. Null stays null."""
    keyed = said.withColumn("_t", normalize_text(F.col(name)))
    found = first_match(keyed.select(F.col("_t").alias("t")).where("t is not null").distinct(), vocabulary, official, position)
    joined = keyed.join(found.withColumnRenamed("t", "_t"), "_t", "left")
    return joined.withColumn("aligned", F.coalesce("match", F.col(name))).drop("_t", "match")


def align_lists(said: DataFrame, key: Sequence[str], name: str, order: str, vocabulary: DataFrame, official: str, position: str) -> DataFrame:
    """(*key, aligned array): the aligned names of each key in ``order``, each (after normalising) once; names that
    normalise to nothing are left out."""
    known = align_to_official(said.where(normalize_text(F.col(name)) != ""), name, vocabulary, official, position)
    first = known.groupBy(*key, normalize_text(F.col("aligned")).alias("_k")).agg(F.min(F.struct(F.col(order).alias("o"), F.col("aligned").alias("a"))).alias("f"))
    return first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f.a).alias("aligned"))


def mentions(texts: DataFrame, key: str, text: str, vocabulary: DataFrame, official: str, position: str) -> DataFrame:
    """(key, name, at, place): official names that occur in each text after normalising, numbered by their first
    place, names at one place in vocabulary order; of names that normalise alike the first. Texts are read whole."""
    entries = vocabulary.select(normalize_text(F.col(official)).alias("n"), F.struct(F.col(position).alias("p"), F.col(official).alias("name")).alias("e"))
    entries = entries.where("n <> ''").groupBy("n").agg(F.min("e").alias("e"))
    keyed = _numbered(texts.select(F.col(key).alias("k"), normalize_text(F.col(text)).alias("t")).where("t <> ''"), "names-texts")
    found = within(keyed, entries.select("n")).join(entries, "n").join(keyed.select("id", "k"), "id")
    listed = found.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", "e.p", "e.name"))).alias("m"))
    return listed.select(F.col("k").alias(key), F.posexplode("m").alias("place", "m")).select(key, "m.name", "m.at", (F.col("place") + 1).alias("place"))
