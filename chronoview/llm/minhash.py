"""MinHash near-dedup by ProbMinHash over weighted word shingles.

Each shingle of a text is a Poisson process whose rate is its weight; every arrival falls on a random
register, and a register keeps the shingle that arrived first. Two texts agree in a register with the
probability Jaccard similarity of their weighted shingles. A shingle stops once its next arrival comes
later than every register's first. Bands of registers give candidates, which are then compared by the
exact Jaccard similarity of their sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free, maybe, schema_of, sided, slices, with_columns
from .near import link
from .words import U, Words, scramble

WORDS = 5
BANDS, ROWS = 20, 5
REGISTERS = BANDS * ROWS
#: Texts per pass: their number takes the upper bits of a shingle's 64.
PASS_BITS = 11
_STEP = U(0xD1B54A32D192ED03)


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle of 64 - PASS_BITS bits, times) of up to 2**PASS_BITS texts. A text of fewer than five words
    is one shingle; one without words has none."""
    words = Words(texts)
    doc, gram = words.grams(*range(1, WORDS))
    count = np.bincount(words.doc, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        start = np.searchsorted(words.doc, short)
        whole = [int(scramble(np.array([sum(int(h) * (k * 2 + 1) for k, h in enumerate(words.hash[s : s + count[d]])) & (2**64 - 1)], U))[0]) for d, s in zip(short, start, strict=True)]
        doc, gram = np.concatenate([doc, short]), np.concatenate([gram, np.array(whole, U)])
    packed = (doc.astype(U) << U(64 - PASS_BITS)) | (gram >> U(PASS_BITS))
    packed, times = np.unique(packed, return_counts=True)
    return (packed >> U(64 - PASS_BITS)).astype(np.int64), packed & U((1 << (64 - PASS_BITS)) - 1), times


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Registers (n x REGISTERS) of n texts: the shingle that arrives first at each; 0 where none does."""
    time = np.full(n * REGISTERS, np.inf)
    holder = np.zeros(n * REGISTERS, U)
    now = np.zeros(len(doc))
    turn = 0
    while len(doc):
        turn += 1
        bits = scramble(shingle * _STEP + U(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        now = now - np.log(((bits >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        slot = doc * REGISTERS + (scramble(bits) % U(REGISTERS)).astype(np.int64)
        np.minimum.at(time, slot, now)
        won = time[slot] == now
        holder[slot[won]] = shingle[won]
        some = np.unique(doc)
        latest = np.zeros(n)
        latest[some] = time.reshape(n, REGISTERS)[some].max(1)
        go = now < latest[doc]
        doc, shingle, weight, now = doc[go], shingle[go], weight[go], now[go]
    return holder.reshape(n, REGISTERS)


def bands(registers: np.ndarray) -> np.ndarray:
    """One number for each band of registers."""
    out = np.tile(np.arange(1, BANDS + 1, dtype=U), (len(registers), 1))
    for r in range(ROWS):
        out = scramble(out * _STEP + registers[:, r::ROWS])
    return out.view(np.int64)


def text_key(text: Column) -> Column:
    """The MD5 of a text; a null text counts as an empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _named(doc_id: str) -> Column:
    """doc_id as text, so that null is a value as well."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_doc")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of batches (..., text) that one pass can take, and their texts."""
    for batch in (x for b in batches for x in slices(b, "text", 1 << 20)):
        for part in (batch.slice(k, 1 << PASS_BITS) for k in range(0, batch.num_rows, 1 << PASS_BITS)):
            yield part, part.column(part.schema.get_field_index("text")).to_pylist()


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, bands): key is the MD5 of the text; texts without words have no bands. A shingle that
    occurs t times weighs 1 + ln t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _parts(batches):
            doc, shingle, times = shingles(texts)
            found = bands(signatures(doc, shingle, 1 + np.log(times), len(texts)))
            has = np.isin(np.arange(len(texts)), doc)
            at = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype(np.int32)
            own = pa.ListArray.from_arrays(pa.array(at), pa.array(found[has].ravel()))
            yield with_columns(part, ["text"], bands=own)

    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    return keyed.mapInArrow(run, f"{schema_of(keyed.drop('text'), 'bands array<bigint>')}")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(id, text) -> (id, h): the shingles of each text, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in _parts(batches):
            doc, shingle, _ = shingles(own)
            at = np.searchsorted(doc, np.arange(len(own) + 1)).astype(np.int32)
            order = np.argsort(doc, kind="stable")
            yield with_columns(part, ["text"], h=pa.ListArray.from_arrays(pa.array(at), pa.array(shingle[order].view(np.int64))))

    return texts.select("id", "text").mapInArrow(run, "id bigint, h array<bigint>")


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets have a Jaccard similarity of at least threshold."""
    one, two = (sided(sets, pairs, x).withColumnRenamed("h", f"h_{x}") for x in "ab")
    sized = pairs.join(one, "a").join(two, "b").where(F.least(F.size("h_a"), F.size("h_b")) >= threshold * F.greatest(F.size("h_a"), F.size("h_b")))
    enough = F.transform(F.array(F.size(F.array_intersect("h_a", "h_b"))), lambda n: (n > 0) & (n >= threshold * (F.size("h_a") + F.size("h_b") - n)))
    return sized.where(F.element_at(enough, 1)).select("a", "b")


def classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (MD5 of the text), class_id.

    class_id is the least doc_id of the class. Equal texts are one class, whatever their length (a null
    text equals an empty one); different texts are in one class if a chain of pairs joins them whose sets
    of five-word shingles have a Jaccard similarity of ``threshold`` or more. Pairs of different texts are
    candidates if they share a band, which at a probability Jaccard of 0.8 fails for 4 in 10,000 pairs.
    Words are in lower case and without punctuation. A class of rows without any doc_id has class_id null.
    """
    rows = cut(signed(docs), "near-rows")
    texts = cut(rows.groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("id", F.monotonically_increasing_id()), "near-texts")
    first = texts.select("key", _named("doc_id"), "id")  # one row of each text; its copies have other ids and so fall to other tasks
    one = rows.where(F.size("bands") > 0).select("key", _named("doc_id"), "bands").join(first, ["key", "_doc"])
    each = one.select("id", F.explode("bands").alias("bucket"))
    shared = cut(each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "near-shared")
    members = cut(maybe(each, shared, "bucket").join(shared, "bucket").distinct().select("bucket", "id"), "near-all")
    free(shared)
    wanted = cut(members.select("id").distinct().join(first, "id").withColumn("k", F.xxhash64("key")), "near-wanted")
    keyed = docs.select(_named("doc_id"), "text", text_key(F.col("text")).alias("key")).withColumn("k", F.xxhash64("key"))
    texted = maybe(keyed, wanted, "k").drop("k").join(wanted.drop("k").hint("shuffle_hash"), ["key", "_doc"])
    sets = cut(shingle_sets(texted.dropDuplicates(["key", "_doc"])), "near-sets")
    free(wanted)

    roots = link(members, lambda pairs: similar(pairs, sets, threshold), lambda ids: maybe(sets, ids, "id").join(ids, "id", "left_semi"), threshold)
    of_text = texts.join(roots, "id", "left").select("key", "doc_id", F.coalesce("root", "id").alias("root"))
    least = of_text.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return rows.select("doc_id", "key").join(of_text.join(least, "root").select("key", "class_id"), "key").select("doc_id", "key", "class_id")


def dedup(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the least doc_id. Repeated rows of that
    doc_id and text count once. Of a class without any doc_id one row stays."""
    found = cut(classes(docs, threshold), "near-classes-of-rows")
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("doc_id", "key").agg(F.count("*").alias("_n"))
    stay = cut(stay.withColumnRenamed("doc_id", "_doc").withColumnRenamed("key", "_key"), "near-stay")
    kept = docs.join(stay, F.col("doc_id").eqNullSafe(F.col("_doc")) & (text_key(F.col("text")) == F.col("_key")))
    if stay.where("_n > 1").limit(1).count():
        kept = kept.dropDuplicates(["_doc", "_key"])
    return kept.select(*[f"`{c}`" for c in docs.columns])
