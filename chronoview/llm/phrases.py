"""Phrase collocation mining by SETM: occurrence relations that are written, joined with themselves, counted and cut down.

The relation of length k holds where phrases of k words occur, sorted by piece and position; a row has the
words of a text in that order, and MARK where a piece ends or a place has dropped out. Occurrences of length k + 1 come
from a merge join of the relation of length k with itself, by piece and adjacent position: both sides are in the
same order, so the join is a walk over neighbours, and needs no shuffle. They are counted by group,
and the frequent groups are semi-joined with the relation before the next length, which is written to the
shared folder in its turn.

The semi-join goes by a bitmap of fixed size. It may let a place pass that is not frequent, which costs time,
and never drops one that is; counts are those of whole phrases, so the result is exact. In the same way phrases
are counted by a short hash first, for most of them are rare: only those whose hash is frequent are told apart by their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free, slices
from .words import U, scramble

LONGEST = 4
#: What separates pieces; no word holds it.
MARK = "."
#: Bytes of a text cut into words at a time (at the end of a piece), and words that are counted at a time.
BLOCK, WORDS = 4 << 20, 1 << 19
#: Bits of the bitmap: 8 MB, whatever the number of phrases; the part of it that one row of the aggregate holds.
BITS, PART = 1 << 26, 1 << 15
#: Phrases of more than one word are first counted by a hash of so many bits.
SLOTS = (1 << 40) - 1
_TABLE = bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _blocks(text: str) -> Iterator[bytes]:
    """The text as lower-case bytes with MARK at the end of each piece, in parts that end with a piece."""
    raw = text.encode("utf-8", "replace").translate(_TABLE)
    at = 0
    while len(raw) - at > BLOCK:
        end = raw.rfind(b".", at, at + BLOCK) + 1 or raw.find(b".", at + BLOCK) + 1 or len(raw)
        yield raw[at:end]
        at = end
    yield raw[at:]


def occurrences(docs: DataFrame) -> DataFrame:
    """(lang, n_words, words array<string>): the relation of length 1, one row for a text or a part of a long one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, "text")):
            langs, counts, flat, at = [], [], [], [0]
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for block in _blocks(text):
                    words = block.replace(b".", b" . ").split()
                    counts.append(len(words) - words.count(b"."))
                    langs.append(lang)
                    flat += words
                    at.append(len(flat))
            words = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(counts, pa.int64()), words], names=["lang", "n_words", "words"])

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "lang string, n_words bigint, words array<string>").where("n_words > 0")


def _hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, object), categorize=False) if words else np.zeros(0, U)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of its beginning and that of its last word."""
    return scramble(left * U(0x9E3779B97F4A7C15) + right)


class Places:
    """The words of one language in a row: which places hold a word, and hashes of the phrases that begin there."""

    def __init__(self, lang: str, words: pa.StringArray):
        self.lang = lang
        coded = words.dictionary_encode()
        self.words, self.ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = self.words.to_pylist()
        self.word = ~np.isin(self.ids, [i for i, w in enumerate(names) if w == MARK])
        self._hash, self._seed = _hashes(names)[self.ids], _hashes([lang])[0]

    def stand(self, k: int) -> np.ndarray:
        """Whether a phrase of k words begins at each place: words without a mark between."""
        n = len(self.ids) - k + 1
        return reduce(np.logical_and, [self.word[j : n + j] for j in range(k)]) if n > 0 else np.zeros(0, bool)

    def hashed(self, k: int) -> np.ndarray:
        n = max(0, len(self.ids) - k + 1)
        return reduce(_joined, [self._hash[j : n + j] for j in range(k)], np.full(n, self._seed))

    def frequent(self, k: int, sieve: np.ndarray) -> np.ndarray:
        """Whether a phrase of k words that the sieve lets pass begins at each place."""
        slot = self.hashed(k) & U(BITS - 1)
        return self.stand(k) & ((sieve[slot >> U(3)] >> (slot & U(7)).astype(np.uint8)) & 1).astype(bool)

    def slots(self, k: int, sieve: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of phrases of k words and how often each occurs."""
        return np.unique(self.hashed(k)[self.grown(k, sieve)] & U(SLOTS), return_counts=True)

    def grown(self, k: int, sieve: np.ndarray | None) -> np.ndarray:
        """Places of phrases of k words: two of k - 1 that the sieve lets pass, at adjacent positions."""
        if sieve is None:
            return self.stand(k)
        shorter = self.frequent(k - 1, sieve)
        return shorter[:-1] & shorter[1:]

    def counted(self, k: int, sieve: np.ndarray | None, own: np.ndarray | None) -> tuple[pa.Array, np.ndarray]:
        """Phrases of k words (joined by spaces) that ``own`` lets pass and how often each occurs."""
        grown = self.grown(k, sieve)
        at = np.flatnonzero(grown if own is None else grown & self.frequent(k, own))
        key, size = self.ids[at], len(self.words)
        for j in range(1, k):
            key, inverse = np.unique(key, return_inverse=True)
            key = inverse * size + self.ids[at + j]
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        where = at[first]
        parts = [self.words.take(pa.array(self.ids[where + j])) for j in range(k)]
        return pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0], times

    def cut_down(self, k: int, sieve: np.ndarray) -> pa.StringArray:
        """The words of phrases of k + 1 words that may be frequent, and one mark for what lies between."""
        at = self.grown(k + 1, sieve)
        keep = np.zeros(len(self.ids), bool)
        for j in range(k + 1):
            keep[j : j + len(at)] |= at
        ids = np.where(keep, self.ids, len(self.words))
        shown = keep | np.r_[True, keep[:-1]]
        return pa.concat_arrays([self.words, pa.array([MARK])]).take(pa.array(ids[shown]))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[Places]:
    """Words by language, about WORDS at a time, with marks between texts."""
    held: dict[str, list[pa.Array]] = {}
    sizes: dict[str, int] = {}
    mark = pa.array([MARK])

    def out(lang: str) -> Places:
        sizes.pop(lang)
        return Places(lang, pa.concat_arrays(held.pop(lang)))

    for batch in batches:
        langs, lists = batch.column(0).to_pylist(), batch.column(1)
        for i, lang in enumerate(langs):
            words = lists[i].values
            held.setdefault(lang, []).extend([words, mark])
            sizes[lang] = sizes.get(lang, 0) + len(words)
            if sizes[lang] >= WORDS:
                yield out(lang)
            elif sum(sizes.values()) >= 4 * WORDS:
                yield from map(out, list(held))
    yield from map(out, list(held))


def _bitmap(slots: DataFrame) -> Broadcast[np.ndarray]:
    """Hashes (slot) as a bitmap of BITS."""
    bit = F.col("slot").bitwiseAND(F.lit(BITS - 1))
    parts = slots.groupBy(F.floor(bit / PART).alias("part")).agg(F.bitmap_construct_agg(bit % PART).alias("bits"))
    out = np.zeros((BITS // PART, PART // 8), np.uint8)
    for part, bits in parts.collect():  # BITS / PART rows at most
        out[part] = np.frombuffer(bits, np.uint8)
    return slots.sparkSession.sparkContext.broadcast(out.ravel())


def _slots(phrases: DataFrame, k: int) -> DataFrame:
    """The hashes of phrases (lang, phrase) of k words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = _hashes(batch.column(0).to_pylist())
            words = _hashes([w for p in batch.column(1).to_pylist() for w in p.split(" ")]).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([pa.array((reduce(_joined, list(words.T), seeds) & U(SLOTS)).astype(np.int64))], names=["slot"])

    return phrases.select("lang", "phrase").mapInArrow(run, "slot bigint")


def _frequent_slots(relation: DataFrame, k: int, least: int, sieve: Broadcast[np.ndarray]) -> DataFrame:
    """The hashes that phrases of k words have ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for places in _gathered(batches):
            slot, times = places.slots(k, sieve.value)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(times, pa.int64())], names=["slot", "f"])

    counts = relation.select("lang", "words").mapInArrow(run, "slot bigint, f bigint")
    return counts.groupBy("slot").agg(F.sum("f").alias("f")).where(F.col("f") >= least).select("slot")


def frequent(relation: DataFrame, k: int, least: int, sieve: Broadcast[np.ndarray] | None) -> DataFrame:
    """(lang, phrase, f) of phrases of k words that occur ``least`` times or more; sieve: the phrases of k - 1 words
    that may."""
    own = None if sieve is None else _bitmap(_frequent_slots(relation, k, least, sieve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [b and b.value for b in (sieve, own)]
        for places in _gathered(batches):
            phrase, times = places.counted(k, *seen)
            yield pa.RecordBatch.from_arrays([pa.array([places.lang] * len(times), pa.string()), phrase, pa.array(times, pa.int64())], names=["lang", "phrase", "f"])

    counts = relation.select("lang", "words").mapInArrow(run, "lang string, phrase string, f bigint")
    return counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def semi_joined(relation: DataFrame, k: int, sieve: Broadcast[np.ndarray]) -> DataFrame:
    """The relation of length k without the places that no frequent phrase of k + 1 words can cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for places in _gathered(batches):
            words = places.cut_down(k, sieve.value)
            yield pa.RecordBatch.from_arrays([pa.array([places.lang]), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)], names=["lang", "words"])

    return relation.select("lang", "words").mapInArrow(run, "lang string, words array<string>").where(F.size("words") > k)


def scored(found: DataFrame) -> DataFrame:
    """(lang, m, phrase, f) of all frequent phrases -> lang, m, phrase, a, l, r, score: the cut of lowest score of
    each candidate, ties to the earliest. Sums and products are decimals of 38 digits."""
    cuts = found.where("m > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    first, rest = "substring_index(phrase, ' ', k)", "substring(phrase, length(substring_index(phrase, ' ', k)) + 2)"
    parts = cuts.select("lang", "m", "phrase", F.col("f").alias("a"), "k", F.expr(first).alias("first"), F.expr(rest).alias("rest"))
    of = lambda x, n: found.select("lang", F.col("phrase").alias(x), F.col("f").alias(n))
    both = parts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    score = F.expr("2000000 * cast(a as decimal(28, 0)) div (cast(l as decimal(28, 0)) + cast(r as decimal(28, 0)))")
    lowest = both.withColumn("score", score).groupBy("lang", "m", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "m", "phrase", "a", "cut.l", "cut.r", "cut.score")


def contained(found: DataFrame) -> DataFrame:
    """(lang, phrase, most): of each phrase inside longer candidates the highest count of one of these."""
    words = F.split("phrase", " ", -1)
    spans = F.expr("flatten(transform(sequence(2, m - 1), n -> transform(sequence(0, m - n), i -> named_struct('i', i, 'n', n))))")
    inner = found.where("m > 2").select("lang", "f", words.alias("w"), F.explode(spans).alias("s"))
    return inner.groupBy("lang", F.expr("array_join(slice(w, s.i + 1, s.n), ' ')").alias("phrase")).agg(F.max("f").alias("most"))


def mine(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language, by score, a and phrase.

    docs has lang and text; other columns are not looked at. A null text counts as an empty one, a null lang as
    ``und``; repeated rows count each; an empty table gives no rows. Texts of any length are read whole; a task
    holds a text and one piece of it as words.
    """
    relation = cut(occurrences(docs), "phrases-1")
    total = cut(relation.groupBy("lang").agg(F.sum("n_words").alias("n")), "phrases-total")
    levels = [cut(frequent(relation, 1, least, None), "phrases-frequent")]
    for k in range(2, LONGEST + 1):
        sieve = _bitmap(_slots(levels[-1], k - 1))
        if k > 2:
            following = cut(semi_joined(relation, k - 1, sieve), f"phrases-{k - 1}")
            free(relation)
            relation = following
        levels.append(cut(frequent(relation, k, least, sieve), "phrases-frequent"))
    free(relation)
    found = reduce(DataFrame.unionByName, [level.withColumn("m", F.lit(k)) for k, level in enumerate(levels, 1)])
    kept = scored(found).join(contained(found), ["lang", "phrase"], "left")
    large = lambda c: F.col(c).cast("decimal(28,0)")
    kept = kept.where(F.col("most").isNull() | (100 * large("most") < share * large("a")))
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
