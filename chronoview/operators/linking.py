"""Linking each text to the one text most like it: an exact top-1 similarity join over word sets.

Words are put in one order for all texts, the rarest first. Two sets of x and y words have Jaccard similarity b or
more only if they share o = b / (1 + b) (x + y) words, so one of their common words is among the first x - o + 1 of the
one and the first y - o + 1 of the other. The rarest few words of a text find some texts like it; the best of
these is its bound b. All texts that could be as good share a word of those first ones, have a fitting number of words,
and bitmaps that differ in few enough bits; only these pairs are compared. The most frequent words
of a text are so left out of the join, more of them the better its bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import freed, written

#: Rarest words that find the first candidates of a text, and how many of these are compared for its bound.
SEEDS, TRIED = 6, 4
#: 64-bit words of a bitmap.
LONGS = 4
#: What doubles may lose in a product of a similarity and a count.
SLACK = 1e-9


def report_tokens(text: Column, marker: str | None = "FINAL REPORT", word: str = r"(?U)\w+") -> Column:
    """The distinct lower-case words after the first ``marker`` (in any case), or of all the text where there is none."""
    body = text
    if marker is not None:
        at = F.position(F.lit(marker.lower()), F.lower(text))
        body = F.when(at > 0, F.substring(text, at + len(marker), F.length(text))).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(body, F.lit(""))), F.lit(word), F.lit(0)))


def _sets(texts: DataFrame, own: str, block: Sequence[str]) -> DataFrame:
    """(*block, id, tokens): distinct words, which is worked out before anything is exploded."""
    each = texts.select(*block, F.col(own).alias("id"), F.array_compact(F.array_distinct("tokens")).alias("tokens"))
    return each.where(F.size("tokens") > 0)


def _ordered(sets: DataFrame, frequency: DataFrame, block: Sequence[str], how: str = "left") -> DataFrame:
    """(*block, id, n, m, words, unknown, b0, b1, ...): how many words a text has, and of those that are kept by the join
    (``how``) with ``frequency`` the number m, the words from the rarest on, how many of them no right text has, and the bitmap."""
    words = sets.select(*block, "id", F.size("tokens").alias("n"), F.explode("tokens").alias("t")).join(frequency, "t", how)
    bit = F.pmod(F.xxhash64("t"), F.lit(64 * LONGS))
    mask = [F.bit_or(F.when(F.floor(bit / 64) == i, F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int"))).otherwise(F.lit(0).cast("bigint"))).alias(f"b{i}") for i in range(LONGS)]
    listed = F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "t")))
    grouped = words.groupBy(*block, "id", "n").agg(listed.alias("w"), *mask)
    unknown = F.size(F.filter("w", lambda x: x.f == 0))
    return grouped.select(*block, "id", "n", F.size("w").alias("m"), F.transform("w", lambda x: x.t).alias("words"), unknown.alias("unknown"), *[f"b{i}" for i in range(LONGS)])


def _side(rows: DataFrame, x: str, block: Sequence[str], *more: str) -> DataFrame:
    """The columns of one side of a pair under names of their own."""
    return rows.select(*block, F.col("id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in more])


def _needed(bound: Column) -> Column:
    """Words that a pair must share to reach the bound; at least one."""
    return F.greatest(F.lit(1), F.ceil(bound / (1 + bound) * (F.col("l_n") + F.col("r_n")) - SLACK))


def _compared(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r) -> (l, r, score): the exact similarity."""
    both = pairs.join(_side(right, "r", (), "n", "words"), "r").join(_side(left, "l", (), "n", "words"), "l")
    shared = both.select("l", "r", "l_n", "r_n", F.size(F.array_intersect("l_words", "r_words")).alias("_c"))
    return shared.select("l", "r", (F.col("_c") / (F.col("l_n") + F.col("r_n") - F.col("_c"))).alias("score"))


def _bounds(left: DataFrame, postings: DataFrame, right: DataFrame, block: Sequence[str]) -> DataFrame:
    """(l, bound): the best similarity among the texts that share most of the rarest words."""
    rare = left.select(*block, F.col("id").alias("l"), F.explode(F.slice("words", F.col("unknown") + 1, SEEDS)).alias("t"))
    met = rare.join(postings.select(*block, "t", "r", "r_n"), [*block, "t"]).groupBy("l", "r", "r_n").agg(F.count("*").alias("c"))
    by = Window.partitionBy("l").orderBy(F.desc("c"), "r_n", "r")
    some = met.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= TRIED).select("l", "r")
    return _compared(some, left, right).groupBy("l").agg(F.max("score").alias("bound"))


def candidates(left: DataFrame, right: DataFrame, bounds: DataFrame, block: Sequence[str]) -> DataFrame:
    """(l, r): all pairs that may be as similar as the left text's bound."""
    masks = [f"b{i}" for i in range(LONGS)]
    bounded = left.join(bounds.withColumnRenamed("l", "id"), "id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
    first = F.col("n") - F.greatest(F.lit(1), F.ceil(F.col("bound") * F.col("n") - SLACK)) + 1 - F.col("unknown")
    prefix = bounded.where(first > 0).select(*block, F.col("id").alias("l"), F.col("n").alias("l_n"), "bound", F.col("unknown").alias("_from"), *[F.col(m).alias(f"l_{m}") for m in masks], F.posexplode(F.slice("words", F.col("unknown") + 1, first.cast("int"))).alias("_i", "t"))
    postings = right.select(*block, F.col("id").alias("r"), F.col("n").alias("r_n"), F.col("m").alias("r_m"), *[F.col(m).alias(f"r_{m}") for m in masks], F.posexplode("words").alias("_j", "t"))
    met = prefix.withColumn("_i", F.col("_i") + F.col("_from")).join(postings, [*block, "t"])
    needed = _needed(F.col("bound"))
    unlike = sum((F.bit_count(F.col(f"l_{m}").bitwiseXOR(F.col(f"r_{m}"))) for m in masks[1:]), F.bit_count(F.col("l_b0").bitwiseXOR(F.col("r_b0"))))
    fits = (F.col("_i") + needed <= F.col("l_n")) & (F.col("_j") + needed <= F.col("r_m"))
    fits &= (F.least("l_n", "r_m") >= needed) & (F.col("l_n") + F.col("r_m") - unlike >= 2 * needed)
    return met.where(fits).select("l", "r").distinct()


def link_reports(left: DataFrame, right: DataFrame, left_id: str, right_id: str, block: Sequence[str] = ()) -> DataFrame:
    """The right text of highest word-token Jaccard for each left one, if it is above zero and unique.

    left and right: (*block, id, tokens array); only texts of one block (say, a subject) are compared. Ids are
    unique on each side. Null and empty arrays, null words and null blocks are like nothing. Exact: a pair is left out only
    where it is proven to be less similar than one that is compared.
    """
    l_sets, r_sets = _sets(left, left_id, block), _sets(right, right_id, block)
    # Words that no left text has count for a right text's size alone: they are neither shuffled nor written.
    asked = written(l_sets.select(F.explode("tokens").alias("t")).distinct(), "link-asked")
    frequency = written(r_sets.select(F.explode("tokens").alias("t")).join(asked, "t", "left_semi").groupBy("t").agg(F.count("*").alias("f")), "link-frequency")
    lefts, rights = (written(_ordered(s, frequency, block, how), f"link-{x}") for s, x, how in ((l_sets, "left", "left"), (r_sets, "right", "inner")))
    freed(asked)
    freed(frequency)
    postings = rights.select(*block, F.col("id").alias("r"), F.col("n").alias("r_n"), F.explode("words").alias("t"))
    bounds = written(_bounds(lefts, postings, rights, block), "link-bounds")
    pairs = written(candidates(lefts, rights, bounds, block), "link-pairs")
    scored = _compared(pairs, lefts, rights).where("score > 0")
    best = scored.groupBy("l").agg(F.max(F.struct("score", "r")).alias("top"), F.min(F.struct(-F.col("score"), "r")).alias("low"))
    unique = best.where(F.col("top.r") == F.col("low.r"))
    return unique.select(F.col("l").alias(left_id), F.col("top.r").alias(right_id), F.col("top.score").alias("score"))
