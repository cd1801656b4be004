"""Mixing sources to target weights with DataFrame operations only.

Words are summed by source, targets follow from weights with a ceiling on repetition, and each document
is emitted floor(rate) times plus once more with probability rate - floor(rate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, draw, without

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than space and the control characters 9 to 13; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Sources in code point order, null last, take ``weights`` in turn and share the sum of all sizes.
    No target is above ``ceiling`` times its source's size: ordered by size per unit of weight, a source
    is at its ceiling as long as its part of what the earlier ones left is not below that ceiling; the
    others share the rest by weight. The windows run over one row per source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w).cast("bigint") for w in weights])
    weighed = sizes.withColumn("_w", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    top = F.lit(ceiling) * F.col("source_size")
    left = weighed.select(
        "source",
        "source_size",
        "_w",
        F.sum("source_size").over(everything).alias("_all"),
        F.sum("_w").over(everything).alias("_all_w"),
        F.coalesce(F.sum(top).over(before), F.lit(0)).alias("_used"),
        F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_used_w"),
    ).withColumn("_full", top * (F.col("_all_w") - F.col("_used_w")) <= (F.col("_all") - F.col("_used")) * F.col("_w"))
    rest = left.withColumn("_rest", F.col("_all") - F.coalesce(F.sum(F.when(F.col("_full"), top)).over(everything), F.lit(0)))
    rest = rest.withColumn("_rest_w", F.col("_all_w") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_w"))).over(everything), F.lit(0)))
    shared = (F.col("_w") * F.col("_rest")).cast("double") / F.col("_rest_w").cast("double")
    return rest.select("source", "source_size", F.when(F.col("_full"), top.cast("double")).otherwise(shared).alias("target"))


def plan(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target and copies (how often the mix takes it).

    The draw depends on the seed and doc_id alone, so reruns agree and equal rows are treated alike. A
    source whose texts hold no word has target 0 and is not taken; a null source is a source; an empty
    table gives an empty one. Input columns with the added names are replaced. The table of sources is
    written first, so Spark knows its size and broadcasts it only below its own threshold; beyond that it
    joins by sorted source and splits a hot one.
    """
    docs = without(docs, "size", "source_size", "target", "copies")
    sizes = docs.select("source", word_count(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    sources = cut(source_targets(sizes, weights, ceiling), "mix-sources").withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = F.when(draw(seed, F.col("doc_id")) < rate - whole, 1).otherwise(0)
    joined = docs.withColumn("size", word_count(F.col("text"))).join(sources, F.col("source").eqNullSafe(F.col("_source")))
    return joined.withColumn("copies", F.least(whole + extra, F.lit(ceiling)).cast("bigint")).drop("_source")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed table: each row of ``docs`` as often as ``plan`` says, with the columns of ``docs``."""
    planned = plan(docs, **options).where(F.col("copies") > 0)
    return planned.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[f"`{c}`" for c in docs.columns])
