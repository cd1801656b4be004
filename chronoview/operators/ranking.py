"""Ranking: latest rows, recent rows, budgets, samples, runs, streaks, retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import seeded
from .search import nearest


def global_rank(df: DataFrame, value: str, *ties: str, parts: int = 256) -> DataFrame:
    """Adds rank from 0, by value from the highest down, without a window over all rows: approximate
    quantiles cut the values into parts, rows are ranked within theirs and shifted by the parts above."""
    cuts = df.agg(F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10_000)).alias("_cuts"))
    placed = df.crossJoin(F.broadcast(cuts)).withColumn("_part", F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c < F.col(value)))).drop("_cuts")
    above = placed.groupBy("_part").agg(F.count("*").alias("_c")).select("_part", F.coalesce(F.sum("_c").over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc(value), *ties)) - 1
    return placed.withColumn("_own", own).join(F.broadcast(above), "_part").withColumn("rank", F.col("_own") + F.col("_above")).drop("_part", "_own", "_above")


def latest_records(view: DataFrame, time: str, key: str = "qid") -> DataFrame:
    """All rows of each question that share its last time; rows without time never are."""
    last = view.groupBy(key).agg(F.max(time).alias("_t"))
    return view.join(last, key).where(F.col(time) == F.col("_t")).drop("_t")


def recent_top_k(view: DataFrame, k: int, times: Sequence[str], position: str, key: str = "qid") -> DataFrame:
    """The k rows of each question with the greatest row-wise last time, ties by position; without clocks,
    the last k rows by position."""
    order = [F.greatest(*times).desc_nulls_last() if len(times) > 1 else F.col(times[0]).desc_nulls_last(), F.col(position)] if times else [F.desc(position)]
    return view.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def latest_n(view: DataFrame, n: int, time: str, position: str, key: str = "qid") -> DataFrame:
    """The tail of a stable sort by ``time``; adds shown and total per question."""
    ranked = view.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(time).desc_nulls_last(), F.desc(position)))).where(F.col("_n") <= n)
    total = view.groupBy(key).agg(F.count("*").alias("total"))
    return ranked.drop("_n").join(total, key).withColumn("shown", F.least(F.lit(n), "total"))


def fit_to_budget(view: DataFrame, cost: Column, budget: int, time: str, key: str = "qid") -> DataFrame:
    """The widest window of latest times whose cost fits; cuts only between times, rows without time stay.

    Costs are summed per time first, so the window runs over distinct times. Row costs add up, which bounds
    a rendering that shares headers between rows from above.
    """
    priced = view.withColumn("_cost", cost)
    fixed = priced.where(F.col(time).isNull()).groupBy(key).agg(F.sum("_cost").alias("_fixed"))
    per = priced.where(F.col(time).isNotNull()).groupBy(key, time).agg(F.sum("_cost").alias("_c"))
    run = per.withColumn("_run", F.sum("_c").over(Window.partitionBy(key).orderBy(F.desc(time))))
    start = run.join(fixed, key, "left").where(F.col("_run") + F.coalesce("_fixed", F.lit(0)) <= budget).groupBy(key).agg(F.min(time).alias("_start"))
    return view.join(start, key, "left").where(F.col(time).isNull() | (F.col(time) >= F.col("_start"))).drop("_start")


def fit_to_budget_exact(view: DataFrame, cost: Column, budget: float, time: str, part: str, header: Column, whole: float = 0, key: str = "qid") -> DataFrame:
    """As ``fit_to_budget`` for a rendering that has a header for each ``part`` (a table, say) with rows in the window,
    and ``whole`` once where there is any row at all; costs are not negative. header depends on the part alone.

    A window of latest times shows a part from that part's last time on, so each header is a cost of that time, and
    the sums over times are those of the rendering itself. Times are summed by day first: the running sums go over the
    days of a question, then over the times of the one day in which its budget runs out. Where the rows without time
    (which always stay) cost too much by themselves, no row with a time stays.
    """
    priced = view.withColumn("_cost", cost.cast("double")).withColumn("_header", header.cast("double"))
    parts = priced.groupBy(key, part).agg(F.max(time).alias("_t"), F.max("_header").alias("_header"), F.max(F.col(time).isNull()).alias("_always"))
    fixed = priced.where(F.col(time).isNull()).groupBy(key).agg(F.sum("_cost").alias("_c")).unionByName(parts.where("_always").groupBy(key).agg(F.sum("_header").alias("_c")))
    fixed = fixed.groupBy(key).agg(F.sum("_c").alias("_fixed"))
    rows = priced.where(F.col(time).isNotNull()).groupBy(key, F.col(time).alias("_t")).agg(F.sum("_cost").alias("_c"))
    heads = parts.where("not _always").groupBy(key, "_t").agg(F.sum("_header").alias("_c"))
    per = rows.unionByName(heads).groupBy(key, "_t").agg(F.sum("_c").alias("_c")).withColumn("_day", F.date_trunc("day", "_t"))
    days = per.groupBy(key, "_day").agg(F.sum("_c").alias("_c"))
    left = F.lit(float(budget)) - F.lit(float(whole)) - F.coalesce("_fixed", F.lit(0.0))
    down = Window.partitionBy(key).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, 0)
    summed = days.withColumn("_through", F.sum("_c").over(down)).join(fixed, key, "left").withColumn("_left", left)
    full = summed.where(F.col("_through") <= F.col("_left")).groupBy(key).agg(F.min("_day").alias("_start"))
    broken = summed.where((F.col("_through") > F.col("_left")) & (F.col("_through") - F.col("_c") <= F.col("_left")))
    last = broken.groupBy(key).agg(F.max(F.struct("_day", (F.col("_left") - F.col("_through") + F.col("_c")).alias("_rest"))).alias("_b")).select(key, "_b.*")
    within = Window.partitionBy(key).orderBy(F.desc("_t")).rowsBetween(Window.unboundedPreceding, 0)
    some = per.join(last, [key, "_day"]).withColumn("_through", F.sum("_c").over(within)).where(F.col("_through") <= F.col("_rest"))
    start = full.unionByName(some.groupBy(key).agg(F.min("_t").alias("_start"))).groupBy(key).agg(F.min("_start").alias("_start"))
    return view.join(start, key, "left").where(F.col(time).isNull() | (F.col(time) >= F.col("_start"))).drop("_start")


def runs(events: DataFrame, source: str, order: Sequence[str], key: str = "qid") -> DataFrame:
    """Numbers consecutive rows of one source on each question's timeline."""
    w = Window.partitionBy(key).orderBy(*order)
    change = F.when(F.lag(source).over(w).eqNullSafe(F.col(source)), 0).otherwise(1)
    return events.withColumn("_c", change).withColumn("run", F.sum("_c").over(w)).drop("_c")


def stratified_sample(df: DataFrame, stratum: str, n: int, seed: int, key: str) -> DataFrame:
    """n rows of each stratum by seeded hash, whatever the other strata hold."""
    w = Window.partitionBy(stratum).orderBy(seeded(seed, F.col(key)), key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def short_strata(df: DataFrame, stratum: str, n: int) -> DataFrame:
    return df.groupBy(stratum).agg(F.count("*").alias("rows")).where(F.col("rows") < n)


def train_val_split(df: DataFrame, ratio: float, seed: int, group: str) -> DataFrame:
    """Adds split: whole groups in seeded order go to validation until it has ``ratio`` of the rows. The
    order is cut into 1,024 parts by the seeded number, so the running sum is over parts and within them."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_size")).withColumn("_at", seeded(seed, F.col(group))).withColumn("_part", F.shiftright("_at", 22))
    quota = df.agg((F.count("*") * ratio).alias("_quota"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("_part").agg(F.sum("_size").alias("_s")).select("_part", F.coalesce(F.sum("_s").over(earlier(Window.orderBy("_part"))), F.lit(0)).alias("_earlier"))
    within = F.coalesce(F.sum("_size").over(earlier(Window.partitionBy("_part").orderBy("_at", group))), F.lit(0))
    placed = sizes.withColumn("_own", within).join(F.broadcast(parts), "_part").withColumn("_before", F.col("_own") + F.col("_earlier")).crossJoin(quota)
    return df.join(placed.select(group, F.when(F.col("_before") < F.col("_quota"), "val").otherwise("train").alias("split")), group)


def dedupe_first(df: DataFrame, value: str, position: str, key: str = "qid") -> DataFrame:
    """The first of the values of a key that are the same after white space and case are evened out."""
    norm = F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))
    w = Window.partitionBy(key, "_norm").orderBy(position)
    return df.withColumn("_norm", norm).where(F.col("_norm") != "").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_norm")


def streaks(turns: DataFrame, signature: str, order: str, key: str) -> DataFrame:
    """Longest run of equal consecutive signatures of each key."""
    w = Window.partitionBy(key).orderBy(order)
    change = F.when(F.lag(signature).over(w).eqNullSafe(F.col(signature)), 0).otherwise(1)
    island = turns.withColumn("_c", change).withColumn("_i", F.sum("_c").over(w)).groupBy(key, "_i").agg(F.count("*").alias("_n"))
    return island.groupBy(key).agg(F.max("_n").alias("streak"))


def evidence_budget(calls: DataFrame, tokens: Column, budget: int, order: str, key: str = "qid") -> DataFrame:
    """Calls run in order until what came before them has reached the budget; adds omitted."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("_t").over(w), F.lit(0))
    return calls.withColumn("_t", tokens).withColumn("omitted", spent >= budget).drop("_t")


def semantic_top_k(vocab: DataFrame, query_vectors: DataFrame, threshold: float = 0.5, k: int = 5) -> DataFrame:
    """query_vectors (query_id, q), as many as there are; vocab (vec_id, v). Similarity to three decimals."""
    one = F.lit("").alias("task")
    found = nearest(query_vectors.select(one, F.col("query_id").alias("id"), F.col("q").alias("v")), vocab.select(one, F.col("vec_id").alias("id"), "v"), k, threshold, 3)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def rrf_merge(lists: Sequence[DataFrame], k: int, rrf_k: int = 100, ascending: Sequence[bool] = ()) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, score) lists; distance lists rank ascending."""
    parts = None
    for i, scored in enumerate(lists):
        up = i < len(ascending) and ascending[i]
        w = Window.partitionBy("query_id").orderBy(F.asc("score") if up else F.desc("score"), "doc_id")
        own = scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("query_id", "doc_id", (1.0 / (rrf_k + F.col("_r"))).alias("_p"))
        parts = own if parts is None else parts.unionByName(own)
    fused = parts.groupBy("query_id", "doc_id").agg(F.sum("_p").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "doc_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
