"""Items dealt to bins of even cost and equal counts, groups kept whole, by differencing.

From the costliest on, k groups at a time make a tuple, one for each bin, so counts stay equal whatever follows.
Two tuples are combined oppositely ordered, those of largest spread first. A task combines a block of tuples to one, Spark
the blocks' results to one again, until one tuple is left: its places are the bins. No task holds all groups.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import freed, written
from .ranking import global_rank

#: Tuples that a task combines to one.
BLOCK = 2048
STATE = "state bigint, sums array<double>"


def workload(length: Column) -> Column:
    """What a sequence costs. 24576 L + L^2."""
    x = length.cast("double")
    return 24576 * x + x * x


def combine(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tuples (rows) -> sums of the one they become, highest first, and for each place of each tuple its place there."""
    n, k = sums.shape
    heap = []
    for i, row in enumerate(sums):
        order = np.argsort(-row, kind="stable")
        heap.append((row.min() - row.max(), i, i, row[order], np.argsort(order)))
    heapq.heapify(heap)
    parents: dict[int, tuple[int, np.ndarray]] = {}
    first = {i: spot for _, _, i, _, spot in heap}
    fresh = n
    while len(heap) > 1:
        (_, _, a, x, _), (_, _, b, y, _) = heapq.heappop(heap), heapq.heappop(heap)
        joined = x + y[::-1]
        order = np.argsort(-joined, kind="stable")
        spot = np.argsort(order)
        parents[a], parents[b] = (fresh, spot), (fresh, spot[::-1])
        heapq.heappush(heap, (joined.min() - joined.max(), fresh, fresh, joined[order], spot))
        fresh += 1
    down = {heap[0][2]: np.arange(k)}
    for node in sorted(parents, reverse=True):
        up, spot = parents[node]
        down[node] = down[up][spot]
    return heap[0][3], np.stack([down[i][first[i]] for i in range(n)])


def _level(states: DataFrame, blocks: int) -> DataFrame:
    """(state, place, next_state, next_place, sums): a block's states in one task; sums only beside its first place."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("state")
        total, spots = combine(np.array(rows["sums"].tolist(), float))
        n, k = spots.shape
        out = pd.DataFrame({"state": np.repeat(rows["state"].to_numpy(), k), "place": np.tile(np.arange(k), n), "next_state": np.int64(rows["state"].iloc[0] % blocks), "next_place": spots.ravel()})
        out["sums"] = [total.tolist()] + [None] * (len(out) - 1)
        return out

    dealt = states.withColumn("_block", F.pmod("state", F.lit(blocks)))
    return dealt.groupBy("_block").applyInPandas(run, "state bigint, place int, next_state bigint, next_place int, sums array<double>")


def balance_by_length(items: DataFrame, length: str, k: int, group: str) -> DataFrame:
    """(group, cost, bin): whole groups in k bins of even cost, whose counts differ by one at most; of the differencing
    and a deal in turns that reverse, what has the lower spread. Null lengths cost nothing; null groups are one group."""
    cost = items.groupBy(group).agg(F.coalesce(F.sum(workload(F.col(length))), F.lit(0.0)).alias("cost"))
    ranked = written(global_rank(cost, "cost", group).select(group, "cost", (F.floor(F.col("rank") / k)).alias("state"), F.pmod("rank", F.lit(k)).cast("int").alias("place")), "balance-ranked")
    turn = F.when(F.col("state") % 2 == 0, F.col("place")).otherwise(k - 1 - F.col("place"))
    sums = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i.cast("int")), F.lit(0.0)))
    states = ranked.groupBy("state").agg(F.map_from_entries(F.collect_list(F.struct("place", "cost"))).alias("_m")).select("state", sums.alias("sums"))
    n = states.count()
    placed = ranked.select(group, "cost", "state", "place", turn.cast("int").alias("dealt"))
    while n > 1:
        blocks = -(-n // BLOCK)
        moved = written(_level(states, blocks), "balance-level")
        placed = placed.join(moved.select("state", "place", "next_state", "next_place"), ["state", "place"])
        placed = placed.select(group, "cost", F.col("next_state").alias("state"), F.col("next_place").alias("place"), "dealt")
        states, n = moved.where("sums is not null").select(F.col("next_state").alias("state"), "sums"), blocks
    placed = written(placed, "balance-placed")
    spread = lambda bin_: placed.groupBy(bin_).agg(F.sum("cost").alias("s")).agg((F.max("s") - F.min("s")).alias("spread")).first()["spread"] or 0.0
    chosen = "dealt" if spread("dealt") < spread("place") else "place"
    freed(ranked)
    return placed.select(group, "cost", F.col(chosen).alias("bin"))


def imbalance(assigned: DataFrame, cost: str = "cost", bin_: str = "bin") -> DataFrame:
    """One row: bins, least, greatest and mean cost, their spread, greatest over mean, and least and greatest counts."""
    per = assigned.groupBy(bin_).agg(F.sum(cost).alias("c"), F.count("*").alias("n"))
    out = per.agg(F.count("*").alias("bins"), F.min("c").alias("least"), F.max("c").alias("greatest"), F.avg("c").alias("mean"), F.min("n").alias("fewest"), F.max("n").alias("most"))
    return out.select("bins", "least", "greatest", "mean", (F.col("greatest") - F.col("least")).alias("spread"), (F.col("greatest") / F.col("mean")).alias("over_mean"), "fewest", "most")
