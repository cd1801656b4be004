"""Sharding by Karmarkar-Karp differencing.

Groups of equal texts are indivisible. A partial partition has a byte sum for each shard; differencing
takes the two of largest spread and adds the large sums of one to the small sums of the other. Groups are
first differenced within blocks of a bounded number of groups; a block's result is itself a partial
partition, so blocks are differenced in the same way, level by level, until one is left.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free

#: Partial partitions that one task combines at a time.
BLOCK = 4096


def difference(sums: np.ndarray) -> np.ndarray:
    """``sums[i, k]``: what part k of item i weighs. Returns place[i, k]: the shard of that part, by
    Karmarkar-Karp; shards are numbered from the lightest up. Equal spreads are taken in the items' order.
    """
    n, k = sums.shape
    order = np.argsort(sums, axis=1, kind="stable")
    heap, nodes = [], {}
    for i in range(n):
        s = sums[i, order[i]].tolist()
        nodes[i] = (s, [[(i, int(p))] for p in order[i]])
        heap.append((s[0] - s[-1], i))
    heapq.heapify(heap)
    fresh = n
    while len(heap) > 1:
        a, b = nodes.pop(heapq.heappop(heap)[1]), nodes.pop(heapq.heappop(heap)[1])
        both = [x + y for x, y in zip(a[0], reversed(b[0]), strict=True)]
        parts = []
        for x, y in zip(a[1], reversed(b[1]), strict=True):
            big, small = (x, y) if len(x) >= len(y) else (y, x)
            big.extend(small)
            parts.append(big)
        by = sorted(range(k), key=both.__getitem__)
        nodes[fresh] = ([both[j] for j in by], [parts[j] for j in by])
        heapq.heappush(heap, (both[by[0]] - both[by[-1]], fresh))
        fresh += 1
    place = np.zeros((n, k), np.int64)
    for shard, members in enumerate(nodes[heap[0][1]][1]):
        for i, p in members:
            place[i, p] = shard
    return place


def _combine(level: DataFrame, shards: int, block: int, n: int) -> tuple[DataFrame, DataFrame, int]:
    """One level. level: (node, sums). Returns where each part of each node goes (node, up, place), the
    nodes of the next level, and their number."""
    blocks = max(1, math.ceil(n / block))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        sums = np.array(rows["sums"].tolist(), np.int64)
        place = difference(sums)
        total = np.zeros(shards, np.int64)
        np.add.at(total, place.ravel(), sums.ravel())
        return pd.DataFrame({"node": rows["node"], "up": rows["up"], "place": list(place.astype(np.int32)), "total": [total.tolist()] * len(rows)})

    keyed = level.withColumn("up", F.pmod(F.xxhash64("node"), F.lit(blocks)))
    placed = cut(keyed.groupBy("up").applyInPandas(run, "node string, up bigint, place array<int>, total array<bigint>"), "shard-level")
    above = placed.groupBy("up").agg(F.max("total").alias("sums")).select(F.col("up").cast("string").alias("node"), "sums")
    return placed, above, blocks


def balance(groups: DataFrame, shards: int = 24, block: int = BLOCK) -> DataFrame:
    """(node string, bytes bigint), one row per group -> (node, shard). Work per level is a task per block;
    levels shrink by ``block``, so few are needed and no task or driver holds all groups."""
    n = groups.count()
    one = [F.lit(0).cast("bigint")] * (shards - 1)
    level = groups.select("node", F.array(*one, F.col("bytes")).alias("sums"))
    levels = []
    while True:
        placed, level, n = _combine(level, shards, block, n)
        levels.append(placed)
        if n <= 1:
            break
    where = levels[-1].select("node", "place")
    for below in reversed(levels[:-1]):
        above = where.select(F.col("node").cast("bigint").alias("up"), F.col("place").alias("_above"))
        where = below.join(above, "up").select("node", F.transform("place", lambda p: F.element_at("_above", p + 1)).alias("place"))
    return where.select("node", F.element_at("place", shards).alias("shard"))


def shard(docs: DataFrame, shards: int = 24, block: int = BLOCK, run_rows: int = 1000) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, null: none, plus 8), text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: byte sums of the shards are near equal; equal texts share a shard (null and empty texts
    are equal). One group larger than a shard's share makes that shard larger, as groups are indivisible.
    slot counts from 0 without gaps within each shard: documents are dealt into runs of about ``run_rows``
    by a hash of doc_id, numbered within their run and shifted by the sizes of the runs before, so no task
    holds a shard. An empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("node"))
    keyed = cut(keyed, "shard-docs")
    groups = cut(keyed.groupBy("node").agg(F.sum("size").alias("bytes")), "shard-groups")
    where = cut(balance(groups, shards, block), "shard-where")
    free(groups)
    runs = max(1, math.ceil(keyed.count() / shards / run_rows))
    placed = cut(keyed.join(where, "node").withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(runs))), "shard-placed")
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "run").count().select("shard", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "run").orderBy("doc_id", "node")
    numbered = placed.withColumn("slot", F.row_number().over(within) - 1).join(cut(starts, "shard-starts"), ["shard", "run"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
