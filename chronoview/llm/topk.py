"""Exact top-k search by inner product: tiles of queries and shards, partial selection, merged lists.

Vectors are packed into blocks of a fixed number of rows. A tile is a block of queries with a block of
candidates: one matrix product, then the k best of each row. Tiles are dealt by cells of a grid, whose size
does not depend on the tables. A task merges the lists of its tiles as they come and passes them on when they
are long; the lists of tasks are merged by groups of tasks, and those per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of queries and of candidates; a cell has one block of candidates, on average, and CELL of queries.
QUERIES, CANDIDATES, CELL = 512, 4096, 64
#: Entries that a task holds before it passes them on.
HELD = 500_000
LIST = "query_id bigint, vec_id bigint, score bigint"


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<double>): each component x, as a double, becomes floor(scale * x). Rows with a null
    id, a null vector or a null or non-finite component take no part."""
    v = F.col("embedding")
    x = F.transform(v, lambda c: F.lit(float(scale)) * c.cast("double"))
    fit = F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & fit).select("vec_id", x.alias("v"))


def _pack(vectors: DataFrame, rows: int, prefix: str) -> DataFrame:
    """Blocks of at most ``rows`` vectors of one length: ids and components as raw bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def out(width: int) -> pa.RecordBatch:
            ids, parts = held.pop(width)
            values = [np.array(ids, "<i8").tobytes(), np.floor(np.array(parts, "<f8")).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), *[pa.array([b], pa.binary()) for b in values]], names=[f"{prefix}width", f"{prefix}ids", f"{prefix}data"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, parts = held.setdefault(len(v), ([], []))
                ids.append(i)
                parts.append(v)
                if len(ids) == rows:
                    yield out(len(v))
        yield from map(out, list(held))

    return vectors.mapInArrow(run, f"{prefix}width int, {prefix}ids binary, {prefix}data binary")


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where these are exact, else in Python's integers, held to 64 bits."""
    n = min(queries.shape[1], candidates.shape[1])
    a, b = queries[:, :n], candidates[:, :n]
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, n) < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    wide = np.dot(whole(a), whole(b).T)
    return np.clip(wide, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest of each query, ties to the smaller vec_id."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
    kept = np.arange(len(query)) - start < k
    return query[kept], vec[kept], score[kept]


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of the tile for each query, itself excepted; all that tie with the k-th are
    looked at before ties are settled by id."""
    s = scores(q, c)
    own = q_ids[:, None] == c_ids[None, :]
    s[own] = np.iinfo(np.int64).min
    if s.shape[1] > k:
        rows, columns = np.nonzero(s >= np.partition(s, -k, axis=1)[:, -k][:, None])
    else:
        rows, columns = np.nonzero(np.ones_like(s, bool))
    fine = ~own[rows, columns]
    rows, columns = rows[fine], columns[fine]
    return best(q_ids[rows], c_ids[columns], s[rows, columns], k)


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, fan_in: int = 8) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query, all if there are fewer.

    Both sides are (vec_id, v). A query's own id is no candidate for it; equal candidate rows count each,
    equal query ids once (with the least vector). A shorter vector counts as padded with zeros, and one of any
    length is compared whole. Columns other than vec_id and v are not looked at. The query set is stated by
    the caller. Cells of the grid have a row of query blocks and a column of candidate blocks; a block goes to
    all cells of its row or column.
    """
    columns = max(1, math.ceil(candidates.count() / CANDIDATES))
    once = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = max(1, math.ceil(once.count() / QUERIES / CELL))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = lambda ids, n: F.pmod(F.xxhash64(ids), F.lit(n)).cast("int")
    q = _pack(once, QUERIES, "q_").withColumn("row", one("q_ids", rows)).withColumn("column", every(columns))
    c = _pack(candidates.select("vec_id", "v"), CANDIDATES, "c_").withColumn("column", one("c_ids", columns)).withColumn("row", every(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        size = 0

        def merged() -> list[tuple[np.ndarray, ...]]:
            return [best(*(np.concatenate(x) for x in zip(*found, strict=True)), k)] if found else []

        def out() -> Iterator[pa.RecordBatch]:
            for parts in found:
                yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for qw, qi, qd, cw, ci, cd in zip(*(batch.column(j).to_pylist() for j in range(6)), strict=True):
                q_ids, c_ids = np.frombuffer(qi, "<i8"), np.frombuffer(ci, "<i8")
                part = tile(q_ids, np.frombuffer(qd, "<f8").reshape(len(q_ids), qw), c_ids, np.frombuffer(cd, "<f8").reshape(len(c_ids), cw), k)
                found.append(part)
                size += len(part[0])
                if size > HELD:
                    found = merged()
                    size = len(found[0][0])
                    if size > HELD // 2:
                        yield from out()
                        found, size = [], 0
        found = merged()
        yield from out()

    # Spark's sizes don't count the copies, so it would send all those of the queries through the driver.
    tiles = q.hint("merge").join(c, ["row", "column"])
    lists = tiles.select("q_width", "q_ids", "q_data", "c_width", "c_ids", "c_data").mapInArrow(run, LIST)
    by = Window.partitionBy("query_id", "_group").orderBy(F.desc("score"), "vec_id")
    grouped = lists.withColumn("_group", (F.spark_partition_id() / fan_in).cast("int")).withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= k)
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return grouped.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
