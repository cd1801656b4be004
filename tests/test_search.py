"""Vector searches of every row whose id is divisible by 100, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoview.operators import ranking as rk, search
from chronoview.plans.registry import QUERIES
import chronoview.queries  # noqa: F401

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    return [r["vec_id"] for r in rows], [r["label"] for r in rows], np.array([r["embedding"] for r in rows], float)


def test_semantic_top_k_of_all_hundredths(spark, vectors):
    ids, _, m = vectors
    got = {}
    for r in QUERIES["f7_semantic_top_k"](spark, SF).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = {}
    for i, q in zip(ids, m, strict=True):
        if i % 100 == 0:
            s = np.floor(m @ q * 1000 + 0.5) / 1000
            best = sorted((-x, v) for x, v in zip(s, ids, strict=True) if x >= 0.2)[:5]
            want[i] = [(n + 1, v, -x) for n, (x, v) in enumerate(best)]
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_vocabulary_is_all_other_rows_of_the_label(spark, vectors):
    ids, labels, m = vectors
    want = {}
    for i, t, q in zip(ids, labels, m, strict=True):
        if i % 100 == 0:
            best = min(((-x, str(v)) for x, v, u in zip(m @ q, ids, labels, strict=True) if u == t and v != i), default=(0, ""))
            want[str(i)] = best[1] if -best[0] >= 0.3 else str(i)
    assert {r["name"]: r["mapped"] for r in QUERIES["e15_map_to_vocabulary"](spark, SF).collect()} == want


def test_more_than_a_thousand_queries_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "CANDIDATES", 100)
    rows = spark.range(1500).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id")).alias("v"))
    got = rk.semantic_top_k(rows, rows.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), 0.5, 3)
    m = np.array([[np.cos(i), np.sin(i)] for i in range(1500)])
    s = np.floor(m @ m.T * 1000 + 0.5) / 1000
    want = {(i, n + 1, int(v)) for i in range(1500) for n, v in enumerate(np.lexsort((np.arange(1500), -s[i]))[:3])}
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()} == want
