"""Resampled scores against brute force: as many replicates as the reference has."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import chronoview.queries  # noqa: F401
from chronoview.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def seeded(*keys):
    return int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:8], 16)


def test_paired_compare_draws_4000_and_has_an_overall_row(spark):
    got = {r["category"]: r for r in QUERIES["e17_paired_compare"](spark, SF).collect()}
    o = spark.read.parquet(f"{SF}/orders.parquet").groupBy("o_orderstatus", "o_custkey").agg(((F.max("o_totalprice") - F.min("o_totalprice")) / 1000).alias("d"))
    rows = sorted(tuple(r) for r in o.collect())
    place = lambda r: (-seeded(5, f'{{"qid":{{"category":"{r[0]}","k":{r[1]}}}}}'), r[:2])
    groups = {c: list(g) for c, g in itertools.groupby(rows, lambda r: r[0])} | {"overall": sorted(rows, key=place)}
    assert got.keys() == groups.keys()
    for c, g in groups.items():
        d = np.array([r[2] for r in g])
        means = [d[[seeded(5, c, rep, i) % len(d) for i in range(len(d))]].mean() for rep in range(4000)]
        want = [len(d), d.mean(), *np.percentile(means, [2.5, 97.5])]
        assert [got[c][x] for x in ("n", "difference", "low", "high")] == pytest.approx(want, abs=2e-6)
        assert got[c]["significant"] == (want[2] > 0 or want[3] < 0)


def test_majority_draws_1000(spark):
    got = {r["uid"]: r["majority"] for r in QUERIES["e28_majority"](spark, SF).collect()}
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity").collect()
    groups = {k: list(g) for k, g in itertools.groupby(sorted(map(tuple, lines)), lambda r: r[0])}
    assert got.keys() == groups.keys()
    for uid in sorted(groups)[:20]:
        g, won = groups[uid], []
        for d in range(1000):
            drawn = [g[seeded(3, uid, d, j) % len(g)] for j in range(4)]
            answers = [r[4] for r in drawn]
            best = max(dict.fromkeys(answers), key=answers.count)
            won.append(drawn[answers.index(best)][5])
        assert got[uid] == pytest.approx(np.mean(won), abs=2e-6)
