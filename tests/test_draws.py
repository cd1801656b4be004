"""Draws hashed together against hashlib, and resampling that explodes no draws."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoview.functions import draws
from chronoview.operators import groups as gr, scoring as sc


def seeded(*keys):
    return int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:8], 16)


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("prefix", ["", "3:17:", "5:" + "x" * 50 + ":", "5:" + "é" * 60 + ":"])
def test_numbers_are_those_of_md5(monkeypatch, prefix):
    monkeypatch.setattr(draws, "AT_ONCE", 300)
    got, at = {}, 0
    for _, rows in draws.by_length([prefix]):
        for texts in draws.numbers(95, 1205):
            for _, c, x in draws.seeded_numbers(rows, texts):
                got |= {95 + at + c.start + i: int(v) for i, v in enumerate(x[0])}
            at += len(texts)
    assert got == {i: int(hashlib.md5(f"{prefix}{i}".encode()).hexdigest()[:8], 16) for i in range(95, 1205)}


def test_majority_draws_in_batches(spark):
    rows = [(k, None if ((k or 1) + i) % 5 == 0 else "ab"[i % 2], i, None if i == 2 else float(i)) for k in [None, *range(70)] for i in range(1 + (k or 3) % 6)]
    df = spark.createDataFrame(rows, "k int, x string, i int, s double")
    small = gr.majority(df, ["k"], "x", "i", "s", 3, 120, 4)
    assert "MapInArrow" in plan(small) and "sequence(0, 119)" not in plan(gr._majority_within(df.withColumn("_i", F.col("i")), ["k"], "x", "s", 3, 120, 4))
    got = {r.k: r.majority for r in small.collect()}
    for k in (None, 0, 5, 69):
        g, won = [r[1:] for r in rows if r[0] == k], []
        for d in range(120):
            drawn = [g[seeded(*[4, *([] if k is None else [k]), d, j]) % len(g)] for j in range(3)]
            answers = [r[0] for r in drawn]
            won.append(drawn[answers.index(max(dict.fromkeys(answers), key=answers.count))][2])
        assert got[k] == pytest.approx(np.mean([s for s in won if s is not None]))


@pytest.mark.parametrize("held, block", [(1 << 22, 1 << 16), (16, 8)])
def test_paired_compare_sends_sums_only(spark, monkeypatch, held, block):
    monkeypatch.setattr(sc, "HELD", held)
    monkeypatch.setattr(sc, "BLOCK", block)
    a = spark.range(90).selectExpr("id AS qid", "if(id < 50, 'x', 'y') AS category", "if(id = 7, null, cast(id * id % 31 as double)) AS score")
    out = sc.paired_compare(a, a.selectExpr("qid", "cast(qid % 7 as double) AS score"), 200, 9)
    assert "sequence(0, 199)" not in plan(out)
    got = {r.category: r for r in out.collect()}
    d = [None if i == 7 else i * i % 31 - float(i % 7) for i in range(90)]
    for c, g in (("x", d[:50]), ("y", d[50:])):
        drawn = [[g[seeded(9, c, rep, i) % len(g)] for i in range(len(g))] for rep in range(200)]
        means = [np.mean([v for v in some if v is not None]) for some in drawn]
        assert [got[c].low, got[c].high] == pytest.approx(np.percentile(means, [2.5, 97.5]).tolist())
