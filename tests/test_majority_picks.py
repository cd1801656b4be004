"""Majority answers: picks that can't change a draw's winner are not hashed, and winners are those of all picks."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoview.functions import draws
from chronoview.operators import groups as gr


def seeded(*keys):
    return int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:8], 16)


ROWS = [(k, None if (k + i) % 7 == 0 else "abc"[(k * i + i) % (1 + k % 3)], i, None if (i + k) % 6 == 5 else float(i * k % 11)) for k in range(1, 31) for i in range(1 + k % 6)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_winners_are_those_of_all_picks(spark, n):
    df = spark.createDataFrame(ROWS, "k int, x string, i int, s double")
    got = {r.k: r.majority for r in gr.majority(df, ["k"], "x", "i", "s", n, 110, 2).collect()}
    for k in range(1, 31):
        g, won = [r[1:] for r in ROWS if r[0] == k], []
        for d in range(110):
            drawn = [g[seeded(2, k, d, j) % len(g)] for j in range(n)]
            answers = [r[0] for r in drawn]
            won.append(drawn[answers.index(max(dict.fromkeys(answers), key=answers.count))][2])
        won = [s for s in won if s is not None]
        assert got[k] == (pytest.approx(np.mean(won)) if won else None)


def test_decided_draws_are_not_hashed(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "k int, x string, i int, s double").withColumn("_i", F.col("i"))
    caught = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: caught.append((run, self.toArrow().combine_chunks())))
    gr._majority_within(df, ["k"], "x", "s", 4, 1000, 2)
    hashed = []
    monkeypatch.setattr(draws, "_rounds", lambda *a, f=draws._rounds: hashed.append(np.size((out := f(*a))[0])) or out)
    (run, table), several = caught[0], {}
    for k, x, *_ in ROWS:
        several.setdefault(k, set()).add(x)
    assert sum(b.num_rows for b in run(iter(table.to_batches()))) == 30
    assert sum(hashed) < sum(3000 if len(x) > 1 else 1000 for x in several.values())
