"""Windows that fit a budget exactly, against a rendering of every window."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronoview.operators import ranking as rk


def brute(rows, budget, whole):
    """The widest window of latest times whose rendering fits; rows without time are in each."""
    kept = set()
    for q in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == q]
        times = sorted({r[1] for r in own if r[1] is not None}, reverse=True)
        show = lambda n, own=own, times=times: [r for r in own if r[1] is None or r[1] in times[:n]]
        size = lambda shown: whole + sum(r[3] for r in shown) + sum(7 + len(p) for p in {r[2] for r in shown})
        n = max((k for k in range(1, len(times) + 1) if size(show(k)) <= budget), default=0)
        kept |= {r[4] for r in show(n)}
    return kept


@pytest.mark.parametrize("budget", [0, 60, 150, 10_000])
def test_exact_fit_equals_every_window_tried(spark, budget):
    rng = random.Random(budget)
    day = dt.datetime(2024, 1, 1)
    rows = []
    for q in range(25):
        for _ in range(rng.randint(0, 30)):
            at = None if rng.random() < 0.1 else day + dt.timedelta(hours=rng.choice([0, 1, 5, 24, 25, 30, 72, 73]))
            rows.append((q, at, rng.choice(["labs", "notes", "x"]), rng.choice([0, 1, 9, 30]), len(rows)))
    view = spark.createDataFrame(rows, "qid int, at timestamp_ntz, part string, cost int, row int").repartition(3)
    got = rk.fit_to_budget_exact(view, F.col("cost"), budget, "at", "part", 7 + F.length("part"), 20)
    assert got.columns == view.columns and {r["row"] for r in got.collect()} == brute(rows, budget, 20)
