"""Whitening against numpy's eigenvectors and exact integers; FEAST on spectra with ties and gaps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoview.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>"


def wide(got, rows):
    """Of each row the whitened values by component, in order of vec_id."""
    return np.array([[r.whitened for r in sorted((g for g in got if g.vec_id == i), key=lambda g: g.component)] for i in rows])


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((300, 12)) * np.linspace(3, 0.2, 12)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[i].tolist()) for i in range(40)]
    bad = [(2000, None), (2001, [float("nan")] + [0.0] * 11), (2002, [None] + [0.0] * 11), (2003, [float("inf")] + [0.0] * 11)]
    table = spark.createDataFrame(rows + bad, SCHEMA).withColumn("n", F.lit("own")).repartition(5)
    got = whitening.whiten(table).collect()
    whole = np.floor(256 * x.astype(float)).astype(np.int64)
    fit = np.unique(whole, axis=0)
    n, sums = len(fit), fit.sum(0)
    values, units = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    assert {g.vec_id for g in got} == {r[0] for r in rows} and len(got) == 4 * len(rows) and {g.n for g in got} == {n}
    expected = (whole - sums / n) @ units[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    ours = wide(got, range(300))
    signs = np.sign((ours * expected).sum(0))
    assert np.abs(ours * signs - expected).max() < 1e-11
    assert np.array_equal(wide(got, range(1000, 1040)), ours[:40])
    for g in got:
        assert g.deviation == int((((n * whole[g.vec_id % 1000] - sums).astype(object)) ** 2).sum())
        assert g.explained == pytest.approx(values[::-1][g.component - 1] / values.sum(), rel=1e-12)
        assert 0 <= g.identity_error < 1e-10


def test_fewer_dimensions_ragged_rows_and_nothing_to_fit(spark):
    plane = [(i, [float(i % 3), float(i % 2) / 2, 1.0]) for i in range(6)] + [(None, [1.0])]
    got = whitening.whiten(spark.createDataFrame(plane, SCHEMA)).collect()
    assert {g.component for g in got} == {1, 2, 3} and sum(g.vec_id is None for g in got) == 3
    two = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])], SCHEMA)).collect()
    assert sorted((g.vec_id, g.component, g.n, g.deviation, round(abs(g.whitened), 9)) for g in two) == [(1, 1, 2, 2 * 256**2, 1.0)] + [(2, 1, 2, 2 * 256**2, 1.0)] * 2
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5]), (2, [0.5])]):
        empty = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**40 * (i % 5)), float(i)]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    x = np.array([[256 * 2**40 * (i % 5), 256 * i] for i in range(40)], object)
    sums = x.sum(0)
    for g in got:
        exact = int(((40 * x[g.vec_id] - sums) ** 2).sum())
        assert g.deviation == (exact if exact < 2**63 else None)


@pytest.mark.parametrize(
    "values",
    [[5, 4, 3, 2, 1], [3, 3, 3, 3, 3, 1, 0, 0], [1] * 6, [1, 0, 0], [5, 4, 3, 2 + 1e-10, 2], [1e12, 1, 1e-3, 1e-4, 1e-5], list(np.linspace(1, 1.01, 60)), [1, 1e-9, 1e-9, 1e-9, 1e-9]],
)
def test_feast_finds_all_leading_pairs(values):
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    v = turn @ np.diag(np.array(values, float)) @ turn.T
    v = (v + v.T) / 2
    found, units = whitening.leading(v, 4)
    expected = np.sort(np.linalg.eigvalsh(v))[::-1]
    expected = expected[expected > len(v) * 2.0**-50 * np.trace(v)][:4]
    top = expected[0]
    assert len(found) == len(expected) and np.abs(found - expected).max() < 1e-13 * top * 10
    assert np.abs(units.T @ units - np.eye(len(found))).max() < 1e-12
    assert np.linalg.norm(v @ units - units * found, axis=0).max() < 1e-12 * top


def test_inertia_counts_every_eigenvalue():
    rng = np.random.default_rng(9)
    v = rng.standard_normal((20, 20))
    v = v + v.T
    values = np.linalg.eigvalsh(v)
    form = whitening.tridiagonal(v)
    assert [whitening.above(form, (a + b) / 2) for a, b in zip(values, values[1:], strict=False)] == list(range(19, 0, -1))


def test_products_past_53_bits():
    y = np.array([[2**40, 1], [-(2**40) + 3, 5]])
    assert whitening.gram(y).tolist() == [[2**80 + (2**40 - 3) ** 2, 2**40 - 5 * (2**40 - 3)], [2**40 - 5 * (2**40 - 3), 26]]
