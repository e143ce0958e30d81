"""Crossed models whose cells stay in Spark, against those on the driver (which are held against dense likelihoods)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.operators import blocks, crossed, models


def talk(spark, n=700, seed=1, participants=40, interviewers=5):
    rng = np.random.default_rng(seed)
    i, j, d = rng.integers(0, interviewers, n), rng.integers(0, participants, n), rng.integers(0, 2, n)
    eta = -0.7 + 0.5 * d + rng.normal(size=interviewers)[i] * 0.6 + rng.normal(size=participants)[j] * 0.5 + rng.normal(size=n) * 0.4
    trials = rng.integers(1, 9, n)
    succ = rng.binomial(trials, 1 / (1 + np.exp(-eta)))
    rows = [(f"i{a}", f"p{b}", "positive" if c else "negative", float(e), int(k), int(t)) for a, b, c, e, k, t in zip(i, j, d, eta, succ, trials, strict=True)]
    return spark.createDataFrame(rows, "interviewer_id string, participant_id string, sentiment string, y double, succ int, total int")


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_CELLS", 60)


def test_gaussian_deviances_are_those_of_the_driver(spark, small_blocks):
    cells = crossed._gaussian_cells(talk(spark), "y")
    own, table, total = models.local(cells), blocks.Blocks(cells, ("n", "s")), blocks.gaussian_totals(cells)
    assert table.table.count() > 3
    for slope in (False, True):
        for null in (False, True):
            a, b = crossed.Crossed(own, math.fsum(own["q"]), slope, null), blocks.CrossedBlocks(table, total, slope, null)
            points = [np.array(t)[: 4 if slope else 2] for t in ([0.0, 0.0, 0.0, 0.0], [0.7, 0.2, 0.1, 0.3], [1.5, 1.0, -0.4, 0.0])]
            for reml in (False, True):
                assert np.allclose(a.deviances(points, reml), b.deviances(points, reml), rtol=1e-10)
            assert np.allclose(a.parts(points[1])[1], b.parts(points[1])[1])


@pytest.mark.parametrize("per_row", [True, False])
def test_laplace_deviances_are_those_of_the_driver(spark, small_blocks, per_row):
    rows = talk(spark, 500)
    k, n = ("succ", "total") if per_row else ("least(succ, 1)", "1")
    cells = rows.groupBy("interviewer_id", "participant_id", "sentiment", F.expr(k).cast("double").alias("succ"), F.expr(n).cast("double").alias("n")).agg(F.count("*").alias("times")).cache()
    own, table, total = models.local(cells), blocks.Blocks(cells, ("succ", "n", "times")), blocks.binomial_totals(cells)
    points = [np.array(v)[: 5 if per_row else 4] for v in ([-0.5, 0.3, 0.6, 0.5, 0.4], [0.0, 0.0, 0.0, 0.0, 0.0], [2.0, -3.0, 1.5, 2.5, 1.0], [-0.5, 0.3, -0.6, 0.0, 0.9])]
    want, got = crossed.Binomial(own, per_row).deviances(points), blocks.BinomialBlocks(table, total, per_row).deviances(points)
    assert np.allclose(want, got, rtol=1e-9), (want, got)
    less = [np.delete(v, 1) for v in points]
    assert np.allclose(crossed.Binomial(own, per_row, null=True).deviances(less), blocks.BinomialBlocks(table, total, per_row, null=True).deviances(less), rtol=1e-9)


def test_focal_models_agree_wherever_the_work_is_done(spark, monkeypatch):
    rows = talk(spark, 400, 3, 20, 3)
    here = crossed.focal_model(rows, "y")
    monkeypatch.setattr(crossed, "LOCAL_CELLS", 0)
    monkeypatch.setattr(blocks, "BLOCK_CELLS", 100)
    there = crossed.focal_model(rows, "y")
    assert set(here) == set(there) and here["method"] == there["method"]
    for name in ("estimate", "se", "p_wald", "lrt_stat", "sigma2_interviewer", "sigma2_participant", "slope_lrt_stat"):
        assert math.isclose(here[name], there[name], rel_tol=2e-3, abs_tol=1e-5), name


def test_log_gamma(spark):
    values = [1.0, 1.5, 2.0, 7.0, 100.0, 1e6]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(blocks.log_gamma(F.col("x"))).collect()]
    assert np.allclose(got, [math.lgamma(v) for v in values], rtol=1e-12, atol=1e-11)


def test_quasi_newton_finds_a_curved_valley():
    rosen = lambda xs: [100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2 for x in xs]
    x, value, ok = models.quasi_newton(rosen, np.array([-1.2, 1.0]), 300)
    assert ok and np.allclose(x, 1, atol=1e-3) and value < 1e-6
