"""Shuffles as sums against shuffles of rows, and bootstraps against sign vectors over rows."""

import math

import numpy as np
import pytest

from turnloom.operators import bootstrap, models, permutations

LABELS = permutations.LABELS


def turns(rng, patients=14, most=14):
    rows = []
    for p in range(patients):
        level = rng.normal()
        for t in range(int(rng.integers(1, most))):
            k = int(rng.integers(0, 3))
            rows.append((f"p{p}", t, LABELS[k], float(level + 0.4 * (k == 1) + rng.normal() * 0.7)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "who string, turn_index int, sentiment string, y double")


def test_likelihood_by_size_is_that_of_cells(spark):
    rows = turns(np.random.default_rng(0))
    df = frame(spark, [*rows, ("p1", 99, "other", 5.0), ("p1", 98, "neutral", None)])
    fit = permutations.by_size(df, "y", "who")
    assert len(fit.n) <= len({r[0] for r in rows}) and fit.N == len(rows) and fit.m.sum() == 14
    sums = np.array([[sum(r[3] for r in rows if r[2] == s) for s in LABELS]])
    cells = models.local(models.cells_of(df, "y", "who"))
    numbered = models._numbered(cells, "who", "sentiment")
    want = models.lr_statistic(numbered, math.fsum(cells["q"]))
    assert math.isclose(permutations.lr_statistics(fit, sums)[0], want, rel_tol=1e-6)
    assert math.isclose(models.sentiment_model(df, "y", "who")["lr_stat"], want)


def test_without_neutral_turns_positive_is_measured_against_negative(spark):
    rows = [r for r in turns(np.random.default_rng(5)) if r[2] != "neutral"]
    fit = models.sentiment_model(frame(spark, rows), "y", "who")
    assert fit["coef_positive"] is None and fit["coef_negative"] is None and fit["lr_stat"] >= 0 and math.isfinite(fit["coef_pos_vs_neg"])
    moved = models.sentiment_model(frame(spark, [(*r[:3], r[3] + 2.0 * (r[2] == "positive")) for r in rows]), "y", "who")
    assert math.isclose(moved["coef_pos_vs_neg"], fit["coef_pos_vs_neg"] + 2.0, abs_tol=0.2)


@pytest.mark.parametrize("block", [2048, 3])
def test_sums_of_shuffles_have_the_moments_of_shuffles(spark, monkeypatch, block):
    """Within patients, a label's sum has the mean and variance of drawing without replacement, also where a patient is in many blocks."""
    monkeypatch.setattr(permutations, "BLOCK", block)
    rows, perms = turns(np.random.default_rng(1)), 4000
    df = frame(spark, rows)
    got = models.local(permutations.label_sums(df, "y", "who", perms, 7).orderBy("perm"))
    again = models.local(permutations.label_sums(df.repartition(5), "y", "who", perms, 7).orderBy("perm"))
    sums = got[["s0", "s1", "s2"]].to_numpy()
    assert np.allclose(sums, again[["s0", "s1", "s2"]].to_numpy()) and len(sums) == perms
    assert np.allclose(sums.sum(1), sum(r[3] for r in rows))
    mean, var = np.zeros(3), np.zeros(3)
    for p in {r[0] for r in rows}:
        ys = np.array([r[3] for r in rows if r[0] == p])
        k = np.array([sum(r[0] == p and r[2] == s for r in rows) for s in LABELS])
        mean += k * ys.mean()
        if len(ys) > 1:
            var += k * (len(ys) - k) / len(ys) * ys.var(ddof=1)
    assert np.all(np.abs(sums.mean(0) - mean) < 5 * np.sqrt(var / perms))
    assert np.all(np.abs(sums.var(0) / var - 1) < 0.15)


def test_p_is_that_of_shuffled_rows(spark):
    rng = np.random.default_rng(4)
    rows = turns(rng, 10)
    df = frame(spark, rows)
    who, ys = np.array([r[0] for r in rows]), np.array([r[3] for r in rows])
    labels = np.array([r[2] for r in rows])
    q = float(ys @ ys)

    def lr(said):
        import pandas as pd

        t = pd.DataFrame({"who": who, "sentiment": said, "y": ys}).groupby(["who", "sentiment"], as_index=False).agg(n=("y", "size"), s=("y", "sum"))
        return models.lr_statistic(models._numbered(t, "who", "sentiment"), q)

    seen, hits = lr(labels), 0
    for _ in range(300):
        mixed = labels.copy()
        for p in set(who):
            mixed[who == p] = rng.permutation(mixed[who == p])
        hits += lr(mixed) >= seen
    r = permutations.permutation_test(df, "y", "who", 3000, 1).first()
    assert r.perm_n_valid == 3000 and abs(r.perm_p - (hits + 1) / 301) < 0.12
    assert permutations.permutation_test(df, "y", "who", 50, 1, observed=-1.0).first().perm_p == 1.0
    assert permutations.permutation_test(df.limit(0), "y", "who", 50).first() == (None, 0)
    assert permutations.permutation_test(df.limit(5), "y", "who", 50).first() == (None, 0)


def test_no_row_of_a_turn_is_repeated_for_a_shuffle(spark):
    df = frame(spark, turns(np.random.default_rng(2)))
    plan = permutations.label_sums(df, "y", "who", 3000)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
    rows = permutations._blocks(df, "y", "who", ["turn_index"]).collect()
    assert sum(len(r.y) for r in rows) == df.count()


def test_bootstrap_of_many_clusters_against_rows(spark):
    """Signs as the operator draws them, applied to rows one by one."""
    import zlib

    rng = np.random.default_rng(9)
    g, d = rng.integers(0, 40, 400), rng.integers(0, 2, 400)
    y = rng.normal(size=400) + 3 + 0.1 * d + 0.3 * rng.normal(size=40)[g]
    x = np.stack([np.ones(400), d], 1)
    inv = np.linalg.inv(x.T @ x)

    def se(u):
        parts = np.stack([x[g == k].T @ u[g == k] for k in range(40)])
        return math.sqrt((40 / 39 * 399 / 398 * inv @ parts.T @ parts @ inv)[1, 1])

    draws, b = 500, inv @ x.T @ y
    signs = np.stack([1.0 - 2.0 * np.random.default_rng([5, zlib.crc32(str(k).encode()), len(str(k))]).integers(0, 2, draws) for k in range(40)])
    u, hits, moves = y - x @ b, 0, []
    for k in range(draws):
        w = signs[g, k]
        ys = y.mean() + (y - y.mean()) * w
        bs = inv @ x.T @ ys
        hits += abs(bs[1] / se(ys - x @ bs)) >= abs(b[1] / se(u))
        ys = x @ b + u * w
        bs = inv @ x.T @ ys
        moves.append((bs[1] - b[1]) / se(ys - x @ bs))
    df = spark.createDataFrame([(int(a), int(c), float(v)) for a, c, v in zip(g, d, y, strict=True)], "g int, d int, y double")
    r = bootstrap.wild_cluster_bootstrap(df.repartition(3), "y", "d", "g", draws, 5).first()
    assert not r.wcb_exact and r.wcb_n_clusters == 40 and r.wcb_p == hits / draws and math.isclose(r.wcb_beta, b[1], rel_tol=1e-9)
    assert math.isclose(r.wcb_ci_lo, b[1] - se(u) * np.quantile(moves, 0.975), rel_tol=1e-7)
    assert math.isclose(r.wcb_ci_hi, b[1] - se(u) * np.quantile(moves, 0.025), rel_tol=1e-7)
    assert bootstrap.wild_cluster_bootstrap(df.where("g = 1"), "y", "d", "g").collect() == []
