"""Small cases with answers worked out by hand, and solvers against dense likelihoods."""

import math
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnloom.functions import signals as S
from turnloom.functions import text as T
from turnloom.operators import bootstrap, crossed, dyad, effects, inference, jobs, models, turns
from turnloom.sources import readers

TURN = "file int, idx int, speaker string, text string, start bigint, end bigint"


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "role"), [("Patient_1", "client"), ("in", "therapist"), ("THERAPEUT", "therapist"), ("x", "other"), (None, "other"), (" P ", "client"), ("client therapist", "client")])
def test_canonical_speaker(spark, name, role):
    assert one(spark, "s string", (name,), T.canonical_speaker(F.col("s"))) == role


@pytest.mark.parametrize(("raw", "label"), [("Positive.", "positive"), ("not sure", "other"), ("very negative!", "negative"), (None, "other"), ("", "other")])
def test_parse_sentiment(spark, raw, label):
    assert one(spark, "s string", (raw,), T.parse_sentiment(F.col("s"))) == label


@pytest.mark.parametrize(("raw", "ms"), [(None, 9), ("12", 12), (" 7 ", 7), ("12.5", 9), ("-3", -3), ("--5", 9), ("", 9)])
def test_coerce_ms(spark, raw, ms):
    assert one(spark, "s string", (raw,), T.coerce_ms(F.col("s"), F.lit(9).cast("bigint"))) == ms


def test_islands_skip_blanks_and_keep_the_last_end(spark):
    rows = [(1, 0, "a", "x", 0, 900), (1, 1, "b", " ", 0, 5), (1, 2, "A ", "y", 100, 500), (1, 3, "b", "z", -5, None), (2, 0, None, "q", None, 3)]
    got = turns.speaker_islands(spark.createDataFrame(rows, TURN)).orderBy("file", "turn_index").collect()
    assert [(r.file, r.turn_index, r.speaker_id, r.text, r.start_ms, r.end_ms, r.original_turn_indices) for r in got] == [
        (1, 0, "a", "x y", 0, 500, [0, 2]), (1, 1, "b", "z", 0, 0, [3]), (2, 0, "unknown", "q", 0, 3, [0]),
    ]


def test_context_zero_is_all_history(spark):
    rows = spark.createDataFrame([(1, i, "p" if i == 3 else "t", f"w{i}" if i != 1 else "", 0, 0) for i in range(4)], TURN)
    assert turns.context_window(rows, 0).first().context == ["w0", "w2"]
    assert turns.context_window(rows, None).first().context == ["w0", "w2"]
    assert turns.context_window(rows, 1).first().context == ["w2"]


def test_prompt_has_18_messages(spark):
    m = one(spark, "t string, c array<string>", ("now", ["a", "b"]), T.build_prompt(F.col("t"), F.col("c")))
    assert len(m) == 18 and m[0].role == "system"
    assert m[-1].content == "Previous snippet 1: a\nPrevious snippet 2: b\n\nSpeech turn: now\n"


def pack(text, most):
    """Greedy packing written out."""
    text = text.strip()
    if not text:
        return []
    if len(text.split()) <= most:
        return [text]
    import re

    pieces = []
    for s in re.split(r"(?<=[.!?])\s+", text):
        w = s.split()
        pieces += [" ".join(w[i : i + most]) for i in range(0, len(w), most)] if len(w) > most else [s.strip()] if w else []
    out, cur = [], ""
    for p in pieces:
        new = f"{cur} {p}" if cur else p
        if cur and len(new.split()) > most:
            out.append(cur)
            cur = p
        else:
            cur = new
    return [*out, cur] if cur else out


def test_chunks_as_written_out(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab. !"), size=n)) for n in rng.integers(0, 120, 60)] + ["", "  "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", T.chunk_text(F.col("t"), 5).alias("c")).collect():
        assert r.c == pack(r.t, 5)
        assert all(len(x.split()) <= 5 for x in r.c)
    assert one(spark, "t string", (None,), T.chunk_text(F.col("t"), 5)) == []


def test_presence_and_intensity(spark):
    nan = float("nan")
    assert one(spark, "a double, b double", (nan, 0.0), S.smile_presence(F.col("a"), F.col("b"))) is None
    assert one(spark, "a double, b double", (1.0, 0.5), S.smile_presence(F.col("a"), F.col("b"))) == 1.0
    assert one(spark, "a double, b double", (nan, 3.0), S.smile_intensity(F.col("a"), F.col("b"))) == 3.0


FRAME = "dyad bigint, side int, ts double, intensity double, presence double"
TURNS = "dyad bigint, interviewer bigint, turn_index int, sentiment string, start_s double, end_s double"


def frames(spark, p, q, pres=None):
    rows = [(1, s, float(t), float(v), pres[s][t] if pres else 1.0) for s, x in ((0, p), (1, q)) for t, v in enumerate(x)]
    return spark.createDataFrame(rows, FRAME)


def test_right_edge(spark):
    f = frames(spark, [1, 1, 1, 9], [1, 1, 1, 9])
    t = spark.createDataFrame([(1, 0, 0, "neutral", 0.0, 3.0)], TURNS)
    assert dyad.turn_means(t, f, bucket=2.0).first().client_smile_intensity == 1.0
    assert dyad.simul_smile(t, f, hz=1.0, bucket=2.0).first().simul_smile_n_frames == 4


def test_missing_presence_counts_as_no_smile(spark):
    f = frames(spark, [0] * 4, [0] * 4, ([1.0, None, 1.0, 1.0], [1.0, 1.0, 0.0, 1.0]))
    r = dyad.simul_smile(spark.createDataFrame([(1, 0, 0, "neutral", 0.0, 3.0)], TURNS), f, hz=1.0, bucket=9.0).first()
    assert (r.simul_smile_frames, r.simul_smile_n_frames) == (2, 4)


def lag_peak(p, q, most):
    """The lag scan written out."""
    best = (None, 0, -1.0)
    k_most = max(0, min(most, len(p) - 3))
    for k in range(-k_most, k_most + 1):
        a, b = (p[: len(p) - k], q[k:]) if k >= 0 else (p[-k:], q[: len(q) + k])
        if a.std() < 1e-12 or b.std() < 1e-12:
            continue
        r = float(np.corrcoef(a, b)[0, 1])
        if round(abs(r), 12) > best[2]:
            best = (r, k, round(abs(r), 12))
    return best[:2]


def test_lag_scan(spark):
    rng = np.random.default_rng(3)
    t = spark.createDataFrame([(1, 0, 0, "neutral", 0.0, 19.0), (1, 0, 1, "neutral", 0.0, 4.0)], TURNS)
    for p, q in ((rng.normal(size=20), rng.normal(size=20)), (np.sin(np.arange(20.0)), np.sin(np.arange(20.0) - 2)), (np.ones(20), rng.normal(size=20))):
        rows = {r.turn_index: r for r in dyad.cross_lag(t, frames(spark, p, q), 1.0, 3.0, 10.0, bucket=7.0).collect()}
        r, k = lag_peak(p, q, 3)
        assert rows[0].n_frames == 20 and rows[1].n_frames == 5 and rows[1].cc_r_peak is None
        if r is None:
            assert rows[0].cc_r_peak is None and rows[0].peak_lag_s is None
        else:
            assert math.isclose(rows[0].cc_r_peak, r, rel_tol=1e-9) and rows[0].peak_lag_s == k


def test_speaker_roles_count_overlap_once(spark):
    seg = spark.createDataFrame([(1, "A", 0.0, 4.0), (1, "A", 1.0, 2.0), (1, "B", 0.0, 5.0), (1, "C", 0.0, 1.0)], "file int, speaker string, start_s double, dur_s double")
    got = {r.speaker: (r.covered_s, r.role) for r in turns.speaker_roles(seg).collect()}
    assert got == {"A": (4.0, "therapist"), "B": (5.0, "client"), "C": (1.0, None)}


def test_inclusion_at_zero_needs_a_valid_label(spark):
    t = spark.createDataFrame([("a", "positive"), ("b", "other")], "patient_id string, sentiment string")
    assert [r.patient_id for r in jobs.inclusion_filter(t, 0).collect()] == ["a"]


def test_bootstrap_two_clusters(spark):
    rows = spark.createDataFrame([(g, d, float(y)) for g, d, y in [(0, 0, 1), (0, 1, 2), (0, 0, 2), (1, 1, 5), (1, 0, 1), (1, 1, 4)]], "g int, d int, y double")
    r = bootstrap.wild_cluster_bootstrap(rows, "y", "d", "g").first()
    assert r.wcb_exact and r.wcb_n_clusters == 2 and r.wcb_p >= 0.5


def test_bootstrap_against_rows(spark):
    rng = np.random.default_rng(2)
    g, d = rng.integers(0, 5, 40), rng.integers(0, 2, 40)
    y = rng.normal(size=40) + 0.4 * d + 0.2 * g
    x = np.stack([np.ones(40), d], 1)
    inv = np.linalg.inv(x.T @ x)

    def se(u):
        parts = np.stack([x[g == k].T @ u[g == k] for k in range(5)])
        return math.sqrt((5 / 4 * 39 / 38 * inv @ parts.T @ parts @ inv)[1, 1])

    b = inv @ x.T @ y
    hits = 0
    for m in range(32):
        w = np.array([1 - 2 * (m >> k & 1) for k in range(5)])[g]
        ys = y.mean() + (y - y.mean()) * w
        bs = inv @ x.T @ ys
        hits += abs(bs[1] / se(ys - x @ bs)) >= abs(b[1] / se(y - x @ b)) - 1e-12
    df = spark.createDataFrame([(int(a), int(c), float(v)) for a, c, v in zip(g, d, y, strict=True)], "g int, d int, y double")
    r = bootstrap.wild_cluster_bootstrap(df, "y", "d", "g").first()
    assert math.isclose(r.wcb_beta, b[1], rel_tol=1e-9) and r.wcb_p == hits / 32


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=9))
def test_bh_rises_with_p(spark, ps):
    rows = effects.bh_fdr(spark.createDataFrame([("f", p) for p in ps], "family string, p double")).orderBy("p").collect()
    q = [r.q for r in rows]
    assert q == sorted(q) and all(a >= b - 1e-12 for a, b in zip(q, sorted(ps), strict=True))
    m = len(ps)
    want = [min(min(1.0, sorted(ps)[j] * m / (j + 1)) for j in range(i, m)) for i in range(m)]
    assert np.allclose(q, want)


def dense(y, x, blocks, reml):
    """Deviance of a Gaussian model with covariance sum of v * Z Z' + s2 I, given (v, ..., s2)."""
    v = sum(s * z @ z.T for z, s in blocks[:-1]) + blocks[-1] * np.eye(len(y))
    inv = np.linalg.inv(v)
    info = x.T @ inv @ x
    b = np.linalg.solve(info, x.T @ inv @ y)
    r = y - x @ b
    m = len(y) - (x.shape[1] if reml else 0)
    return m * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + r @ inv @ r + (np.linalg.slogdet(info)[1] if reml else 0)


@pytest.mark.parametrize("reml", [False, True])
def test_random_intercept_against_dense(reml):
    rng = np.random.default_rng(4)
    g, lab = rng.integers(0, 6, 50), rng.choice(["neutral", "positive", "negative"], 50)
    y = rng.normal(size=50) + rng.normal(size=6)[g]
    cells = pd.DataFrame({"g": g, "sentiment": lab, "y": y}).groupby(["g", "sentiment"]).y.agg(n="count", s="sum").reset_index()
    code, labels, n, s = models._numbered(cells, "g", "sentiment")
    fit = models.RandomIntercept(code, models.design(labels), n, s, float(y @ y))
    for lam in (0.0, 0.3, 2.0):
        rss = fit.parts(lam)[2]
        s2 = rss / (50 - 3 if reml else 50)
        assert math.isclose(fit.deviance(lam, reml), dense(y, models.design(lab), [(np.eye(6)[g], lam * s2), s2], reml), rel_tol=1e-9)
    best = fit.best(reml)
    assert fit.deviance(best, reml) <= min(fit.deviance(x, reml) for x in (0.0, best * 0.9, best * 1.1 + 1e-9)) + 1e-9


def test_crossed_against_dense():
    rng = np.random.default_rng(5)
    i, p, d = rng.integers(0, 4, 60), rng.integers(0, 7, 60), rng.integers(0, 2, 60)
    y = rng.normal(size=60) + rng.normal(size=4)[i] + 0.5 * d
    frame = pd.DataFrame({"interviewer_id": i, "participant_id": p, "sentiment": np.where(d, "positive", "negative"), "y": y})
    cells = frame.groupby(["interviewer_id", "participant_id", "sentiment"]).y.agg(n="count", s="sum").reset_index()
    fit = crossed.Crossed(cells, float(y @ y))
    x = np.stack([np.ones(60), d], 1)
    for theta in ((0.0, 0.0), (0.7, 0.2), (1.5, 1.0)):
        s2 = fit.parts(np.array(theta))[2] / 60
        want = dense(y, x, [(np.eye(4)[i], theta[0] ** 2 * s2), (np.eye(7)[p], theta[1] ** 2 * s2), s2], False)
        assert math.isclose(fit.deviance(np.array(theta), False), want, rel_tol=1e-9)


def test_slope_against_dense():
    rng = np.random.default_rng(6)
    i, p, d = rng.integers(0, 4, 80), rng.integers(0, 7, 80), rng.integers(0, 2, 80)
    y = rng.normal(size=80) + rng.normal(size=7)[p] * d
    frame = pd.DataFrame({"interviewer_id": i, "participant_id": p, "sentiment": np.where(d, "positive", "negative"), "y": y})
    cells = frame.groupby(["interviewer_id", "participant_id", "sentiment"]).y.agg(n="count", s="sum").reset_index()
    fit = crossed.Crossed(cells, float(y @ y), slope=True)
    x = np.stack([np.ones(80), d], 1)
    theta = np.array([0.4, 0.7, 0.3, 0.9])
    lower = np.array([[0.7, 0.0], [0.3, 0.9]])
    z = np.concatenate([np.stack([(p == k) * 1.0, (p == k) * d], 1) @ lower for k in range(7)], 1)
    s2 = fit.parts(theta)[2] / 80
    assert math.isclose(fit.deviance(theta, False), dense(y, x, [(np.eye(4)[i], 0.16 * s2), (z, s2), s2], False), rel_tol=1e-9)


def test_ties_in_chunks(monkeypatch):
    rng = np.random.default_rng(0)
    j, i = np.sort(rng.integers(0, 30, 200)), rng.integers(0, 5, 200)
    w, g, ra, rb = rng.random(200), rng.random((200, 2)), rng.random((5, 3)), rng.random((30, 2, 3))
    got = []
    for chunk in (7, 2048):
        monkeypatch.setattr(crossed, "CHUNK", chunk)
        ties = crossed.Ties(i, j)
        got.append((ties.factor(w, 0.6, g), *ties.solve(ra, rb)))
    assert math.isclose(got[0][0], got[1][0]) and np.allclose(got[0][1], got[1][1]) and np.allclose(got[0][2], got[1][2])


def counts(seed, n, effect=0.3):
    rng = np.random.default_rng(seed)
    i, p, d = rng.integers(0, 8, n), rng.integers(0, 30, n), rng.integers(0, 2, n)
    trials = rng.integers(5, 40, n)
    eta = -1 + effect * d + 0.5 * rng.normal(size=8)[i] + 0.4 * rng.normal(size=30)[p] + 0.3 * rng.normal(size=n)
    succ = rng.binomial(trials, 1 / (1 + np.exp(-eta)))
    return pd.DataFrame({"interviewer_id": i, "participant_id": p, "sentiment": np.where(d, "positive", "negative"), "succ": succ * 1.0, "n": trials * 1.0, "times": 1.0})


def laplace(cells, v):
    """The Laplace deviance with a dense matrix of all effects, by short Newton steps."""
    cells, i, j, d = crossed._coded(cells)
    k, n = cells["succ"].to_numpy(), cells["n"].to_numpy()
    z = np.concatenate([v[2] * np.eye(i.max() + 1)[i], v[3] * np.eye(j.max() + 1)[j], v[4] * np.eye(len(k))], 1)
    fixed, u = v[0] + v[1] * d, np.zeros(z.shape[1])
    for _ in range(200):
        eta = fixed + z @ u
        mu = 1 / (1 + np.exp(-eta))
        h = z.T @ (z * (n * mu * (1 - mu))[:, None]) + np.eye(len(u))
        u = u + 0.2 * np.linalg.solve(h, z.T @ (k - n * mu) - u)
    choose = sum(math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1) for a, b in zip(n, k, strict=True))
    return -2 * (choose + k @ eta - n @ np.logaddexp(0, eta)) + u @ u + np.linalg.slogdet(h)[1]


def test_binomial_against_dense_laplace_whatever_came_before():
    cells = counts(1, 150)
    fit = crossed.Binomial(cells, per_row=True)
    points = [np.array(v) for v in ([-1.0, 0.3, 0.5, 0.4, 0.3], [-1.0, 3.0, 0.1, 2.0, 1.0], [4.0, -2.0, 0.0, 0.0, 3.0])]
    fresh = [fit.deviance(v) for v in points]
    assert [fit.deviance(v) for v in reversed(points)] == fresh[::-1]
    for v, dev in zip(points[:2], fresh, strict=False):
        assert math.isclose(dev, laplace(cells, v), rel_tol=1e-7)


@pytest.mark.parametrize("per_row", [True, False])
def test_likelihood_ratio_is_near_walds_square(per_row):
    cells = counts(2, 400)
    if not per_row:
        cells = cells.assign(succ=(cells["succ"] > 4) * 1.0, n=1.0)
    full, v, none, dev, settled = crossed.nested(cells, per_row)
    wald = (v[1] / full.errors(v)[1]) ** 2
    assert settled and none >= dev and abs((none - dev) - wald) < 0.25 * wald + 0.3
    same = crossed.nested(cells.assign(sentiment=np.random.default_rng(0).permutation(cells["sentiment"])), per_row)
    assert 0 <= same[2] - same[3] < 8


def test_bernoulli_without_effects_is_a_table():
    cells = pd.DataFrame({"interviewer_id": [0, 1, 0, 1], "participant_id": [0, 1, 1, 0], "sentiment": ["negative", "positive"] * 2, "succ": [3.0, 6, 2, 7], "n": [10.0] * 4, "times": [1] * 4})
    fit = crossed.Binomial(cells, per_row=True)
    b = np.array([math.log(5 / 15), math.log(13 / 7) - math.log(5 / 15)])
    want = -2 * sum(math.log(math.comb(10, k) * p**k * (1 - p) ** (10 - k)) for k, p in ((3, 0.25), (2, 0.25), (6, 0.65), (7, 0.65)))
    assert math.isclose(fit.deviance(np.concatenate([b, [0, 0, 0]])), want, rel_tol=1e-9)


def test_focal_model_against_plain_differences(spark):
    """Balanced pairs: the estimate is the mean difference, and its p that of a t test with as many degrees of freedom as fit."""
    rng = np.random.default_rng(8)
    rows = [(int(p % 4), int(p), s, float(rng.normal() + (s == "positive") * 0.8 + p * 0.1)) for p in range(16) for s in ("negative", "positive") for _ in range(3)]
    df = spark.createDataFrame(rows, "interviewer_id int, participant_id int, sentiment string, y double")
    fit = crossed.focal_model(df, "y")
    diff = np.mean([r[3] for r in rows if r[2] == "positive"]) - np.mean([r[3] for r in rows if r[2] == "negative"])
    assert math.isclose(fit["estimate"], diff, rel_tol=1e-6) and (fit["n_participants"], fit["n_interviewers"], fit["n_obs"]) == (16, 4, 96)
    assert 0 < fit["p_wald"] < 0.05 and abs(fit["lrt_stat"] - fit["z"] ** 2) < 0.2 * fit["z"] ** 2 and fit["slope_lrt_stat"] >= 0
    assert math.isclose(fit["p_wald"], models.t_two_sided(fit["z"], 79), rel_tol=0.05)
    assert set(fit) == set(crossed.FOCAL_FIELDS) and crossed.focal_slope(df, "y")["slope_lrt_stat"] >= 0
    assert crossed.focal_slope(df.limit(0), "y")["slope_source"] == "empty" and crossed.focal_model(df.limit(3), "y")["method"] == "not_fittable"


def test_tails():
    assert math.isclose(models.chi2_sf(5.991464547107979, 2), 0.05, rel_tol=1e-9)
    assert math.isclose(models.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(models.t_two_sided(2.2281388519649385, 10), 0.05, rel_tol=1e-8)
    assert math.isclose(models.t_two_sided(1.0, 1), 0.5, rel_tol=1e-9)


def test_satterthwaite_of_a_balanced_design(spark):
    """Every patient has every label equally often: contrasts within patients have N - patients - 2 degrees of freedom."""
    rng = np.random.default_rng(12)
    rows = [(p, s, float(rng.normal() + 0.3 * p + (s == "positive") * 0.4)) for p in range(8) for s in ("neutral", "positive", "negative") for _ in range(4)]
    fit = models.sentiment_model(spark.createDataFrame(rows, "g int, sentiment string, y double"), "y", "g")
    mean = {s: np.mean([y for _, t, y in rows if t == s]) for s in ("neutral", "positive", "negative")}
    assert math.isclose(fit["coef_positive"], mean["positive"] - mean["neutral"], rel_tol=1e-9) and math.isclose(fit["coef_pos_vs_neg"], mean["positive"] - mean["negative"], rel_tol=1e-9)
    for name in ("positive", "negative", "pos_vs_neg"):
        assert math.isclose(fit[f"p_{name}"], models.t_two_sided(fit[f"z_{name}"], 96 - 8 - 2), rel_tol=1e-3)
    within = sum((y - np.mean([v for q, t, v in rows if (q, t) == (p, s)])) ** 2 for p, s, y in rows) + sum(
        4 * (np.mean([v for q, t, v in rows if (q, t) == (p, s)]) - mean[s] - np.mean([v for q, _, v in rows if q == p]) + np.mean([v for *_, v in rows])) ** 2 for p in range(8) for s in mean
    )
    assert math.isclose(fit["sigma2_resid"], within / 86, rel_tol=1e-6)


def test_scratch_tables_go(spark):
    import os
    from types import SimpleNamespace

    from turnloom import scratch

    with scratch.step() as made:
        a, b = scratch.cut(spark.range(3)), scratch.cut(spark.range(4))
        made.remove(b)
    assert not os.path.exists(a.scratch_path.removeprefix("file://")) and b.count() == 4
    scratch.drop(b)
    assert not os.path.exists(b.scratch_path.removeprefix("file://"))

    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master, applicationId="test"))

    assert scratch.scratch_root(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert scratch.scratch_root(session("local[2]", None)).startswith("file:///")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.scratch_root(session(master, None))


def test_small_inputs_give_nulls(spark):
    rows = spark.createDataFrame([("a", "positive", 1.0)], "g string, sentiment string, y double")
    assert models.sentiment_model(rows, "y", "g")["method"] == "not_fittable"


def test_a_model_that_fails_falls_back(spark):
    def make():
        def model(texts):
            if any("bad" in t for t in texts):
                raise ValueError
            return [t.upper() for t in texts]

        return model

    df = spark.createDataFrame([(1, "ok fine."), (2, "bad one."), (3, None)], "i int, text string")
    assert [r.text for r in inference.translate_turns(df, make).orderBy("i").collect()] == ["OK FINE.", "bad one.", ""]


def test_json_turns_keep_their_places(spark, tmp_path):
    (tmp_path / "results_a.json").write_text('[{"text": "x", "start": 1, "end": 2, "speaker_id": "p"}, {"text": "y"}]')
    (tmp_path / "results_b.json").write_text('{"not": "a list"}')
    rows = readers.read_turns(spark, str(tmp_path), strict=False).orderBy("idx").collect()
    with pytest.raises(Exception, match="not a JSON list"):
        readers.read_turns(spark, str(tmp_path)).collect()
    assert [(r.idx, r.text, r.start) for r in rows] == [(0, "x", "1"), (1, "y", None)]
    assert readers.malformed(spark, str(tmp_path)).count() == 1


def test_openface_threshold(spark, tmp_path):
    (tmp_path / "f.csv").write_text(" timestamp, confidence, AU06_r, AU12_r, AU06_c, AU12_c\n0.0, 0.9, 1.0, 2.0, 1, 0\n0.1, 0.2, 3.0, 4.0, 1, 1\n")
    rows = readers.read_openface(spark, str(tmp_path / "f.csv")).orderBy("ts").collect()
    assert [(r.ts, r.au06_r, r.au12_c) for r in rows] == [(0.0, 1.0, 0.0), (0.1, None, None)]
    assert readers.read_openface(spark, str(tmp_path / "f.csv"), drop=True).count() == 1


def test_rttm_lines(spark):
    lines = spark.createDataFrame([("SPEAKER u 1 0.5  1.25 <NA> <NA> S0 <NA>",), ("",), ("NOTE",)], "value string")
    assert [tuple(r) for r in readers.parse_rttm(lines).collect()] == [("u", 0.5, 1.25, "S0")]


def test_catalog_and_paths(spark):
    doc = {"interviews": [{"patient": {"patient_id": "a "}, "types": {"bindung": None}}, {"patient": {"patient_id": "b"}, "types": {"bindung": {"transcript": "t"}}}, {}]}
    rows = readers.read_catalog(spark, doc).collect()
    assert [(r.patient_id, r.names_bindung, r.has_bindung) for r in rows] == [("a", True, False), ("b", True, True), ("", False, False)]
    assert one(spark, "p string", ("C:\\a\\b",), readers.native_path(F.col("p"))) == "/mnt/c/a/b"
    assert one(spark, "p string", ("/mnt/c/a/b",), readers.windows_path(F.col("p"))) == "C:\\a\\b"


def test_shapiro_against_published_values():
    """The weights of eleven men, with W = 0.79 and p = 0.01 in the literature."""
    w, p = models.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert abs(w - 0.7888) < 1e-3 and abs(p - 0.0067) < 2e-3
    rng = np.random.default_rng(0)
    ps = [models.shapiro_wilk(rng.normal(size=80))[1] for _ in range(200)]
    assert 0.4 < np.mean(ps) < 0.6 and math.isnan(models.shapiro_wilk(np.ones(9))[0])


@pytest.mark.parametrize("n", [4, 5, 12, 4999, 5001, 60_000])
def test_w_of_a_column_is_that_of_the_sorted_values(spark, n):
    """At any length, with ties, nulls and values in no order."""
    values = np.round(np.random.default_rng(n).normal(size=n) ** 3, 2 if n > 12 else 5)
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 3, "v double").repartition(3)
    w, p = models.shapiro_wilk_of(rows, "v")
    want = models.shapiro_wilk(values)
    assert math.isclose(w, want[0], rel_tol=1e-9) and math.isclose(p, want[1], rel_tol=1e-6, abs_tol=1e-12)
    assert all(map(math.isnan, models.shapiro_wilk_of(rows.limit(0), "v"))) and all(map(math.isnan, models.shapiro_wilk_of(spark.range(9).selectExpr("1.0 as v"), "v")))


def test_synchrony_in_one_pass(spark):
    """Both measures of one resampling are those of each alone: gaps, missing values and times, short, outer and empty turns, small buckets."""
    rng = np.random.default_rng(12)
    gap = lambda v, share: None if rng.random() < share else float(v)
    rows = [
        (d, s, gap(t + rng.random(), 0.02), gap(math.sin(t / 3 + s) + rng.normal() / 5, 0.1), gap(rng.integers(2), 0.1))
        for d in (1, 2, 3) for s in (0, 1) for t in range(60) if not (d == 2 and 20 < t < 45) and not (d == 3 and s == 1)
    ]
    f = spark.createDataFrame(rows, FRAME)
    t = spark.createDataFrame([(d, 7, k, "positive", a, b) for d in (1, 2, 3, 4) for k, (a, b) in enumerate(((0.0, 30.0), (5.0, 6.0), (22.0, 58.0), (90.0, 120.0), (8.0, 3.0), (10.0, 40.5), (None, None)))], TURNS)
    for bucket in (4.0, 600.0):
        got = dyad.synchrony(t, f, 2.0, 3.0, 10.0, bucket=bucket)
        want = dyad.sync_turns(t, dyad.cross_lag(t, f, 2.0, 3.0, 10.0, bucket=bucket), dyad.simul_smile(t, f, 2.0, bucket=bucket))
        key = lambda r: (r.participant_id, r.turn_index)
        got, want = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
        assert len(got) == 28 and [r[:8] for r in got] == [r[:8] for r in want]
        for a, b in zip(got, want, strict=True):
            assert a.simul_smile_frames == b.simul_smile_frames
            assert all((x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12)) for x, y in zip(a[8:], b[8:], strict=True))
        assert sum(r.cc_r_peak is not None for r in got) == 6 and sum((r.simul_smile_n_frames or 0) > 0 for r in got) >= 8
    empty = dyad.synchrony(t.limit(0), f, bucket=9.0).count(), dyad.synchrony(t, f.limit(0), bucket=9.0).where("n_frames = 0 and simul_smile_freq is null").count()
    assert empty == (0, 28)


def test_synchrony_shuffles_frames_once(spark):
    """Of the joins by size none is a broadcast: frames and points are dealt once, by dyad and bucket, and only turns move after that."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = dyad.synchrony(spark.createDataFrame([], TURNS), spark.createDataFrame([(1, 0, 1.0, 1.0, 1.0)], FRAME))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [re.search(r"\((.*?), \d+\)", x)[1] for x in re.findall(r"Exchange hashpartitioning.*", plan)]
    moved = [re.sub(r"#\d+L?", "", x) for x in moved]
    assert plan.count("REPARTITION_BY_COL") == 1 and moved.count("dyad, bucket") == 2  # frames with the grid, and turns
    assert not any("i" in x.split(", ") for x in moved)  # points are put side by side where they lie


def test_resampling_across_empty_buckets(spark):
    """Frames at both ends of a long gap: the points between look past many buckets without any."""
    f = spark.createDataFrame([(1, s, t, v, v) for s in (0, 1) for t, v in ((0.0, 1.0), (1.0, 0.0), (50.0, 1.0))], FRAME)
    grid = dyad.common_grid(f, 1.0)
    near = {r.i: r.v for r in dyad.resample_nearest(grid, f, bucket=3.0).where("side = 0").collect()}
    assert near == {i: 1.0 if i == 0 or i > 25 else 0.0 for i in range(51)}
    line = {r.i: r.v for r in dyad.resample_linear(grid, f, bucket=3.0).where("side = 1").collect()}
    assert all(math.isclose(line[i], 1.0 - i if i < 1 else (i - 1) / 49) for i in range(51))


def test_chunks_by_tokens(spark):
    def make():
        return (lambda t: [ord(c) for c in t]), (lambda ids: "".join(map(chr, ids)))

    df = spark.createDataFrame([(0, "abcdefg"), (1, "ab"), (2, ""), (3, None), (4, "     ")], "i int, t string")
    got = [r.c for r in df.select("i", inference.split_by_tokens(F.col("t"), make, 3).alias("c")).orderBy("i").collect()]
    assert got == [["abc", "def", "g"], ["ab"], [""], [], ["     "]]

    def failing():
        def encode(t):
            if "c" in t:
                raise ValueError
            return list(t)

        return encode

    assert [r.n for r in df.select("i", inference.token_count(F.col("t"), failing).alias("n")).orderBy("i").collect()] == [1, 2, 0, 0, 5]


def test_limits_and_devices():
    assert T.model_limits(512) == (192, 256) and T.model_limits(100) == (68, 256) and T.model_limits(10**30, None) == (480, 256) and T.model_limits(40, 192, 999) == (32, 256)
    assert [inference.resolve_device(x, 1) for x in ("auto", None, 1, "cuda", "-1", "cpu")] == ["cuda:0", "cuda:0", "cuda:1", "cuda:0", "cpu", "cpu"]
    assert inference.resolve_device("auto") == "cpu" and inference.device_name("CUDA") == "cuda:0"


def test_asr_turns_keep_the_types_of_their_items(spark, tmp_path):
    (tmp_path / "results_a.json").write_text('[{"text": null, "start": 1.9, "end": "12.5", "speaker_id": null}, {"start": "7"}, {"text": "x", "start": -4, "end": true}]')
    rows = readers.read_asr_turns(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.speaker, r.text, r.start, r.end) for r in rows] == [("None", "None", 1, 1), ("unknown", "", 7, 7), ("unknown", "x", -4, 1)]


def test_synchrony_csv_round_trip(spark, tmp_path):
    from turnloom.sources import sinks

    df = spark.createDataFrame([("p", "i", 3, "positive", 10.5, 300, "synchrony", "duchenne_smile", 0.1, float("nan"), None, 4, 300, 0.25)],
                               "participant_id string, interviewer_id string, turn_index long, sentiment string, duration_s double, n_frames long, level string, au string, cc_r double, "
                               "peak_lag_s double, cc_r_peak double, simul_smile_frames long, simul_smile_n_frames long, simul_smile_freq double")
    sinks.write_csv(df, str(tmp_path / "sync"), sinks.SYNC_TURNS)
    back = readers.read_synchrony(spark, str(tmp_path / "sync"))
    assert back.columns == list(sinks.SYNC_TURNS)
    assert back.first() == ("p", "i", 3, "positive", 10.5, 300, "synchrony", "duchenne_smile", 0.1, None, None, 4, 300, 0.25)
    (tmp_path / "few.csv").write_text("turn_index,extra,cc_r\n2,x,nan\n")
    r = readers.read_synchrony(spark, str(tmp_path / "few.csv")).first()
    assert (r.turn_index, r.cc_r, r.simul_smile_freq) == (2, None, None)


def test_catalog_files(spark, tmp_path):
    (tmp_path / "m.yaml").write_text("interviews:\n- patient: {patient_id: ab}\n  therapist: {therapist_id: 7}\n  types:\n    bindung: {transcript: t}\n")
    (tmp_path / "m.json").write_text('{"interviews": [{"patient": {"patient_id": "ab"}, "therapist": {"therapist_id": 7}, "types": {"bindung": {"transcript": "t"}}}]}')
    a, b = (readers.read_catalog_file(spark, str(tmp_path / f)).collect() for f in ("m.yaml", "m.json"))
    assert a == b and (a[0].patient_id, a[0].therapist_id, a[0].has_bindung) == ("ab", "7", True)


def test_first_existing_path(spark):
    rows = spark.createDataFrame([("/mnt/c/x.csv",), ("C:\\y.csv",), ("z.csv",), ("none.csv",), ("",), (None,)], "p string")
    there = spark.createDataFrame([("C:\\x.csv",), ("/mnt/c/y.csv",), ("file:/root/z.csv",), ("file:///mnt/c/x.csv",)], "path string")
    got = {r.p: r.resolved for r in readers.first_existing(rows, "p", there, "/root/").collect()}
    assert got == {"/mnt/c/x.csv": "/mnt/c/x.csv", "C:\\y.csv": "/mnt/c/y.csv", "z.csv": "/root/z.csv", "none.csv": None, "": None, None: None}


def test_discovery(spark, tmp_path):
    for name in ("a/x.mov", "a/y.wav", "z.mp4", "out/temp_audio/x.wav", "n.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    found = [r.path.rsplit("/", 1)[1] for r in readers.discover_media(spark, str(tmp_path)).collect()]
    assert sorted(found) == ["x.mov", "x.wav", "y.wav", "z.mp4"]
    assert [r.path.rsplit("/", 1)[1] for r in readers.discover_media(spark, str(tmp_path), temp_audio=str(tmp_path / "out/temp_audio")).collect()] == ["x.wav"]
    items = spark.createDataFrame([("f", 4, "Client", 1.0)], "file string, turn_index int, sentiment_label string, x double").selectExpr("file", "turn_index", "' POS ' as sentiment_label", "1500 as start_ms", "2000 as end_ms")
    assert readers.analysis_turns(items).first() == ("f", 4, "pos", 1.5, 2.0)


def test_reasons_and_sources(spark):
    status = jobs.load_status(
        spark.createDataFrame([(i, None if i == 1 else "p", "p", "p") for i in range(5)], "job int, patient_path string, therapist_path string, labelled_path string"),
        spark.createDataFrame([(0, 1, 1), (2, 1, 1), (3, 0, 1), (4, 1, 1)], "job int, patient_frames int, therapist_frames int"),
        spark.createDataFrame([(0, 1), (2, 1), (3, 1)], "job int, turns int"), spark.createDataFrame([(2, "OSError", "gone"), (1, "OSError", "x")], "job int, kind string, message string"),
    )
    got = {r.job: (r.ok, r.reason) for r in status.collect()}
    assert got == {0: (True, None), 1: (False, "missing_paths"), 2: (False, "exception:OSError:gone"), 3: (False, "empty_openface"), 4: (False, "no_labeled_turns")}
    picks = spark.createDataFrame([(0.2, 0.5), (None, 0.5), (float("nan"), 0.4)], "perm double, lr double").select(*effects.pick_p(F.col("perm"), F.col("lr"))).collect()
    assert [(r.p, r.q_source) for r in picks] == [(0.2, "perm"), (0.5, "lr"), (0.4, "lr")]


def test_sinks(spark, tmp_path):
    from turnloom.sources import sinks

    items = spark.createDataFrame([("a", 1, "y", None), ("a", 0, "x", "positive"), ("b", 0, "z", None)], "file string, idx int, text string, sentiment_label string")
    docs = {r.file: r.value for r in sinks.json_documents(items, ["text", "sentiment_label"]).collect()}
    assert docs == {"a": '[{"text":"x","sentiment_label":"positive"},{"text":"y"}]', "b": '[{"text":"z"}]'}
    out = str(tmp_path / "json")
    sinks.write_json(items, out, ["text"])
    more = items.unionByName(items.where("file = 'b'").withColumn("file", F.lit("c d")))
    sinks.write_json(more.withColumn("text", F.lit("new")), out, ["text"])  # a and b are left alone, one by one
    read = lambda: {p.name: p.read_text() for p in (tmp_path / "json").iterdir()}
    assert read() == {"a.json": '[{"text":"x"},{"text":"y"}]', "b.json": '[{"text":"z"}]', "c d.json": '[{"text":"new"}]'}
    sinks.write_json(items.where("file = 'b'").withColumn("text", F.lit("over")), "file://" + out, ["text"], overwrite=True)
    assert read()["b.json"] == '[{"text":"over"}]' and len(read()) == 3
    seg = spark.createDataFrame([("my file", 2.0, 0.5, "S 1"), ("my file", 1.0, 0.25, "S2")], "uri string, start_s double, dur_s double, speaker string")
    sinks.write_rttm(seg, str(tmp_path / "rttm"))
    lines = readers.read_rttm(spark, str(tmp_path / "rttm")).collect()
    assert [(r.uri, r.start_s, r.speaker) for r in lines] == [("my_file", 1.0, "S2"), ("my_file", 2.0, "S_1")]
    assert [p.name for p in (tmp_path / "rttm/my_file").iterdir()] == ["my_file.rttm"]
    sinks.write_csv(spark.createDataFrame([(1, float("nan"))], "a int, b double"), str(tmp_path / "csv"), ["b", "a", "c"])
    assert spark.read.text(str(tmp_path / "csv")).first().value == "b,a,c"
    sinks.write_label_report(items.withColumnRenamed("sentiment_label", "label"), str(tmp_path / "sum"))
    told = (tmp_path / "sum/sentiment_label_summary.txt").read_text().split("\n")
    assert told == ["Sentiment-label summary", "=" * 40, "", "Overall counts:", "  positive          1", "  TOTAL             1", "", "Per-file counts:", "  a: positive=1", "  b: ", ""]


def test_documents_appear_whole_or_not_at_all(spark, tmp_path):
    """A task that dies halfway leaves nothing under a document's name; one that is tried again writes each document once."""
    from turnloom.sources import documents

    def failing(frames):
        for frame in frames:
            yield frame[:1]
            raise RuntimeError("killed")

    rows = spark.createDataFrame([(f"d{k % 2}/f{k}.txt", "x" * 1000) for k in range(20)], documents.DOCUMENT).repartition(2)
    with pytest.raises(Exception, match="killed"):
        documents.write(rows.mapInPandas(failing, documents.DOCUMENT), str(tmp_path / "out"))
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    documents.write(rows, str(tmp_path / "out"))
    found = [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assert len(found) == 20 and all(p.read_text() == "x" * 1000 for p in found)
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".")]
    writer = documents._Writer(str(tmp_path / "two"), False)
    messages = [writer.write(iter([("a", "first attempt")])), writer.write(iter([("a", "second"), ("b", "once")]))]
    writer.commit([messages[1], None])  # only the committed attempt counts
    assert {p.name: p.read_text() for p in (tmp_path / "two").iterdir()} == {"a": "second", "b": "once"}
