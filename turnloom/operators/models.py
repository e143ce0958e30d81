"""Mixed models from sufficient statistics: Spark sums cells, a small solver works on the sums.

Random-intercept and crossed-intercept Gaussian models need one row for each cell of their factors and the sum of
squares of the response; the fit's cost does not grow with the rows behind a cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.scratch import cut, drop
from turnloom.workers import reachable

SENTIMENTS = ("neutral", "positive", "negative")
SINGULAR = 1e-8


# --- distributions ---------------------------------------------------------------------------------------

def chi2_sf(x: float, df: int) -> float:
    """Upper tail for 1 degree of freedom or an even number of them."""
    if x <= 0:
        return 1.0
    if df == 1:
        return math.erfc(math.sqrt(x / 2))
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for k in range(1, df // 2):
            term *= x / 2 / k
            total += term
        return math.exp(-x / 2) * total
    return chi2_sf(x, df - 2) + math.exp((df / 2 - 1) * math.log(x / 2) - x / 2 - math.lgamma(df / 2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


# --- optimisers ------------------------------------------------------------------------------------------

def golden(f: Callable[[float], float], lo: float, hi: float, tol: float = 1e-10) -> float:
    """The place of the least value on [lo, hi]."""
    g = (math.sqrt(5) - 1) / 2
    a, b = lo, hi
    x, y = b - g * (b - a), a + g * (b - a)
    fx, fy = f(x), f(y)
    while b - a > tol:
        if fx < fy:
            b, y, fy = y, x, fx
            x = b - g * (b - a)
            fx = f(x)
        else:
            a, x, fx = x, y, fy
            y = a + g * (b - a)
            fy = f(y)
    return (a + b) / 2


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, step: float = 0.3, most: int = 4000, tol: float = 1e-10, apart: float = 1e-6) -> tuple[np.ndarray, float, bool]:
    n = len(start)
    points = [start] + [start + step * np.eye(n)[i] for i in range(n)]
    values = [f(p) for p in points]
    for _ in range(most):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < tol and max(np.abs(p - points[0]).max() for p in points[1:]) < apart:
            return points[0], values[0], True
        centre = np.mean(points[:-1], axis=0)
        mirror = centre + (centre - points[-1])
        fm = f(mirror)
        if fm < values[0]:
            far = centre + 2 * (centre - points[-1])
            ff = f(far)
            points[-1], values[-1] = (far, ff) if ff < fm else (mirror, fm)
        elif fm < values[-2]:
            points[-1], values[-1] = mirror, fm
        else:
            near = centre + 0.5 * ((mirror if fm < values[-1] else points[-1]) - centre)
            fn = f(near)
            if fn < min(fm, values[-1]):
                points[-1], values[-1] = near, fn
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    return points[0], values[0], False


def quasi_newton(f: Callable[[list[np.ndarray]], list[float]], start: np.ndarray, most: int = 100, step: float = 1e-4, still: float = 1e-4) -> tuple[np.ndarray, float, bool]:
    """Least value by BFGS steps on central differences: the point, its value, whether the gradient is still there.

    f takes many points at once: those of a gradient are one call, and so are the steps of a line search, so a function that is a pass
    over distributed rows costs two passes an iteration.
    """
    n = len(start)
    e = np.eye(n) * step

    def gradient(x: np.ndarray) -> np.ndarray:
        got = np.array(f([*(x + e), *(x - e)]))
        return (got[:n] - got[n:]) / (2 * step)

    x, value = np.asarray(start, float), f([np.asarray(start, float)])[0]
    g, inverse = gradient(x), np.eye(n)
    for k in range(most):
        if np.abs(g).max() < still:
            return x, value, True
        d = -inverse @ g
        if d @ g >= 0:
            inverse, d = np.eye(n), -g
        d *= min(1.0, 1.0 / np.abs(d).max())
        lengths = [2.0 ** -i for i in range(4)] if k else [4.0 ** -i for i in range(5)]
        tried = f([x + t * d for t in lengths])
        best = int(np.argmin(tried))
        if not tried[best] < value:
            tried = f([x + t * d for t in (1e-2, 1e-3, 1e-4, 1e-6)])
            lengths, best = [1e-2, 1e-3, 1e-4, 1e-6], int(np.argmin(tried))
            if not tried[best] < value:
                if (inverse == np.eye(n)).all():
                    return x, value, bool(np.abs(g).max() < 100 * still)
                inverse = np.eye(n)
                continue
        moved, fell = lengths[best] * d, value - tried[best]
        x, value = x + moved, tried[best]
        new = gradient(x)
        change, g = new - g, new
        if fell < 1e-10 * (1 + abs(value)) and np.abs(g).max() < 100 * still:
            return x, value, True
        along = change @ moved
        if along > 1e-12:
            if k == 0:
                inverse = np.eye(n) * along / (change @ change)
            a = np.eye(n) - np.outer(moved, change) / along
            inverse = a @ inverse @ a.T + np.outer(moved, moved) / along
    return x, value, False


# --- one random intercept --------------------------------------------------------------------------------

def design(labels: np.ndarray) -> np.ndarray:
    """Intercept, positive, negative, with neutral as the reference; columns that never vary are left out."""
    x = np.stack([np.ones(len(labels)), labels == "positive", labels == "negative"], 1).astype(float)
    return x


def columns(labels: np.ndarray) -> list[int]:
    """The columns of design() that can be told apart: without neutral turns positive is measured against negative."""
    have = [0, *(j for j, s in ((1, "positive"), (2, "negative")) if (labels == s).any())]
    return have if (labels == "neutral").any() else have[: max(len(have) - 1, 1)]


class RandomIntercept:
    """y ~ X + (1 | group) from cells: group number, design row, count, sum of y; and the sum of squares of y."""

    def __init__(self, group: np.ndarray, x: np.ndarray, n: np.ndarray, s: np.ndarray, q: float):
        self.N, self.p, self.q = float(n.sum()), x.shape[1], q
        groups = int(group.max()) + 1
        self.n = np.bincount(group, n, groups)
        self.S = np.bincount(group, s, groups)
        self.xg = np.stack([np.bincount(group, n * x[:, j], groups) for j in range(self.p)], 1)
        self.XX = (x * n[:, None]).T @ x
        self.Xy = x.T @ s

    def parts(self, lam: float) -> tuple[np.ndarray, np.ndarray, float]:
        w = lam / (1 + lam * self.n)
        a = self.XX - (self.xg * w[:, None]).T @ self.xg
        c = self.Xy - self.xg.T @ (w * self.S)
        beta = np.linalg.solve(a, c)
        return a, beta, max(self.q - float(w @ self.S**2) - float(beta @ c), 1e-300)

    def deviance(self, lam: float, reml: bool) -> float:
        a, _, rss = self.parts(lam)
        m = self.N - self.p if reml else self.N
        out = m * math.log(2 * math.pi * rss / m) + float(np.log1p(lam * self.n).sum()) + m
        return out + np.linalg.slogdet(a)[1] if reml else out

    def best(self, reml: bool) -> float:
        """Variance ratio with the least deviance; 0 if nothing above it is better."""
        grid = np.linspace(-14, 8, 45)
        at = int(np.argmin([self.deviance(math.exp(g), reml) for g in grid]))
        g = golden(lambda v: self.deviance(math.exp(v), reml), grid[max(at - 1, 0)], grid[min(at + 1, len(grid) - 1)])
        return math.exp(g) if self.deviance(math.exp(g), reml) < self.deviance(0.0, reml) else 0.0

    def log_likelihood(self) -> float:
        return -0.5 * self.deviance(self.best(False), False)


def lr_statistic(cells: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], q: float, null: float | None = None) -> float:
    """2 x (full - null) log-likelihood at ML of the sentiment effect; null may be given, as shuffles do not move it."""
    group, labels, n, s = cells
    x = design(labels)[:, columns(labels)]
    if null is None:
        null = RandomIntercept(group, x[:, :1], n, s, q).log_likelihood()
    try:
        return max(2 * (RandomIntercept(group, x, n, s, q).log_likelihood() - null), 0.0)
    except np.linalg.LinAlgError:
        return math.nan


def cells_of(rows: DataFrame, y: str, group: str, by: str = "sentiment", extra: tuple[str, ...] = ()) -> DataFrame:
    kept = rows.where(F.col(y).isNotNull() & ~F.isnan(y) & F.col(by).isin(*SENTIMENTS))
    return kept.groupBy(*extra, group, by).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("q"))


def _numbered(cells: pd.DataFrame, group: str, by: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    cells = cells.sort_values([group, by], kind="stable")
    codes = pd.factorize(cells[group])[0]
    return codes, cells[by].to_numpy(str), cells["n"].to_numpy(float), cells["s"].to_numpy(float)


def local(df: DataFrame) -> pd.DataFrame:
    """The cell table on the driver: one row for each patient and label."""
    return pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns)


def sentiment_model(rows: DataFrame, y: str, group: str) -> dict[str, float | str | int]:
    """The reported fit: omnibus likelihood ratio at ML; REML estimates, Satterthwaite t tests, variances, ICC.

    Fewer than 6 values, 3 patients or 2 labels: nulls with method not_fittable.
    """
    cells = local(cells_of(rows, y, group))
    sums = {"n": int(cells["n"].sum()) if len(cells) else 0, "q": math.fsum(cells["q"])}
    names = [f"{a}_{b}" for b in ("positive", "negative", "pos_vs_neg") for a in ("coef", "se", "z", "p")]
    out: dict = dict.fromkeys(["lr_stat", "lr_pval", *names, "sigma2_patient", "sigma2_resid", "icc"])
    out |= {"n_turns": sums["n"], "n_patients": cells[group].nunique() if len(cells) else 0, "method": "not_fittable"}
    if sums["n"] < 6 or out["n_patients"] < 3 or cells["sentiment"].nunique() < 2:
        return out
    numbered = _numbered(cells, group, "sentiment")
    codes, labels, n, s = numbered
    out["lr_stat"] = lr_statistic(numbered, sums["q"])
    out["lr_pval"] = chi2_sf(out["lr_stat"], 2)
    x, have = design(labels), columns(labels)
    fit = RandomIntercept(codes, x[:, have], n, s, sums["q"])
    lam = fit.best(True)
    a, beta, rss = fit.parts(lam)
    s2 = rss / (fit.N - fit.p)
    out |= {"sigma2_resid": s2, "sigma2_patient": lam * s2, "icc": lam / (1 + lam), "method": "lmer_singular" if lam * s2 < SINGULAR else "lmer"}
    contrasts = (("positive", (0, 1, 0)), ("negative", (0, 0, 1)), ("pos_vs_neg", (0, 1, -1)))
    if not (labels == "neutral").any():
        contrasts = (("pos_vs_neg", (0, 1, 0)),) if (labels == "positive").any() else ()
    for name, c in contrasts:
        if any(v and j not in have for j, v in enumerate(c)):
            continue
        row = np.array([c[j] for j in have], float)
        est, var = float(row @ beta), float(s2 * row @ np.linalg.solve(a, row))
        t, df = est / math.sqrt(var), _satterthwaite(fit, row, lam, s2)
        out |= {f"coef_{name}": est, f"se_{name}": math.sqrt(var), f"z_{name}": t, f"p_{name}": t_two_sided(t, df)}
    return out


def _satterthwaite(fit: RandomIntercept, row: np.ndarray, lam: float, s2: float) -> float:
    """Degrees of freedom of a contrast, over (group variance, residual variance)."""

    def deviance(v: np.ndarray) -> float:
        a, _, rss = fit.parts(v[0] / v[1])
        m = fit.N - fit.p
        return m * math.log(2 * math.pi * v[1]) + rss / v[1] + float(np.log1p(v[0] / v[1] * fit.n).sum()) + np.linalg.slogdet(a)[1]

    def variance(v: np.ndarray) -> float:
        return float(v[1] * row @ np.linalg.solve(fit.parts(v[0] / v[1])[0], row))

    return satterthwaite(deviance, variance, np.array([max(lam * s2, 1e-6 * s2), s2]), fit.N - fit.p)


def satterthwaite(deviance: Callable[[np.ndarray], float], variance: Callable[[np.ndarray], float], at: np.ndarray, most: float) -> float:
    """Degrees of freedom of an estimate from the curvature of the REML deviance in the variances; most: where there is none."""
    h, n = at * 1e-3, len(at)
    e = np.diag(h)
    grad = np.array([(variance(at + e[i]) - variance(at - e[i])) / (2 * h[i]) for i in range(n)])
    hess = np.empty((n, n))
    for i in range(n):
        for j in range(n):
            hess[i, j] = (deviance(at + e[i] + e[j]) - deviance(at + e[i] - e[j]) - deviance(at - e[i] + e[j]) + deviance(at - e[i] - e[j])) / (4 * h[i] * h[j])
    try:
        cov = 2 * np.linalg.inv(hess)
    except np.linalg.LinAlgError:
        return most
    spread = float(grad @ cov @ grad)
    return 2 * variance(at) ** 2 / spread if spread > 0 else most


# --- residuals -------------------------------------------------------------------------------------------

def moments(rows: DataFrame, column: str) -> DataFrame:
    """(n, skewness, kurtosis): of the population, kurtosis in excess."""
    return rows.agg(F.count(column).alias("n"), F.skewness(column).alias("skewness"), F.kurtosis(column).alias("kurtosis"))


def residuals(rows: DataFrame, y: str, group: str) -> DataFrame:
    """rows with resid: the value less the fitted label mean and the group's predicted effect, at REML."""
    kept = rows.where(F.col(y).isNotNull() & ~F.isnan(y) & F.col("sentiment").isin(*SENTIMENTS))
    cells = local(cells_of(rows, y, group)).sort_values([group, "sentiment"], kind="stable")
    q = math.fsum(cells["q"])
    code, labels, n, s = _numbered(cells, group, "sentiment")
    x, have = design(labels), columns(labels)
    fit = RandomIntercept(code, x[:, have], n, s, q)
    lam = fit.best(True)
    beta = fit.parts(lam)[1]
    effect = lam / (1 + lam * fit.n) * (fit.S - fit.xg @ beta)
    fitted = x[:, have] @ beta + effect[code]
    names = [f"{group} {rows.schema[group].dataType.simpleString()}", "sentiment string", "fitted double"]
    known = rows.sparkSession.createDataFrame([(g, t, float(f)) for g, t, f in zip(cells[group].tolist(), labels.tolist(), fitted, strict=True)], ", ".join(names))
    return kept.join(known, [group, "sentiment"]).withColumn("resid", F.col(y) - F.col("fitted")).drop("fitted")


class _Weights:
    """Royston's weights of order statistics: those of the two ends, and what the normal scores in between are divided by."""

    def __init__(self, n: int, square: float):
        """square: the sum of squares of all n normal scores."""
        m, u = normal_scores(n, np.array([n, n - 1])), 1 / math.sqrt(n)
        self.last = m[0] / math.sqrt(square) + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], u)
        self.before = None
        if n > 5:
            self.before = m[1] / math.sqrt(square) + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u)
            rest = (square - 2 * m[0] ** 2 - 2 * m[1] ** 2) / (1 - 2 * self.last**2 - 2 * self.before**2)
        else:
            rest = (square - 2 * m[0] ** 2) / (1 - 2 * self.last**2)
        self.scale = math.sqrt(rest)

    def statistic(self, n: int, scores: float, spread: float, low: Sequence[float], high: Sequence[float]) -> float:
        """W from the sum of normal score x value, the sum of squares about the mean, and the two ends, outermost first."""
        m = normal_scores(n, np.array([n, n - 1]))
        total = (scores - m[0] * (high[0] - low[0]) - (m[1] * (high[1] - low[1]) if self.before is not None else 0.0)) / self.scale
        total += self.last * (high[0] - low[0]) + (self.before * (high[1] - low[1]) if self.before is not None else 0.0)
        return float(min(total**2 / spread, 1.0))


def normal_scores(n: int, ranks: np.ndarray) -> np.ndarray:
    """About where order statistics of n normal values are expected; ranks from 1."""
    inverse = NormalDist().inv_cdf
    return np.array([inverse((r - 0.375) / (n + 0.25)) for r in ranks.tolist()])


def shapiro_p(w: float, n: int) -> float:
    """Royston's approximation, made for up to 5000 values and carried on beyond."""
    if w >= 1:
        return 1.0
    if n <= 11:
        g = np.polyval([0.459, -2.273], n)
        value = -math.log(g - math.log(1 - w)) if g > math.log(1 - w) else math.inf
        mean, spread = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        value, k = math.log(1 - w), math.log(n)
        mean, spread = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
    return float(1 - NormalDist().cdf((value - mean) / spread))


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and its p for 4 or more values that are not all the same; else NaN."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 4 or x[0] == x[-1]:
        return math.nan, math.nan
    m, x = normal_scores(n, np.arange(1, n + 1)), x - x.mean()
    w = _Weights(n, float(m @ m)).statistic(n, float(m @ x), float(x @ x), x[:2], x[:-3:-1])
    return w, shapiro_p(w, n)


def shapiro_wilk_of(rows: DataFrame, column: str) -> tuple[float, float]:
    """shapiro_wilk() of a column of any length, nulls left out: ranks are places in range partitions plus the rows of those before, and W needs
    two sums over rank and value. The driver sees a row for each partition and the two values at either end."""
    kept = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"), F.monotonically_increasing_id().alias("row"))
    placed = kept.repartitionByRange("x", "row").sortWithinPartitions("x", "row")  # row: equal values need not share a task
    placed = cut(placed.select("x", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    told = placed.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    n, mean = told["n"], told["mean"]
    if n < 4 or told["lo"] == told["hi"]:
        drop(placed)
        return math.nan, math.nan
    starts, before = {}, 0
    for r in placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        starts[r["part"]], before = before, before + r["n"]

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(3)
        for frame in frames:
            m = normal_scores(n, frame["part"].map(starts).to_numpy() + frame["place"].to_numpy() + 1)
            x = frame["x"].to_numpy() - mean
            sums += m @ x, m @ m, x @ x
        yield pd.DataFrame([sums], columns=["mx", "mm", "xx"])

    reachable()
    s = placed.mapInPandas(add, "mx double, mm double, xx double").agg(*[F.sum(c).alias(c) for c in ("mx", "mm", "xx")]).first()
    low, high = ([r["x"] for r in placed.select("x").orderBy(o).limit(2).collect()] for o in (F.asc("x"), F.desc("x")))
    drop(placed)
    w = _Weights(n, s["mm"]).statistic(n, s["mx"], s["xx"], low, high)
    return w, shapiro_p(w, n)


def residual_normality(rows: DataFrame, y: str, group: str) -> dict[str, float | None]:
    """resid_skewness and resid_kurtosis over all rows, resid_shapiro_w and _p."""
    resid = cut(residuals(rows, y, group).select("resid"))
    m = moments(resid, "resid").first()
    w, p = shapiro_wilk_of(resid, "resid")
    drop(resid)
    return {"resid_shapiro_w": w, "resid_shapiro_p": p, "resid_skewness": m["skewness"], "resid_kurtosis": m["kurtosis"]}
