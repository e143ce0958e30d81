"""Mixed models with crossed intercepts, interviewer and participant.

Participants are eliminated first: their part of every system is one small block each, and their ties to interviewers
are summed chunk by chunk. What is left is as wide as there are interviewers. A table of cells of up to LOCAL_CELLS rows is fitted on the driver;
a larger one stays in Spark (operators.blocks), where participants are eliminated in the tasks, and the driver holds one matrix of interviewers x
interviewers, however many participants and turns there are. Both give the same deviances.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.operators.models import SINGULAR, chi2_sf, local, quasi_newton, satterthwaite, t_two_sided
from turnloom.scratch import cut

#: Participants whose ties to interviewers are held as a dense block at a time.
CHUNK = 2048
#: Rows of a table of cells that the driver fits itself; it changes where the work is done, not what comes of it.
LOCAL_CELLS = 1 << 17
#: Newton steps for the modes of the effects, the decrement at which they stand (the log determinant moves with its root), and that under
#: which a whole step is taken unseen, as the likelihood's own rounding is larger.
STEPS, STILL, SURE = 200, 1e-17, 1e-10


class Ties:
    """Solves with M = I + sum over cells of w h h', h: t at the cell's interviewer, g (m numbers) at its participant."""

    def __init__(self, i: np.ndarray, j: np.ndarray, alike: np.ndarray | None = None):
        """j ascends. alike: for how many participants with the same cells each one stands; they have the same solution."""
        self.i, self.j = i, j
        self.a, self.b = int(i.max()) + 1, int(j.max()) + 1
        self.alike = np.ones(self.b) if alike is None else alike
        self.often = self.alike[j]

    def factor(self, w: np.ndarray, t: float, g: np.ndarray) -> float:
        """Prepares solve(); returns log det M."""
        m = g.shape[1]
        self.w, self.t, self.g, self.m = w, t, g, m
        own = np.zeros((self.b, m, m))
        for r in range(m):
            for s in range(m):
                own[:, r, s] = np.bincount(self.j, w * g[:, r] * g[:, s], self.b)
        own += np.eye(m)
        self.inverse = np.linalg.inv(own)
        left = np.diag(1 + t * t * np.bincount(self.i, w * self.often, self.a))
        for lo in range(0, self.b, CHUNK):
            n = min(CHUNK, self.b - lo)
            part = slice(*np.searchsorted(self.j, (lo, lo + n)))
            at = self.i[part] * n + self.j[part] - lo
            tie = np.stack([np.bincount(at, t * w[part] * g[part, r], self.a * n).reshape(self.a, n) for r in range(m)], 2)
            left -= np.einsum("ajr,jrs,j->ajs", tie, self.inverse[lo : lo + n], self.alike[lo : lo + n]).reshape(self.a, -1) @ tie.reshape(self.a, -1).T
        self.left = np.linalg.inv(left)
        return float(np.linalg.slogdet(left)[1] + self.alike @ np.linalg.slogdet(own)[1])

    def solve(self, ra: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """M^-1 of right sides over interviewers (a x k) and participants (b x m x k)."""
        half = np.einsum("jrs,jsk->jrk", self.inverse, rb)
        wg = self.t * self.w[:, None] * self.g
        back = np.stack([np.bincount(self.i, self.often * (wg * half[self.j, :, k]).sum(1), self.a) for k in range(ra.shape[1])], 1)
        ua = self.left @ (ra - back)
        forth = np.stack([np.stack([np.bincount(self.j, wg[:, r] * ua[self.i, k], self.b) for r in range(self.m)], 1) for k in range(ra.shape[1])], 2)
        return ua, np.einsum("jrs,jsk->jrk", self.inverse, rb - forth)


def _coded(cells: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    cells = cells.sort_values(["participant_id", "interviewer_id", "sentiment"], kind="stable")
    j, i = pd.factorize(cells["participant_id"])[0], pd.factorize(cells["interviewer_id"], sort=True)[0]
    return cells, i, j, (cells["sentiment"] == "positive").to_numpy(float)


class Crossed:
    """y ~ positive + (1 | interviewer) + (1 | participant), or with the slope of positive by participant.

    cells: interviewer_id, participant_id, sentiment, n, s (sum of y); q: the sum of squares of y. theta: deviations relative
    to the residual's, for interviewers and participants (with the slope: the lower triangle of their factor).
    """

    def __init__(self, cells: pd.DataFrame, q: float, slope: bool = False, null: bool = False):
        cells, i, j, d = _coded(cells)
        self.ties, self.slope, self.q = Ties(i, j), slope, q
        self.n, s = cells["n"].to_numpy(float), cells["s"].to_numpy(float)
        x = np.stack([np.ones(len(d)), d], 1)
        self.z = x if slope else x[:, :1]
        x = x[:, : 1 if null else 2]
        self.N, self.p = float(self.n.sum()), x.shape[1]
        nx = np.concatenate([self.n[:, None] * x, s[:, None]], 1)
        self.ra = np.stack([np.bincount(i, c, self.ties.a) for c in nx.T], 1)
        self.rb = np.stack([np.stack([np.bincount(j, self.z[:, r] * c, self.ties.b) for r in range(self.z.shape[1])], 1) for c in nx.T], 2)
        self.XX, self.Xy = (x * self.n[:, None]).T @ x, x.T @ s

    def parts(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Information of the fixed effects, the effects, residual sum of squares, log determinant."""
        lower = np.array([[theta[1], 0.0], [theta[2], theta[3]]]) if self.slope else np.array([[theta[1]]])
        logdet = self.ties.factor(self.n, float(theta[0]), self.z @ lower)
        ra, rb = theta[0] * self.ra, np.einsum("rs,jrk->jsk", lower, self.rb)
        ua, ub = self.ties.solve(ra, rb)
        taken = ra.T @ ua + np.einsum("jrk,jrl->kl", rb, ub)
        info, c = self.XX - taken[:-1, :-1], self.Xy - taken[:-1, -1]
        beta = np.linalg.solve(info, c)
        return info, beta, max(self.q - float(taken[-1, -1]) - float(beta @ c), 1e-300), logdet

    def parts_many(self, thetas: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
        return [self.parts(t) for t in thetas]

    def deviances(self, thetas: list[np.ndarray], reml: bool) -> list[float]:
        out = []
        for info, _, rss, logdet in self.parts_many(thetas):
            m = self.N - self.p if reml else self.N
            out.append(m * math.log(2 * math.pi * rss / m) + logdet + m + (np.linalg.slogdet(info)[1] if reml else 0.0))
        return out

    def deviance(self, theta: np.ndarray, reml: bool) -> float:
        return self.deviances([theta], reml)[0]

    def fit(self, reml: bool, starts: tuple = ()) -> tuple[np.ndarray, float, bool]:
        """The best of searches from the starts; theta may come with any sign, as only squares of deviations count."""
        width = 4 if self.slope else 2
        found = [quasi_newton(lambda t: self.deviances(t, reml), np.asarray(s, float), step=1e-5, still=1e-5) for s in starts or (np.full(width, 0.3), np.full(width, 1.0))]
        theta, value, ok = min(found, key=lambda r: r[1])
        flat = [np.where(keep, theta, 0.0) for keep in ([False, True], [True, False], [False, False])] if width == 2 else []
        for t, v in zip(flat, self.deviances(flat, reml) if flat else [], strict=True):
            if v <= value + 1e-9:  # a variance that does not help is none
                theta, value = t, v
        return theta, value, ok

    def effect_df(self, theta: np.ndarray, s2: float) -> float:
        """Satterthwaite's degrees of freedom of the sentiment effect at REML."""

        def ratios(v: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(v[:2], 0) / v[2])

        def deviance(v: np.ndarray) -> float:
            info, _, rss, logdet = self.parts(ratios(v))
            return (self.N - self.p) * math.log(2 * math.pi * v[2]) + rss / v[2] + logdet + np.linalg.slogdet(info)[1]

        def variance(v: np.ndarray) -> float:
            return float(v[2] * np.linalg.inv(self.parts(ratios(v))[0])[1, 1])

        at = np.array([max(theta[0] ** 2 * s2, 1e-6 * s2), max(theta[1] ** 2 * s2, 1e-6 * s2), s2])
        return satterthwaite(deviance, variance, at, self.N - self.p)


class Laplace:
    """What a binomial model needs besides deviances(points): x_columns fixed effects, per_row, rate (share of successes)."""

    def deviance(self, v: np.ndarray) -> float:
        return self.deviances([v])[0]

    def start(self) -> np.ndarray:
        rate = np.clip(self.rate, 1e-4, 1 - 1e-4)
        return np.concatenate([[math.log(rate / (1 - rate))], np.zeros(self.columns - 1), np.full(3 if self.per_row else 2, 0.5)])

    def fit(self, start: np.ndarray | None = None) -> tuple[np.ndarray, float, bool]:
        """Estimates, deviance, whether the search settled; never worse than start."""
        return quasi_newton(self.deviances, self.start() if start is None else start, still=2e-4)

    def errors(self, v: np.ndarray) -> np.ndarray:
        """Standard errors of the fixed effects, from the curvature over all parameters; of those alone at a boundary."""
        p = self.columns
        inner = [*range(p), *(q for q in range(p, len(v)) if abs(v[q]) > 1e-2)]
        for among in (inner, list(range(p))):
            e = np.eye(len(v))[among] * 1e-3
            pairs = [(a, b) for a in range(len(e)) for b in range(a, len(e))]
            got = iter(self.deviances([v + x * e[a] + y * e[b] for a, b in pairs for x, y in ((1, 1), (1, -1), (-1, 1), (-1, -1))]))
            curve = np.zeros((len(e), len(e)))
            for a, b in pairs:
                pp, pm, mp, mm = (next(got) for _ in range(4))
                curve[a, b] = curve[b, a] = (pp - pm - mp + mm) / 4e-6
            try:
                cov = 2 * np.linalg.inv(curve)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(cov).all() and np.linalg.eigvalsh((cov + cov.T) / 2).min() > 0:
                return np.sqrt(np.diag(cov)[:p])
        return np.full(p, math.nan)


class Binomial(Laplace):
    """succ of n ~ positive + (1 | interviewer) + (1 | participant) [+ (1 | observation)], Laplace approximation.

    cells: interviewer_id, participant_id, sentiment, succ, n, times (how many observations are just alike) and, if there is such a column, alike (for
    how many participants with the same cells this one stands). Alike observations share the mode of their own effect, and alike
    participants that of theirs, so one row stands for them. Nothing is kept from one
    evaluation to the next: the modes are always sought from zero, by Newton steps that are halved until the penalised
    log-likelihood rises. It is concave, so they are found; should steps run out, the deviance is infinite.
    """

    def __init__(self, cells: pd.DataFrame, per_row: bool, null: bool = False):
        cells, i, j, d = _coded(cells)
        alike = cells["alike"].to_numpy(float)[np.unique(j, return_index=True)[1]] if "alike" in cells else None
        self.ties = Ties(i, j, alike)
        self.k, self.n, self.w = (cells[c].to_numpy(float) for c in ("succ", "n", "times"))
        self.x = np.stack([np.ones(len(d)), d], 1)[:, : 1 if null else 2]
        self.per_row = per_row
        choose = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for n, k in zip(self.n, self.k, strict=True)]
        every = self.w * self.ties.often
        self.choose = float(every @ np.array(choose))
        self.columns, self.rate = self.x.shape[1], float(every @ self.k / (every @ self.n))

    def deviances(self, points: list[np.ndarray]) -> list[float]:
        return [self._deviance(v) for v in points]

    def _deviance(self, v: np.ndarray) -> float:
        i, j, w, n, k = self.ties.i, self.ties.j, self.w, self.n, self.k
        p = self.x.shape[1]
        t, g = abs(float(v[p])), abs(float(v[p + 1]))
        own = abs(float(v[p + 2])) if self.per_row else 0.0
        fixed, alike, often = self.x @ v[:p], self.ties.alike, self.ties.often
        ui, uj, e = np.zeros(self.ties.a), np.zeros(self.ties.b), np.zeros(len(n))

        def at(ui: np.ndarray, uj: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, float]:
            eta = fixed + t * ui[i] + g * uj[j] + own * e
            return eta, float((often * w) @ (k * eta - n * np.logaddexp(0, eta) - e * e / 2) - (ui @ ui + alike @ (uj * uj)) / 2)

        eta, value = at(ui, uj, e)
        for _ in range(STEPS):
            mu = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
            r, h = k - n * mu, np.maximum(n * mu * (1 - mu), 1e-12)
            de, ge = 1 + own * own * h, own * r - e
            logdet = self.ties.factor(w * h / de, t, np.full((len(n), 1), g))
            rest = w * (r - h * own * ge / de)  # each observation's own effect eliminated
            di, dj = self.ties.solve((t * np.bincount(i, often * rest, self.ties.a) - ui)[:, None], (g * np.bincount(j, rest, self.ties.b) - uj)[:, None, None])
            di, dj = di[:, 0], dj[:, 0, 0]
            ds = (ge - own * h * (t * di[i] + g * dj[j])) / de
            gain = float((t * np.bincount(i, often * w * r, self.ties.a) - ui) @ di + alike @ ((g * np.bincount(j, w * r, self.ties.b) - uj) * dj) + (often * w) @ (ge * ds))
            if gain < STILL * (1 + abs(value)):
                return -2 * (self.choose + value) + logdet + float((often * w) @ np.log(de))
            step = 1.0
            while True:
                new_eta, new = at(ui + step * di, uj + step * dj, e + step * ds)
                if new >= value + 1e-4 * step * gain or step < 1e-8 or gain < SURE * (1 + abs(value)):
                    break
                step /= 2
            ui, uj, e, eta, value = ui + step * di, uj + step * dj, e + step * ds, new_eta, new
        return math.inf


def nested(cells: pd.DataFrame, per_row: bool) -> tuple[Laplace, np.ndarray, float, float, bool]:
    """best_nested() of a table of cells."""
    return best_nested(Binomial(cells, per_row, null=True), Binomial(cells, per_row))


def best_nested(null: Laplace, full: Laplace) -> tuple[Laplace, np.ndarray, float, float, bool]:
    """The full model, its estimates, deviances without and with the effect, and whether both searches settled.

    The full search starts at the null's optimum, so the likelihood ratio cannot be negative; a null that the full fit's
    variances improve is sought again from there.
    """
    v0, dev0, ok0 = null.fit()
    v, dev, ok = full.fit(np.insert(v0, 1, 0.0))
    if null.deviance(np.delete(v, 1)) < dev0 - 1e-6:
        v0, dev0, ok0 = null.fit(np.delete(v, 1))
        if dev0 < dev:
            v, dev, ok = full.fit(np.insert(v0, 1, 0.0))
    return full, v, dev0, dev, ok and ok0


FOCAL_FIELDS = (
    "n_obs", "n_participants", "n_interviewers", "estimate", "se", "z", "p_wald", "lrt_stat", "p_lrt", "lrt_source", "odds_ratio",
    "sigma2_interviewer", "sigma2_participant", "slope_var_participant", "slope_lrt_stat", "slope_p_lrt", "slope_source", "converged", "engine", "method",
)


def _base(cells: DataFrame, count: str, engine: str) -> tuple[dict, bool]:
    """An empty result and whether there is enough to fit: two of each factor and ten observations."""
    out: dict = dict.fromkeys(FOCAL_FIELDS) | {"method": "not_fittable", "converged": False, "engine": engine}
    told = cells.agg(
        F.coalesce(F.sum(count), F.lit(0)).alias("n_obs"), F.countDistinct("participant_id").alias("n_participants"),
        F.countDistinct("interviewer_id").alias("n_interviewers"), F.countDistinct("sentiment").alias("labels"),
    ).first()
    out |= {k: int(told[k]) for k in ("n_obs", "n_participants", "n_interviewers")}
    return out, min(out["n_participants"], out["n_interviewers"], told["labels"]) >= 2 and out["n_obs"] >= 10


def _flat(out: dict) -> str:
    """The factors whose variance is at the boundary."""
    flat = [m for m in ("interviewer", "participant") if out[f"sigma2_{m}"] < SINGULAR]
    return f"_singular({'+'.join(flat)})" if flat else ""


def _gaussian_cells(rows: DataFrame, y: str) -> DataFrame:
    """A row for each pair of partners and label, in the scratch folder."""
    kept = rows.where(F.col(y).isNotNull() & ~F.isnan(y) & F.col("sentiment").isin("negative", "positive"))
    return cut(kept.groupBy("interviewer_id", "participant_id", "sentiment").agg(F.count("*").alias("n"), F.sum(y).cast("double").alias("s"), F.sum(F.col(y) * F.col(y)).cast("double").alias("q")))


def alike(cells: DataFrame, *columns: str) -> DataFrame:
    """The cells of one participant for all who have the same ones, in the scratch folder, with their number as `alike`.

    Their effects have the same mode and they add the same to every sum, so nothing is lost, and a fit's work grows with the different participants.
    """
    own = F.array_sort(F.collect_list(F.struct("interviewer_id", "sentiment", *columns)))
    each = cells.groupBy("participant_id").agg(own.alias("own")).groupBy("own").agg(F.min("participant_id").alias("participant_id"), F.count("*").alias("alike"))
    return cut(each.select("participant_id", "alike", F.explode("own").alias("cell")).select("participant_id", "alike", "cell.*"))


def _gaussian(cells: DataFrame) -> Callable[..., Crossed]:
    """Makes models of the cells: on the driver up to LOCAL_CELLS of them, else in Spark."""
    if cells.count() <= LOCAL_CELLS:
        own = local(cells)
        return partial(Crossed, own, math.fsum(own["q"]))
    from turnloom.operators import blocks

    return partial(blocks.CrossedBlocks, blocks.Blocks(cells, ("n", "s")), blocks.gaussian_totals(cells))


def slope_check(model: Callable[..., Crossed], theta: np.ndarray, ml: float) -> dict:
    """Does the difference vary between participants? ML fits with and without the slope, the first from the second's end."""
    sloped = model(slope=True)
    theta, dev, _ = sloped.fit(False, ([theta[0], theta[1], 0.0, 0.05], [theta[0], theta[1], 0.0, 0.7]))
    s2 = sloped.parts(theta)[2] / sloped.N
    stat = max(ml - dev, 0.0)
    return {"slope_var_participant": float((theta[2] ** 2 + theta[3] ** 2) * s2), "slope_lrt_stat": stat, "slope_p_lrt": chi2_sf(stat, 2), "slope_source": "random_slope_ml"}


def focal_model(rows: DataFrame, y: str) -> dict[str, float | str | int | bool | None]:
    """Positive against negative with crossed intercepts: REML estimate with Satterthwaite's p, ML likelihood ratio, slope check.

    rows: sentiment (negative or positive), interviewer_id, participant_id and y.
    """
    cells = _gaussian_cells(rows, y)
    out, enough = _base(cells, "n", "spark_cells_lmm")
    if not enough:
        return out
    model = _gaussian(cells)
    full = model()
    theta, _, out["converged"] = full.fit(True)
    info, beta, rss, _ = full.parts(theta)
    s2 = rss / (full.N - full.p)
    out |= {"estimate": float(beta[1]), "se": math.sqrt(s2 * np.linalg.inv(info)[1, 1])}
    if out["se"] > 0:
        out["z"] = out["estimate"] / out["se"]
        out["p_wald"] = t_two_sided(out["z"], full.effect_df(theta, s2))
    out["sigma2_interviewer"], out["sigma2_participant"] = (float(t * t * s2) for t in theta)
    flat, none, _ = model(null=True).fit(False)
    theta, ml, _ = full.fit(False, (flat, np.full(2, 0.5)))
    out["lrt_stat"] = max(none - ml, 0.0)
    out |= {"p_lrt": chi2_sf(out["lrt_stat"], 1), "lrt_source": "lrt_ml", "method": f"lmer{_flat(out)}"}
    return out | slope_check(model, theta, ml)


def focal_slope(rows: DataFrame, y: str) -> dict[str, float | str | None]:
    """The slope check alone; nulls if there is too little to fit."""
    cells = _gaussian_cells(rows, y)
    out, enough = _base(cells, "n", "")
    if not enough:
        return {"slope_var_participant": None, "slope_lrt_stat": None, "slope_p_lrt": None, "slope_source": "unavailable:not_fittable" if out["n_obs"] else "empty"}
    model = _gaussian(cells)
    theta, ml, _ = model().fit(False)
    return slope_check(model, theta, ml)


def focal_binomial(rows: DataFrame, succ: str, total: str, per_row: bool = True) -> dict[str, float | str | int | bool | None]:
    """Aggregated counts with an effect for each observation, or (per_row False) whether there was any success.

    A cell is a distinct (partners, label, successes, trials); participants whose cells are the same are one, counted; up to LOCAL_CELLS
    cells of different participants are fitted on the driver, more in Spark.
    """
    kept = rows.where(F.col("sentiment").isin("negative", "positive") & (F.col(total) > 0))
    k = F.col(succ).cast("double") if per_row else (F.col(succ) > 0).cast("double")
    n = F.greatest(F.col(total), F.col(succ)).cast("double") if per_row else F.lit(1.0)
    cells = cut(kept.groupBy("interviewer_id", "participant_id", "sentiment", k.alias("succ"), n.alias("n")).agg(F.count("*").alias("times")))
    out, enough = _base(cells, "times", "spark_cells_laplace")
    if not enough:
        return out
    if not per_row and cells.select("succ").distinct().count() < 2:
        return out | {"method": "no_variance_in_binary_dv"}
    cells = alike(cells, "succ", "n", "times")
    if cells.count() <= LOCAL_CELLS:
        full, v, none, dev, out["converged"] = nested(local(cells), per_row)
    else:
        from turnloom.operators import blocks

        table, total = blocks.Blocks(cells, ("succ", "n", "times", "alike")), blocks.binomial_totals(cells)
        full, v, none, dev, out["converged"] = best_nested(blocks.BinomialBlocks(table, total, per_row, null=True), blocks.BinomialBlocks(table, total, per_row))
    se = float(full.errors(v)[1])
    out |= {"estimate": float(v[1]), "odds_ratio": math.exp(v[1]), "lrt_stat": max(none - dev, 0.0), "lrt_source": "lrt_laplace"}
    out["p_lrt"] = chi2_sf(out["lrt_stat"], 1)
    if se > 0:
        out |= {"se": se, "z": out["estimate"] / se, "p_wald": math.erfc(abs(out["estimate"] / se) / math.sqrt(2))}
    out["sigma2_interviewer"], out["sigma2_participant"] = float(v[2] ** 2), float(v[3] ** 2)
    out["method"] = f"glmer_olre{_flat(out)}" if per_row else "glmer_bernoulli"
    return out
