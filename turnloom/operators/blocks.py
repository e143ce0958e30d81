"""Crossed models on cells that stay in Spark: participants are eliminated in the tasks, interviewers are solved for on the driver.

The cells of a participant lie in one row of a table of blocks, in the scratch folder. A pass over it is given many points of the parameters at
once and adds up, for each of them, what is left when the block's participants (and, in the binomial model, each observation's own effect) are
eliminated: a matrix as wide as there are interviewers, and a few sums. Nothing that grows with participants or turns reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.operators.crossed import CHUNK, STEPS, STILL, SURE, Crossed, Laplace
from turnloom.scratch import cut
from turnloom.workers import reachable

#: Cells of one block, about. A participant's cells are never parted, so a block is as large as its largest participant at least.
BLOCK_CELLS = 1 << 14
#: Passes after which an interviewer's effect that still moves ends the evaluation without a value.
PASSES = 60


class Blocks:
    """cells (interviewer_id, participant_id, sentiment and columns) as blocks; interviewers are numbered by their order."""

    def __init__(self, cells: DataFrame, columns: tuple[str, ...]):
        names = [r[0] for r in cells.select("interviewer_id").distinct().orderBy("interviewer_id").collect()]
        self.a, self.columns = len(names), columns
        kind = cells.schema["interviewer_id"].dataType.simpleString()
        codes = cells.sparkSession.createDataFrame([(x, k) for k, x in enumerate(names)], f"interviewer_id {kind}, i int")
        met = cells.join(codes, "interviewer_id").select(
            F.xxhash64("participant_id").alias("h"), F.col("participant_id").cast("string").alias("j"), "i", (F.col("sentiment") == "positive").cast("double").alias("d"), *[F.col(c).cast("double").alias(c) for c in columns]
        )
        parts = max(1, math.ceil(cells.count() / BLOCK_CELLS))
        rows = F.array_sort(F.collect_list(F.struct("j", "i", "d", *columns)))
        each = met.groupBy(F.pmod("h", F.lit(parts)).alias("block")).agg(rows.alias("r"))
        self.table = cut(each.select(*[F.col(f"r.{c}").alias(c) for c in ("j", "i", "d", *columns)]).repartition(parts))

    def sums(self, kernel: Callable[[dict, int, list], np.ndarray], points: list, width: int) -> np.ndarray:
        """points x width: kernel(block, interviewers, points) added up over all blocks."""
        a, names = self.a, ["j", "i", "d", *self.columns]

        def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(points), width))
            for frame in frames:
                for row in frame[names].itertuples(index=False, name=None):
                    block = {c: np.asarray(v, float) for c, v in zip(names[1:], row[1:], strict=True)}
                    block |= {"i": block["i"].astype(int), "j": pd.factorize(np.asarray(row[0]))[0]}
                    total += kernel(block, a, points)
            at, slot = np.nonzero(total)
            yield pd.DataFrame({"at": at.astype("int32"), "slot": slot.astype("int32"), "v": total[at, slot]})

        reachable()
        found = self.table.mapInPandas(add, "at int, slot int, v double").groupBy("at", "slot").agg(F.sum("v").alias("v"))
        out = np.zeros((len(points), width))
        for r in found.collect():
            out[r["at"], r["slot"]] = r["v"]
        return out


def _ties(block: dict, a: int, weight: np.ndarray, inverse: np.ndarray, g: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over participants of tie inverse tie' (a x a) and tie inverse rb (a x k), tie: an interviewer's weights g at the participant."""
    i, j, m = block["i"], block["j"], g.shape[1]
    square, side = np.zeros((a, a)), np.zeros((a, rb.shape[2]))
    for lo in range(0, len(inverse), CHUNK):
        n = min(CHUNK, len(inverse) - lo)
        part = slice(*np.searchsorted(j, (lo, lo + n)))
        at = i[part] * n + j[part] - lo
        tie = np.stack([np.bincount(at, weight[part] * g[part, r], a * n).reshape(a, n) for r in range(m)], 2)
        half = np.einsum("ajr,jrs->ajs", tie, inverse[lo : lo + n])
        square += half.reshape(a, -1) @ tie.reshape(a, -1).T
        side += np.einsum("ajs,jsk->ak", half, rb[lo : lo + n])
    return square, side


def _gaussian(block: dict, a: int, points: list) -> np.ndarray:
    """For each (theta, lower factor, columns of x): left (a x a), right sides (a x k), taken (k x k), log determinant."""
    i, j, n = block["i"], block["j"], block["n"]
    b, out = int(j.max()) + 1, []
    both = np.stack([np.ones(len(n)), block["d"]], 1)
    for theta, lower, columns in points:
        z, t, k = both[:, : len(lower)], float(theta[0]), columns + 1
        nx = np.concatenate([n[:, None] * both[:, :columns], block["s"][:, None]], 1)
        g = z @ lower
        own = np.stack([np.stack([np.bincount(j, n * g[:, r] * g[:, s], b) for s in range(len(lower))], 1) for r in range(len(lower))], 1) + np.eye(len(lower))
        inverse = np.linalg.inv(own)
        ra = t * np.stack([np.bincount(i, c, a) for c in nx.T], 1)
        rb = np.stack([np.stack([np.bincount(j, g[:, r] * c, b) for r in range(len(lower))], 1) for c in nx.T], 2)
        square, side = _ties(block, a, t * n, inverse, g, rb)
        left = np.diag(t * t * np.bincount(i, n, a)) - square
        taken = np.einsum("jrk,jrs,jsl->kl", rb, inverse, rb)
        out.append(np.concatenate([left.ravel(), (ra - side).ravel(), taken.ravel(), [np.linalg.slogdet(own)[1].sum()]]))
        assert len(out[-1]) == a * a + a * k + k * k + 1
    return np.stack(out)


class CrossedBlocks(Crossed):
    """Crossed on cells (interviewer_id, participant_id, sentiment, n, s) in Spark: the same numbers, from one pass for many thetas."""

    def __init__(self, blocks: Blocks, total: dict, slope: bool = False, null: bool = False):
        self.blocks, self.slope, self.p = blocks, slope, 1 if null else 2
        self.q, self.N = float(total["q"]), float(total["n"])
        n1, s1 = float(total["n1"]), float(total["s1"])
        self.XX, self.Xy = np.array([[self.N, n1], [n1, n1]])[: self.p, : self.p], np.array([float(total["s"]), s1])[: self.p]

    def parts(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        return self.parts_many([theta])[0]

    def parts_many(self, thetas: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
        if not thetas:
            return []
        a, k = self.blocks.a, self.p + 1
        points = [(np.asarray(t, float), np.array([[t[1], 0.0], [t[2], t[3]]]) if self.slope else np.array([[t[1]]]), self.p) for t in thetas]
        out = []
        for row in self.blocks.sums(_gaussian, points, a * a + a * k + k * k + 1):
            left, ra, taken, logdet = np.split(row, np.cumsum([a * a, a * k, k * k]))
            left, ra = np.eye(a) + left.reshape(a, a), ra.reshape(a, k)
            taken = taken.reshape(k, k) + ra.T @ np.linalg.solve(left, ra)
            info, c = self.XX - taken[:-1, :-1], self.Xy - taken[:-1, -1]
            beta = np.linalg.solve(info, c)
            out.append((info, beta, max(self.q - float(taken[-1, -1]) - float(beta @ c), 1e-300), float(logdet[0] + np.linalg.slogdet(left)[1])))
        return out


def _binomial(block: dict, a: int, points: list) -> np.ndarray:
    """For each (b0, b1, t, g, own, u): at the modes of the participants and of the observations' own effects, given the interviewers' u, the
    penalised log-likelihood, its log determinant, its slope in u and its curvature in u with them eliminated."""
    i, j, d, k, n, w = (block[c] for c in ("i", "j", "d", "succ", "n", "times"))
    b, out = int(j.max()) + 1, []
    often = block["alike"] if "alike" in block else np.ones(len(j))
    alike = np.zeros(b)
    alike[j] = often  # for how many participants one stands
    for b0, b1, t, g, own, u in points:
        fixed = b0 + b1 * d + t * np.asarray(u)[i]
        uj, e = np.zeros(b), np.zeros(len(n))

        def at(uj: np.ndarray, e: np.ndarray, fixed: np.ndarray = fixed, g: float = g, own: float = own) -> tuple[np.ndarray, np.ndarray]:
            eta = fixed + g * uj[j] + own * e
            return eta, np.bincount(j, w * (k * eta - n * np.logaddexp(0, eta) - e * e / 2), b) - uj * uj / 2

        eta, value = at(uj, e)
        for _ in range(STEPS):
            mu = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
            r, h = k - n * mu, np.maximum(n * mu * (1 - mu), 1e-12)
            de, ge = 1 + own * own * h, own * r - e
            dj = 1 + g * g * np.bincount(j, w * h / de, b)
            step_j = (g * np.bincount(j, w * (r - h * own * ge / de), b) - uj) / dj
            step_e = (ge - own * h * g * step_j[j]) / de
            gain = (g * np.bincount(j, w * r, b) - uj) * step_j + np.bincount(j, w * ge * step_e, b)
            if (gain < STILL * (1 + np.abs(value))).all():
                break
            size = np.ones(b)  # of each participant's own step
            while True:
                new_eta, new = at(uj + size * step_j, e + size[j] * step_e)
                bad = (new < value + 1e-4 * size * gain) & (size >= 1e-8) & (gain >= SURE * (1 + np.abs(value)))
                if not bad.any():
                    break
                size[bad] /= 2
            uj, e, eta, value = uj + size * step_j, e + size[j] * step_e, new_eta, new
        else:
            out.append(np.full(2 + a + a * a, math.nan))
            continue
        he = w * h / de
        square, _ = _ties(block, a, t * he, (alike / dj)[:, None, None], np.full((len(n), 1), g), np.zeros((b, 1, 1)))
        curve = np.diag(t * t * np.bincount(i, often * he, a)) - square
        out.append(np.concatenate([[alike @ value, alike @ np.log(dj) + (often * w) @ np.log(de)], t * np.bincount(i, often * w * r, a), curve.ravel()]))
    return np.stack(out)


class BinomialBlocks(Laplace):
    """Binomial on cells (interviewer_id, participant_id, sentiment, succ, n, times) in Spark: the same deviances.

    Given the interviewers' effects, participants do not see each other, so their modes are found in the tasks; the interviewers' are Newton steps on
    the driver, a pass each, for all points that are asked for at once. The penalised likelihood is concave, so they are found from anywhere: they start at
    those of the best point so far, which saves passes; steps that do not raise it are halved.
    """

    def __init__(self, blocks: Blocks, total: dict, per_row: bool, null: bool = False):
        self.blocks, self.per_row, self.columns = blocks, per_row, 1 if null else 2
        self.choose, self.rate = float(total["choose"]), float(total["succ"] / total["n"])
        self.from_, self.least = np.zeros(blocks.a), math.inf

    def deviances(self, points: list[np.ndarray]) -> list[float]:
        a, p, out = self.blocks.a, self.columns, [math.inf] * len(points)
        fixed = [(float(v[0]), float(v[1]) if p == 2 else 0.0, abs(float(v[p])), abs(float(v[p + 1])), abs(float(v[p + 2])) if self.per_row else 0.0) for v in points]
        u, before, move, size = np.tile(self.from_, (len(points), 1)), np.full(len(points), -math.inf), np.zeros((len(points), a)), np.ones(len(points))
        live = list(range(len(points)))
        for _ in range(PASSES):
            tried = {x: u[x] + size[x] * move[x] for x in live}
            rows = self.blocks.sums(_binomial, [(*fixed[x], tried[x]) for x in live], 2 + a + a * a)
            left = []
            for x, row in zip(live, rows, strict=True):
                value = row[0] - tried[x] @ tried[x] / 2
                if not np.isfinite(row).all():
                    continue
                if value < before[x] - 1e-9 * (1 + abs(value)) and size[x] > 1e-6:
                    size[x] /= 2
                    left.append(x)
                    continue
                u[x], before[x], size[x] = tried[x], value, 1.0
                curve, slope = np.eye(a) + row[2 + a :].reshape(a, a), row[2 : 2 + a] - u[x]
                move[x] = np.linalg.solve(curve, slope)
                if slope @ move[x] < STILL * (1 + abs(value)):
                    out[x] = float(-2 * (self.choose + value) + row[1] + np.linalg.slogdet(curve)[1])
                else:
                    left.append(x)
            live = left
            if not live:
                break
        best = min(range(len(points)), key=out.__getitem__)
        if out[best] < self.least:
            self.from_, self.least = u[best], out[best]
        return out


def gaussian_totals(cells: DataFrame) -> dict:
    positive = F.col("sentiment") == "positive"
    both = {c: F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "s", "q")}
    one = {f"{c}1": F.coalesce(F.sum(F.when(positive, F.col(c))), F.lit(0)).alias(f"{c}1") for c in ("n", "s")}
    return cells.agg(*both.values(), *one.values()).first().asDict()


def log_gamma(x):
    """ln Gamma of a column of numbers of 1 or more: Stirling's series at x + 8, taken back by its recurrence."""
    y = x + F.lit(8.0)
    series = (y - 0.5) * F.ln(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    back = F.lit(0.0)
    for k in range(8):
        back = back + F.ln(x + F.lit(float(k)))
    return series - back


def binomial_totals(cells: DataFrame) -> dict:
    choose = log_gamma(F.col("n") + 1) - log_gamma(F.col("succ") + 1) - log_gamma(F.col("n") - F.col("succ") + 1)
    w = F.col("times") * F.col("alike") if "alike" in cells.columns else F.col("times")
    return cells.agg(F.sum(w * choose).alias("choose"), F.sum(w * F.col("succ")).alias("succ"), F.sum(w * F.col("n")).alias("n")).first().asDict()
