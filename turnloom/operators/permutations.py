"""Shuffles of labels within patients, as sums: no row of a turn is repeated for a shuffle.

With a random intercept for each patient, shuffling labels within patients leaves every patient's number of turns, sum and label counts
as they are. All that moves in the likelihood is the sum of the response over each label. So the tasks that hold the turns draw all shuffles as
index matrices and add up, for each of them, one sum a label; what is shuffled between tasks has (tasks x permutations) rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.operators import models
from turnloom.workers import reachable

LABELS = models.SENTIMENTS
#: Turns of one block of a patient, about; a patient with more lies in several, which share its labels by hypergeometric draws.
BLOCK = 2048
#: Cells of one index matrix.
CELLS = 1 << 20


def _blocks(rows: DataFrame, y: str, group: str, order: Sequence[str]) -> DataFrame:
    """group, block, y of the block's turns in order, counts of the group's labels, sizes of the blocks before and its own."""
    kept = rows.where(F.col(y).isNotNull() & ~F.isnan(y) & F.col("sentiment").isin(*LABELS))
    kept = kept.select(F.col(group).alias("g"), "sentiment", F.col(y).cast("double").alias("y"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    place = [f"o{i}" for i in range(len(order))]
    facts = kept.groupBy("g").agg(F.array(*[F.count_if(F.col("sentiment") == s) for s in LABELS]).alias("counts"), F.count("*").alias("n"))
    facts = facts.withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    met = kept.join(facts, "g").withColumn("block", F.pmod(F.xxhash64(*place, "y"), F.col("blocks")))
    each = met.groupBy("g", "block").agg(F.array_sort(F.collect_list(F.struct(*place, "y"))).alias("ys"), F.first("counts").alias("counts"))
    each = each.select("g", "block", F.col("ys.y").alias("y"), "counts")
    before = each.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("block", F.size("y").alias("n")))).alias("sizes"))
    return each.join(before, "g").select(F.col("g").cast("string").alias("g"), "block", "y", "counts", F.col("sizes.n").alias("sizes"), F.array_position("sizes.block", F.col("block")).alias("place"))


def _label_counts(counts: np.ndarray, sizes: Sequence[int], place: int, perms: int, seed: Sequence[int]) -> np.ndarray:
    """How many of each label fall on block number `place` in every shuffle. Each block of a group draws the same numbers for all blocks."""
    left, rng = np.tile(counts, (perms, 1)), np.random.default_rng(seed)
    for i, size in enumerate(sizes):
        rest, own = left.sum(1), np.zeros_like(left)
        want = np.full(perms, size)
        for k in range(len(counts) - 1):
            rest = rest - left[:, k]
            own[:, k] = rng.hypergeometric(left[:, k], rest, want)
            want = want - own[:, k]
        own[:, -1] = want
        if i == place:
            return own
        left = left - own
    return own


def label_sums(rows: DataFrame, y: str, group: str, perms: int, seed: int = 42, order: Sequence[str] = ("turn_index",)) -> DataFrame:
    """(perm, s0, s1, s2): for every shuffle within groups, the sum of y over the turns that get each of LABELS.

    Draws depend on the seed and the group (and the block), not on how rows are dealt to tasks.
    """

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((perms, len(LABELS)))
        for frame in frames:
            for g, block, ys, counts, sizes, place in frame.itertuples(index=False, name=None):
                key = [seed, zlib.crc32((g or "").encode())]
                own = _label_counts(np.asarray(counts, int), list(sizes), place - 1, perms, key)
                rng, ys = np.random.default_rng([*key, 1 + int(block)]), np.asarray(ys, float)
                ends = np.cumsum(own, 1)
                step = max(1, CELLS // len(ys))
                for at in range(0, perms, step):
                    mixed = ys[np.argsort(rng.random((min(step, perms - at), len(ys))), axis=1)]
                    run = np.concatenate([np.zeros((len(mixed), 1)), np.cumsum(mixed, 1)], 1)
                    upto = np.take_along_axis(run, ends[at : at + step], 1)
                    total[at : at + step] += np.diff(upto, axis=1, prepend=0.0)
        yield pd.DataFrame({"perm": np.arange(perms), **{f"s{k}": total[:, k] for k in range(len(LABELS))}})

    reachable()
    drawn = _blocks(rows, y, group, order).mapInPandas(draw, "perm int, s0 double, s1 double, s2 double")
    return drawn.groupBy("perm").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(len(LABELS))])


class BySize:
    """The random-intercept likelihood from sums over the groups of equal size: as many rows as there are different sizes, however many groups.

    sizes n with m groups each, sums over them of x x', x S and S^2, where x are a group's label counts and S its sum; xx and q: the label
    counts and sum of squares of all rows. The response's sums over labels come with each call, for many shuffles at once.
    """

    def __init__(self, n: np.ndarray, m: np.ndarray, xx: np.ndarray, xs: np.ndarray, ss: np.ndarray, counts: np.ndarray, q: float):
        self.n, self.m, self.xx, self.xs, self.ss, self.counts, self.q, self.N = n, m, xx, xs, ss, counts, q, float(counts.sum())

    def deviance(self, lam: np.ndarray, sums: np.ndarray, to: np.ndarray) -> np.ndarray:
        """At ML for each row of lam and label sums; to: columns of the design from label counts."""
        w = lam[:, None] / (1 + lam[:, None] * self.n)
        a = to.T @ (np.diag(self.counts) - np.tensordot(w, self.xx, 1)) @ to
        c = (sums - w @ self.xs) @ to
        beta = np.linalg.solve(a, c[:, :, None])[:, :, 0]
        rss = np.maximum(self.q - w @ self.ss - (beta * c).sum(1), 1e-300)
        return self.N * np.log(2 * math.pi * rss / self.N) + np.log1p(lam[:, None] * self.n) @ self.m + self.N

    def least(self, sums: np.ndarray, to: np.ndarray) -> np.ndarray:
        """The least deviance over the variance ratio, 0 included: a grid, then golden sections, for all rows together."""
        grid = np.linspace(-14, 8, 45)
        seen = np.stack([self.deviance(np.full(len(sums), math.exp(g)), sums, to) for g in grid], 1)
        at = seen.argmin(1)
        a, b = grid[np.maximum(at - 1, 0)], grid[np.minimum(at + 1, len(grid) - 1)]
        g = (math.sqrt(5) - 1) / 2
        x, y = b - g * (b - a), a + g * (b - a)
        fx, fy = (self.deviance(np.exp(v), sums, to) for v in (x, y))
        while (b - a).max() > 1e-10:
            low = fx < fy
            a, b = np.where(low, a, x), np.where(low, y, b)
            new = np.where(low, b - g * (b - a), a + g * (b - a))
            f = self.deviance(np.exp(new), sums, to)
            x, y, fx, fy = np.where(low, new, y), np.where(low, x, new), np.where(low, f, fy), np.where(low, fx, f)
        best = self.deviance(np.exp((a + b) / 2), sums, to)
        return np.minimum(np.minimum(best, seen.min(1)), self.deviance(np.zeros(len(sums)), sums, to))


def by_size(rows: DataFrame, y: str, group: str) -> BySize:
    """One row for each different number of turns a group has."""
    cells = models.cells_of(rows, y, group)
    label = lambda k: F.coalesce(F.sum(F.when(F.col("sentiment") == LABELS[k], F.col("n"))), F.lit(0)).cast("double")
    one = cells.groupBy(group).agg(F.sum("n").cast("double").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), *[label(k).alias(f"x{k}") for k in range(3)])
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    told = one.groupBy("n").agg(
        F.count("*").alias("m"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s")).alias("ss"), *[F.sum(f"x{k}").alias(f"x{k}") for k in range(3)],
        *[F.sum(F.col(f"x{k}") * F.col("s")).alias(f"xs{k}") for k in range(3)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"xx{i}{j}") for i, j in pairs],
    ).orderBy("n")
    t = models.local(told).astype(float)
    xx = np.zeros((len(t), 3, 3))
    for i, j in pairs:
        xx[:, i, j] = xx[:, j, i] = t[f"xx{i}{j}"]
    col = lambda c: t[c].to_numpy()
    return BySize(col("n"), col("m"), xx, np.stack([col(f"xs{k}") for k in range(3)], 1), col("ss"), np.array([t[f"x{k}"].sum() for k in range(3)]), math.fsum(t["q"]))


def lr_statistics(fit: BySize, sums: np.ndarray) -> np.ndarray:
    """2 x (full - null) log-likelihood at ML for each row of label sums; nan where the labels can't be told apart."""
    have = [k for k in range(3) if fit.counts[k] > 0]
    try:
        full, null = (fit.least(sums, to) for to in (np.eye(3)[:, have], np.ones((3, 1))))
    except np.linalg.LinAlgError:
        return np.full(len(sums), math.nan)
    return np.maximum(null - full, 0.0)


def permutation_test(rows: DataFrame, y: str, group: str, perms: int, seed: int = 42, order: Sequence[str] = ("turn_index",), observed: float | None = None) -> DataFrame:
    """(perm_p, perm_n_valid): (extreme + 1) / (valid + 1) of the likelihood ratio of the labels, shuffled within groups.

    observed: the statistic of the labels as they are; computed if not given. Fewer than 6 values, or no permutation: null and 0.
    The driver gets a row for each permutation and one for each different size of a group.
    """
    spark, schema = rows.sparkSession, "perm_p double, perm_n_valid long"
    fit = by_size(rows, y, group)
    if fit.N < 6 or perms <= 0:
        return spark.createDataFrame([(None, 0)], schema)
    if observed is None:
        real = rows.where(F.col(y).isNotNull() & ~F.isnan(y)).groupBy("sentiment").agg(F.sum(y).alias("s")).collect()
        said = {r["sentiment"]: r["s"] for r in real}
        observed = float(lr_statistics(fit, np.array([[said.get(s, 0.0) for s in LABELS]]))[0])
    sums = models.local(label_sums(rows, y, group, perms, seed, order).orderBy("perm"))[["s0", "s1", "s2"]].to_numpy(float)
    found = lr_statistics(fit, sums)
    valid = int(np.isfinite(found).sum())
    hits = int((found[np.isfinite(found)] >= observed - 1e-9 * max(1.0, abs(observed))).sum())
    return spark.createDataFrame([((hits + 1) / (valid + 1) if valid else None, valid)], schema)
