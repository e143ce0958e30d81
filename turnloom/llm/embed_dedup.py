"""Embedding near-duplicates by spherical-cap filters.

Filter directions are all pairs of one codeword for each half of the dimensions: a structured random product code. A
vector passes every filter whose direction it exceeds the threshold with; list decoding walks the sorted scores
of the second half only as far as the first half's score lets them reach. Vectors far from most directions pass few
filters or none; they get their best ones up to a least number. Vectors with the same label that pass a
common filter meet there and are verified with the exact cosine.

A pair that meets under several filters counts only at the smallest they share, so links are counted without
listing pairs; for components each group is tied to its smallest id. Copies of one vector are a single node with a number. Large
filters are split in blocks that meet pairwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import bound_batches, cut
from .components import components

THRESHOLD = 0.98
#: Codewords of each half; filters are all their pairs.
CODEWORDS = 128
#: Filters that a random vector passes, on average; two vectors at the threshold share about two thirds of them.
PASSED = 26.0
#: Filters that every vector is given at least: its best ones, where the threshold leaves fewer.
FEWEST = 26
#: Rows of one block of a filter, and rows of one group that holds small filters, on average.
BLOCK = 2048
BIN_ROWS = 30_000
SEED = 5


class ProductCode:
    """Random unit codewords for each half of the dimensions, and the score from which a filter is passed."""

    def __init__(self, dims: int, codewords: int = CODEWORDS, passed: float = PASSED, fewest: int = 1):
        rng, half = np.random.default_rng((SEED, dims)), max(1, dims // 2)
        self.half, self.words = half, []
        for width in (half, max(dims - half, 0)):
            c = rng.standard_normal((codewords, width))
            self.words.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12) / np.sqrt(2))
        probe = rng.standard_normal((400, dims))
        scores = self._scores(probe / np.linalg.norm(probe, axis=1, keepdims=True))
        every = (scores[0][:, :, None] + scores[1][:, None, :]).ravel()
        self.least = float(np.quantile(every, 1 - min(passed / codewords**2, 1.0)))
        self.fewest = min(fewest, codewords**2)
        #: Ranks in each half that the best `fewest` sums can have.
        ranks = range(min(self.fewest, codewords))
        self.ranks = np.array([(i, j) for i in ranks for j in ranks if (i + 1) * (j + 1) <= self.fewest], int).reshape(-1, 2).T

    def _scores(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.half] @ self.words[0].T, x[:, self.half :] @ self.words[1].T]

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """For each unit vector, the numbers of all filters it passes, rising; fewer passed than `fewest`: its best ones."""
        first, second = self._scores(x)
        n, out = second.shape[1], []
        order = np.argsort(-second, axis=1, kind="stable")
        ranked = np.take_along_axis(second, order, axis=1)
        for a, b, o in zip(first, ranked, order, strict=True):
            reach = np.searchsorted(-b, a - self.least, side="right")
            if reach.sum() >= self.fewest:
                found = np.concatenate([i * n + o[: reach[i]] for i in np.flatnonzero(reach)])
            else:
                i, j = np.argsort(-a, kind="stable")[self.ranks[0]], self.ranks[1]
                best = np.argsort(-(a[i] + b[j]), kind="stable")[: self.fewest]
                found = i[best] * n + o[j[best]]
            out.append(np.sort(found).astype(np.int32))
        return out


def filters(vector: Column, dims: int, codewords: int = CODEWORDS, passed: float = PASSED, fewest: int = FEWEST) -> Column:
    """array<int> of the filters that each vector passes, or of its best ones."""

    def batches(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        code = ProductCode(dims, codewords, passed, fewest)
        for batch in lists:
            x = vectors.matrix(batch)
            if not len(x):
                yield pd.Series([], dtype=object)
                continue
            x = np.pad(vectors.unit(x), ((0, 0), (0, dims - x.shape[1])))
            yield pd.Series(code.decode(x), dtype=object)

    bound_batches()
    return F.pandas_udf(batches, "array<int>")(vector)


def _close(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of a and b (original vectors) have a cosine of at least threshold, in double precision."""
    near = vectors.unit(a) @ vectors.unit(b).T
    out = near >= threshold
    i, j = np.nonzero(np.abs(near - threshold) < 1e-9)
    if len(i):
        out[i, j] = vectors.cosine(a[i], b[j]) >= threshold
    return out


def _shares_smaller(lists_a: list[np.ndarray], lists_b: list[np.ndarray], filter_no: int) -> np.ndarray:
    """Which pairs of rows pass a common filter below filter_no."""
    below_a = [x[: np.searchsorted(x, filter_no)] for x in lists_a]
    below_b = below_a if lists_b is lists_a else [x[: np.searchsorted(x, filter_no)] for x in lists_b]
    all_a, all_b = (np.concatenate(x) if x else np.empty(0, np.int32) for x in (below_a, below_b))
    both = np.intersect1d(all_a, all_b)
    out = np.zeros((len(lists_a), len(lists_b)), bool)

    def marks(lists: list[np.ndarray], some: np.ndarray) -> np.ndarray:
        m = np.zeros((len(lists), len(some)), np.float32)
        rows = np.repeat(np.arange(len(lists)), list(map(len, lists)))
        flat = np.concatenate(lists)
        at = np.searchsorted(some, flat)
        ok = at < len(some)
        ok[ok] = some[at[ok]] == flat[ok]
        m[rows[ok], at[ok]] = 1
        return m

    for lo in range(0, len(both), 512):
        some = both[lo : lo + 512]
        out |= marks(below_a, some) @ marks(below_b, some).T > 0
    return out


def _groups(close: np.ndarray) -> list[np.ndarray]:
    """Connected sets of two or more rows of a symmetric relation."""
    left, out = np.flatnonzero(close.sum(1) > 1), []
    while len(left):
        seen = np.zeros(len(close), bool)
        front = left[:1]
        while len(front):
            seen[front] = True
            front = np.flatnonzero(close[front].any(0) & ~seen)
        out.append(np.flatnonzero(seen))
        left = left[~seen[left]]
    return out


def _verify(threshold: float):
    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, counts, stars = [], [], []
        keys = pdf[["label", "filter", "lo", "hi"]].to_numpy(np.int64)
        order = np.lexsort(keys.T[::-1])
        keys = keys[order]
        edges = np.concatenate(([0], np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1, [len(keys)]))
        columns = {c: pdf[c].to_numpy()[order] for c in ("node", "copies", "chunk", "v", "passed")}
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo < 2:
                continue
            node, copies, chunk = (columns[c][lo:hi].astype(np.int64) for c in ("node", "copies", "chunk"))
            x, passed = vectors.matrix(columns["v"][lo:hi]), list(columns["passed"][lo:hi])
            close = _close(x, x, threshold)
            np.fill_diagonal(close, True)
            if keys[lo, 2] != keys[lo, 3]:  # two blocks of one filter: pairs inside a block are another group's
                close &= chunk[:, None] != chunk[None, :]
                np.fill_diagonal(close, True)
            if close.sum() == len(close):
                continue
            for group in _groups(close):
                members = np.sort(node[group])
                stars.append(np.stack([np.full(len(members) - 1, members[0]), members[1:]], 1))
            some = np.flatnonzero(close.sum(1) > 1)
            near = close[np.ix_(some, some)]
            np.fill_diagonal(near, False)
            near &= ~_shares_smaller(*[[passed[i] for i in some]] * 2, keys[lo, 1])
            nodes.append(node[some])
            counts.append(near @ copies[some])
        if not nodes:
            return pd.DataFrame({"a": [], "b": [], "n": []}, dtype=np.int64)
        edge = np.concatenate(stars)
        a = np.concatenate([*nodes, edge[:, 0]])
        b = np.concatenate([*nodes, edge[:, 1]])
        n = np.concatenate([*counts, np.zeros(len(edge), np.int64)])
        return pd.DataFrame({"a": a, "b": b, "n": n})

    return verify


def near_duplicates(
    rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD, codewords: int = CODEWORDS, passed: float = PASSED, fewest: int = FEWEST, block: int = BLOCK,
) -> DataFrame:
    """(id, n_links, component) for each row: other rows linked directly, smallest id reachable.

    Rows link when labels are equal and not null and the cosine is at least threshold. Vectors that are null,
    zero or hold a null or non-finite component, and rows without label, link with nothing. Repeated rows are
    vectors of their own and link with each other. Ids are whole numbers; vectors whose rows all have a null id link
    with copies only, and have no component.
    """
    picked = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    ok = vectors.usable(F.col("v")) & F.col("label").isNotNull()
    picked = picked.withColumn("k1", F.when(ok, F.xxhash64("v"))).withColumn("k2", F.when(ok, F.hash("v")))
    good = picked.where("k1 is not null")
    nodes = good.groupBy("label", "k1", "k2").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("v").alias("v"))
    dims = max(vectors.dimension(rows, vector_col), 1)
    nodes = cut(nodes.withColumn("passed", filters(F.col("v"), dims, codewords, passed, fewest)))
    met = nodes.where("node is not null").select("node", "copies", "label", "v", "passed", F.explode("passed").alias("filter"))
    large = cut(met.groupBy("label", "filter").count().where(F.col("count") > block).select("label", "filter", F.ceil(F.col("count") / block).cast("int").alias("n")))
    small, split = met.withColumn("n", F.lit(1)), None
    if large.count():
        split = met.join(large, ["label", "filter"])
        small = met.join(large, ["label", "filter"], "left_anti").withColumn("n", F.lit(1))
        small = small.unionByName(split)
    small = small.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    small = small.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    small = small.withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other"))
    total = int(nodes.agg(F.sum(F.size("passed"))).first()[0] or 0)
    small = small.withColumn("bin", F.pmod(F.xxhash64("label", "filter", "lo", "hi"), F.lit(max(64, -(-total // BIN_ROWS)))))
    found = cut(small.select("bin", "node", "copies", "label", "v", "passed", "filter", "chunk", "lo", "hi").groupBy("bin").applyInPandas(_verify(threshold), "a long, b long, n long"))
    links = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    of = components(found.select("a", "b"))
    told = nodes.join(links, "node", "left").join(of, "node", "left")
    told = cut(told.select(
        F.col("label").alias("l"), F.col("k1").alias("h1"), F.col("k2").alias("h2"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"),
    ))
    back = picked.select("id", "label", "k1", "k2")
    back = back.join(told, (back.label == told.l) & (back.k1 == told.h1) & (back.k2 == told.h2), "left")
    return back.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))
