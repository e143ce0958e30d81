"""Small gradient-boosted trees on a bounded sample, fitted on the driver, and their form as Spark columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    """A split (feature <= at goes left) or, without feature, a leaf."""

    value: float
    feature: int | None = None
    at: float = 0.0
    left: Node | None = None
    right: Node | None = None


def _grow(bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int, ridge: float) -> Node:
    g, h = grad.sum(), hess.sum()
    node = Node(float(g / (h + ridge)))
    if depth == 0 or len(grad) < 2 * least:
        return node
    best, base = 1e-6, g * g / (h + ridge)
    for f, cuts in enumerate(edges):
        if not len(cuts):
            continue
        n = len(cuts) + 1
        gs = np.cumsum(np.bincount(bins[:, f], grad, n))[:-1]
        hs = np.cumsum(np.bincount(bins[:, f], hess, n))[:-1]
        ns = np.cumsum(np.bincount(bins[:, f], minlength=n))[:-1]
        gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - base
        gain[(ns < least) | (len(grad) - ns < least)] = 0
        k = int(gain.argmax())
        if gain[k] > best:
            best, node.feature, node.at, split = gain[k], f, float(cuts[k]), k
    if node.feature is not None:
        low = bins[:, node.feature] <= split
        node.left = _grow(bins[low], edges, grad[low], hess[low], depth - 1, least, ridge)
        node.right = _grow(bins[~low], edges, grad[~low], hess[~low], depth - 1, least, ridge)
    return node


def apply(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature is None:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.at, apply(node.left, x), apply(node.right, x))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 20, depth: int = 3, rate: float = 0.3, least: int = 5, ridge: float = 1.0) -> tuple[float, list[Node]]:
    """Offset and trees of a boosted logistic model; the same rows in the same order give the same model."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 65)[1:-1], method="lower")) for c in x.T]
    edges = [e[e < c.max()] for e, c in zip(edges, x.T, strict=True)]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    share = np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    offset = float(np.log(share / (1 - share)))
    score, grown = np.full(len(y), offset), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(bins, edges, weight * (y - p), weight * p * (1 - p), depth, least, ridge)
        _shrink(tree, rate)
        grown.append(tree)
        score = score + apply(tree, x)
    return offset, grown


def _shrink(node: Node, rate: float) -> None:
    node.value *= rate
    if node.feature is not None:
        _shrink(node.left, rate)
        _shrink(node.right, rate)


def as_column(node: Node, features: list[Column]) -> Column:
    """The tree over non-null feature columns, as nested CASE."""
    if node.feature is None:
        return F.lit(node.value)
    return F.when(features[node.feature] <= F.lit(node.at), as_column(node.left, features)).otherwise(as_column(node.right, features))


def rules(node: Node, path: tuple = ()) -> list[tuple]:
    """Conjunctions (feature, above, at), ... of every node below the root."""
    out = [path] if path else []
    if node.feature is not None:
        out += rules(node.left, (*path, (node.feature, False, node.at)))
        out += rules(node.right, (*path, (node.feature, True, node.at)))
    return out
