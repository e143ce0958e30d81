"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees on a bounded labelled sample propose conjunctions of thresholds; a lasso logistic fit keeps few of
them with weights; what it keeps becomes one Spark column expression over the statistics of each text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees
from .common import bound_batches, drawn

#: Labelled rows that a model is fitted on: about this many, twice as many at most.
SAMPLE_ROWS = 20_000
TREES, DEPTH = 24, 3
#: Weight of the lasso's penalty, a share of the smallest that would leave no rule.
PENALTY = 0.005
FEATURES = (
    "log_bytes", "log_words", "mean_word", "upper", "digit", "mark", "odd_mark", "space", "high",
    "distinct_words", "top_word", "same_as_last", "distinct_lines", "words_per_line", "words_per_stop",
    "long_word", "vowels",
)
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGIT = b"0123456789"
_COMMON = b".,;:'-\"()"
_ODD = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _COMMON)
_SPACE = b" \t\n\r\x0b\x0c"
_VOWEL = b"aeiouyAEIOUY"
_HIGH = bytes(range(128, 256))


def statistics(text: str | None) -> tuple[float, ...]:
    """Numbers about one whole text; null counts as empty, and an empty text gives zeros."""
    data = (text or "").encode("utf-8", "replace")
    n = len(data)
    if not n:
        return (0.0,) * len(FEATURES)

    def share(kind: bytes) -> float:
        return (n - len(data.translate(None, kind))) / n

    words = data.split()
    count = max(len(words), 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    kinds = Counter(words)
    odd = share(_ODD)
    stops = data.count(b".") + data.count(b"!") + data.count(b"?")
    return (
        float(np.log1p(n)), float(np.log1p(len(words))), (n - len(lines)) / count, share(_UPPER), share(_DIGIT), odd + share(_COMMON), odd,
        share(_SPACE), share(_HIGH), len(kinds) / count, max(kinds.values(), default=0) / count,
        sum(map(eq, words, words[1:])) / count, len(set(lines)) / max(len(lines), 1), count / max(len(lines), 1), count / (stops + 1),
        float(max(map(len, words), default=0)), share(_VOWEL),
    )


def statistics_column(text: Column) -> Column:
    """array<double> of FEATURES."""

    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([statistics(x) for x in batch], dtype=object)

    bound_batches()
    return F.pandas_udf(batches, "array<double>")(text)


@dataclass
class RuleModel:
    offset: float
    rules: list[tuple]
    weights: list[float]

    def column(self, stats: Column) -> Column:
        """Score from 0 to 1 over an array column of FEATURES."""
        total = F.lit(self.offset)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for feature, above, at in rule:
                value = F.get(stats, F.lit(feature))
                holds = holds & ((value > F.lit(at)) if above else (value <= F.lit(at)))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.offset + _holds(self.rules, x) @ np.array(self.weights, float))))

    def describe(self) -> list[str]:
        def words(rule: tuple) -> str:
            return " and ".join(f"{FEATURES[f]} {'>' if above else '<='} {at:.4g}" for f, above, at in rule)

        return [f"{w:+.3f} if {words(r)}" for r, w in zip(self.rules, self.weights, strict=True)]


def _holds(rules: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for i, rule in enumerate(rules):
        for feature, above, at in rule:
            out[:, i] *= (x[:, feature] > at) == above
    return out


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic lasso on standardised columns by accelerated proximal steps; the offset has no penalty."""
    n, (mean, spread) = len(z), (z.mean(0), np.maximum(z.std(0), 1e-6))
    u = np.concatenate([np.ones((n, 1)), (z - mean) / spread], 1)
    rate = 4 * n / max(np.linalg.norm(u, 2) ** 2, 1e-9)
    p0 = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    beta = np.zeros(u.shape[1])
    beta[0] = np.log(p0 / (1 - p0))
    bound = penalty * np.abs(u[:, 1:].T @ (y - p0)).max(initial=0.0) / n
    ahead, t = beta.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(u @ ahead, -30, 30)))
        new = ahead + rate * (u.T @ (y - p)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * bound, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - beta)
        beta, t = new, t_new
    weights = beta[1:] / spread
    return float(beta[0] - weights @ mean), weights


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """From statistics and 0/1 labels; one class alone, or no rows, gives a constant score."""
    if not len(y) or y.min() == y.max():
        return RuleModel(0.0 if not len(y) else (4.0 if y[0] else -4.0), [], [])
    _, grown = trees.boost(x, y, np.ones(len(y)), TREES, DEPTH)
    found = list(dict.fromkeys(r for t in grown for r in trees.rules(t)))
    offset, weights = _lasso(_holds(found, x), y, PENALTY)
    kept = [(r, float(w)) for r, w in zip(found, weights, strict=True) if abs(w) > 1e-6]
    return RuleModel(offset, [r for r, _ in kept], [w for _, w in kept])


def fit(rows: DataFrame, *, text_col: str = "text", label_col: str = "quality", key: Column | None = None, sample_rows: int | None = SAMPLE_ROWS) -> RuleModel:
    """A model from rows with label 0 or 1, about sample_rows of them, drawn by the hash of `key` (else the text).

    Null texts count as empty, rows with a null label are not used. The driver gets the statistics of the sample.
    sample_rows None: the rows are a sample already.
    """
    picked = rows.where(F.col(label_col).isin(0, 1))
    if sample_rows is not None:
        picked = drawn(picked.select(F.col(text_col).alias("text"), F.col(label_col).alias("y"), (F.coalesce(F.col(text_col), F.lit("")) if key is None else key).alias("k")), F.col("k"), sample_rows, picked.count())
    else:
        picked = picked.select(F.col(text_col).alias("text"), F.col(label_col).alias("y"))
    got = picked.select(F.col("y").cast("int").alias("y"), statistics_column(F.col("text")).alias("x")).collect()
    x = np.array([r["x"] for r in got], float).reshape(-1, len(FEATURES))
    y = np.array([r["y"] for r in got], float)
    order = np.lexsort((*x.T, y))  # rows come in any order; the fit must not depend on it
    return fit_rules(x[order], y[order])


def score(docs: DataFrame, model: RuleModel, *, text_col: str = "text", as_col: str = "score") -> DataFrame:
    """docs with the score of every whole text; null and empty texts get a score as well."""
    return docs.withColumn(as_col, model.column(statistics_column(F.col(text_col))))
