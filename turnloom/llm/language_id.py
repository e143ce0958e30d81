"""Language ID by error-correcting output codes over byte n-grams.

Every language has a codeword of +1 and -1. For each bit a binary classifier tells the languages with +1 from
those with -1 by the log odds of hashed byte n-grams; every language counts alike, whatever its share of the
rows. Its margin is put on a log-odds scale by a logistic fit. Decoding compares the margins with every
codeword: a wrong sign costs more the larger the margin, bits weigh by how often they were right for that
language, and the least loss wins. A result is ambiguous if the next codeword's loss is close, and foreign if a text of some
length is far from every codeword, further than any labelled text was.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drawn

UNKNOWN = "und"
#: Labelled rows that a model is fitted on: about this many, twice as many at most.
SAMPLE_ROWS = 20_000
#: Hash buckets for n-grams, and the lengths of n-grams in bytes.
BITS, ORDERS = 15, (3, 4)
#: A document's n-grams are counted as if it had this many, but for documents of fewer: shares of a language are means over
#: documents, not over bytes. All of a text's n-grams are counted, whatever its length.
EVEN_GRAMS = 1000
#: Difference of loss below which a result counts as ambiguous.
AMBIGUOUS = 0.05
#: A text of this many bytes or more is foreign if its least loss is so many times above the largest of labelled texts as long.
FOREIGN_BYTES, FOREIGN_TIMES = 200, 2.0
_KEEP = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_PAD = b"   "


def gram_slots(data: np.ndarray) -> list[np.ndarray]:
    """For each order, the hash bucket of the n-gram at each place of the bytes."""
    wide, out = data.astype(np.uint32), []
    for order in ORDERS:
        code = wide[: len(wide) - order + 1].copy()
        for k in range(1, order):
            code |= wide[k : len(wide) - order + 1 + k] << np.uint32(8 * k)
        code = (code + np.uint32(order)) * np.uint32(2654435761)
        out.append((code >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def _clean(text: str) -> bytes:
    """Lower case, everything but letters as spaces, and a pad so that no n-gram has two texts."""
    return _PAD + text.lower().encode("utf-8", "replace").translate(_KEEP) + _PAD


def _packs(texts: list[str | None], size: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, start of each row) of runs of texts; a run has about `size` bytes or one text."""
    first, parts, total = 0, [], 0
    for i, text in enumerate(texts):
        part = _clean(text or "")
        parts.append(part)
        total += len(part)
        if total >= size or i == len(texts) - 1:
            starts = np.cumsum([0, *map(len, parts[:-1])])
            yield first, np.frombuffer(b"".join(parts), np.uint8), starts
            first, parts, total = i + 1, [], 0


def codewords(k: int) -> np.ndarray:
    """k x bits of +1 and -1: all splits of up to 7 languages in two, else the widest of 200 random codes."""
    if k <= 7:
        rows = [(1, *x) for x in product((1, -1), repeat=k - 1)]
        return np.array([r for r in rows if -1 in r], np.int8).reshape(-1, k).T
    rng, best, least = np.random.default_rng(7), None, -1
    bits = int(np.ceil(10 * np.log2(k)))
    for _ in range(200):
        code = rng.choice(np.array([1, -1], np.int8), size=(k, bits))
        gram = code.astype(np.int32) @ code.T.astype(np.int32)
        apart = int((bits - np.abs(gram[~np.eye(k, dtype=bool)])).min()) if (np.abs(code.sum(0)) < k).all() else -1
        if best is None or apart > least:
            best, least = code, apart
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    slope: np.ndarray
    offset: np.ndarray
    trust: np.ndarray
    #: Largest least loss of the labelled texts of FOREIGN_BYTES or more.
    worst: float = np.inf

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """rows x bits: the mean log odds of a text's n-grams."""
        out = np.zeros((len(texts), self.code.shape[1]))
        for first, data, starts in _packs(texts):
            total, n = np.zeros((len(starts), self.code.shape[1])), 0
            for slots in gram_slots(data):
                total += np.add.reduceat(self.weights[slots], starts, axis=0, dtype=np.float64)
            ends = np.append(starts[1:], len(data))
            n = np.maximum(len(ORDERS) * (ends - starts - 2 * len(_PAD)), 1)
            out[first : first + len(starts)] = total / n[:, None]
        return out

    def losses(self, raw: np.ndarray) -> np.ndarray:
        """rows x languages: weighted logistic loss of the margins against each codeword."""
        margins = np.clip(raw * self.slope + self.offset, -30, 30)
        return np.stack([(np.logaddexp(0, -margins * c) * t).sum(1) for c, t in zip(self.code, self.trust, strict=True)], axis=1)

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """lang (und: null, or no letter), score from 0 to 1, ambiguous, foreign."""
        n = len(texts)
        if not self.langs or not n:
            return pd.DataFrame({"lang": [UNKNOWN] * n, "score": np.zeros(n), "ambiguous": np.zeros(n, bool), "foreign": np.zeros(n, bool)})
        loss = self.losses(self.raw(texts))
        best = loss.argmin(1)
        ranked = np.sort(loss, axis=1)
        ambiguous = (ranked[:, 1] - ranked[:, 0] < AMBIGUOUS) if len(self.langs) > 1 else np.zeros(n, bool)
        bits = max(self.code.shape[1], 1)
        score = 1 / np.exp((ranked[:, :1] - ranked) * bits).sum(1)
        speaks = np.array([x is not None and any(map(str.isalpha, x)) for x in texts])
        lang = np.where(speaks, np.array(self.langs, object)[best], UNKNOWN)
        long = np.array([x is not None and len(x.encode("utf-8", "replace")) >= FOREIGN_BYTES for x in texts])
        foreign = speaks & long & (ranked[:, 0] > FOREIGN_TIMES * self.worst)
        return pd.DataFrame({"lang": lang, "score": np.where(speaks, score, 0.0), "ambiguous": ambiguous & speaks, "foreign": foreign})


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted one-variable logistic fit with a little ridge, by Newton's method."""
    scale = max(float(np.abs(x).mean()), 1e-12)
    design, beta = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (y - p)) - 1e-3 * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta[0] / scale, beta[1]


def fit(rows: DataFrame, *, text_col: str = "text", lang_col: str = "lang", key: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the rows with a text and a language; about sample_rows of them, drawn by the hash of `key`.

    The driver gets one row for each language and bucket, and one for each row of the sample.
    Without labelled rows the model says und to everything.
    """
    labelled = rows.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    count = labelled.count()
    if not count:
        return Model([], np.zeros((0, 0), np.int8), np.zeros((1 << BITS, 0), np.float32), np.zeros(0), np.zeros(0), np.zeros((0, 0)))
    key = F.col(text_col) if key is None else key
    named = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), key.cast("string").alias("key"))
    picked = drawn(named, F.col("key"), sample_rows, count).select("text", "lang")

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].tolist()
            for first, data, starts in _packs(batch["text"].tolist()):
                ends = np.append(starts[1:], len(data))
                for slots in gram_slots(data):
                    for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
                        got = np.bincount(slots[a:b], minlength=1 << BITS)
                        sums.setdefault(langs[first + i], np.zeros(1 << BITS))
                        sums[langs[first + i]] += got * min(1.0, EVEN_GRAMS / max(b - a, 1))
        for lang, got in sums.items():
            slots = np.flatnonzero(got)
            yield pd.DataFrame({"lang": lang, "slot": slots, "n": got[slots]})

    bound_batches()
    tallied = picked.mapInPandas(tally, "lang string, slot int, n double").groupBy("lang", "slot").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in tallied})
    counts = np.zeros((len(langs), 1 << BITS))
    place = {x: i for i, x in enumerate(langs)}
    for r in tallied:
        counts[place[r["lang"]], r["slot"]] = round(r["n"], 6)
    if len(langs) < 2:
        return Model(langs, np.ones((len(langs), 0), np.int8), np.zeros((1 << BITS, 0), np.float32), np.zeros(0), np.zeros(0), np.ones((len(langs), 0)))
    smooth = counts + 0.05 * counts.sum(1, keepdims=True) / counts.shape[1] + 1e-9
    shares = smooth / smooth.sum(1, keepdims=True)
    code = codewords(len(langs))
    sides = [(shares[c > 0].mean(0), shares[c < 0].mean(0)) for c in code.T]
    weights = np.stack([np.log(a) - np.log(b) for a, b in sides], 1).astype(np.float32)
    bits = code.shape[1]
    model = Model(langs, code, weights, np.ones(bits), np.zeros(bits), np.ones(code.shape) / bits)

    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            yield pd.DataFrame({"lang": batch["lang"], "raw": list(model.raw(texts)), "long": [len(x.encode("utf-8", "replace")) >= FOREIGN_BYTES for x in texts]})

    seen = picked.mapInPandas(margins, "lang string, raw array<double>, long boolean").collect()
    raw = np.array([r["raw"] for r in seen])
    lang = np.array([place[r["lang"]] for r in seen])
    order = np.lexsort((*raw.T, lang))  # rows come in any order; sums must not depend on it
    raw, lang, long = raw[order], lang[order], np.array([r["long"] for r in seen])[order]
    weight = 1 / np.bincount(lang, minlength=len(langs))[lang]
    for b in range(bits):
        model.slope[b], model.offset[b] = _logistic(raw[:, b], (code[lang, b] > 0).astype(float), weight * len(raw) / len(langs))
    right = (raw * model.slope + model.offset) * code[lang] > 0
    trust = np.stack([right[lang == i].mean(0) if (lang == i).any() else np.ones(bits) for i in range(len(langs))])
    model.trust = trust / np.maximum(trust.sum(1, keepdims=True), 1e-9)
    if long.any():
        model.worst = float(model.losses(raw[long]).min(1).max())
    return model


def predict(text: Column, model: Model) -> Column:
    """struct<lang string, score double, ambiguous boolean, foreign boolean> of whole texts; only the text is looked at.

    A null text, or one without a letter, is und with score 0. Very long texts are read whole, in runs of half a megabyte;
    equal texts get equal results. A model without languages says und to everything.
    """

    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield model.predict(batch.tolist())

    bound_batches()
    return F.pandas_udf(batches, "lang string, score double, ambiguous boolean, foreign boolean")(text)
