"""Wild cluster bootstrap of the slope in y ~ 1 + D, from four sums for each cluster.

With signs w of the clusters, a draw's refit moves by sums of w times a cluster's residual scores, and its variance is a quadratic form in that
move whose linear parts are again such sums. So each partition multiplies its clusters by a matrix of signs and adds up; what is shuffled is a row
of sums for each partition and draw, never a row for each cluster and draw.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.workers import reachable

EXACT_UP_TO = 12
#: Clusters whose signs are multiplied at once.
TOGETHER = 256
_SUMS = [f"{kind}{name}" for kind in "ru" for name in ("e0", "e1", "qr", "qt")]


def cluster_sums(rows: DataFrame, y: str, d: str, cluster: str) -> DataFrame:
    """(g, n, d, s, sd): cluster, count, sum of D, of y and of D * y. D is 0 or 1."""
    kept = rows.where(F.col(y).isNotNull() & ~F.isnan(y) & F.col(d).isNotNull() & F.col(cluster).isNotNull())
    return kept.groupBy(F.col(cluster).alias("g")).agg(
        F.count("*").cast("double").alias("n"), F.sum(F.col(d).cast("double")).alias("d"), F.sum(y).cast("double").alias("s"), F.sum(F.col(y) * F.col(d)).cast("double").alias("sd")
    )


def signed_sums(cells: DataFrame, draws: int, seed: int, bits: dict[str, int] | None) -> DataFrame:
    """(draw, sums): for each draw the sums over clusters of w times the columns _SUMS of cells.

    bits: the bit of the draw's number that is a cluster's sign (by its name), for all sign vectors; None: signs from the seed and the name.
    """

    def signs(names: list[str]) -> np.ndarray:
        if bits is not None:
            return 1.0 - 2.0 * (np.arange(draws) >> np.array([[bits[x]] for x in names]) & 1)
        return np.stack([1.0 - 2.0 * np.random.default_rng([seed, zlib.crc32(x.encode()), len(x)]).integers(0, 2, draws) for x in names])

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((draws, len(_SUMS)))
        for frame in frames:
            names, values = frame["g"].tolist(), frame[_SUMS].to_numpy(float)
            for at in range(0, len(names), TOGETHER):
                total += signs(names[at : at + TOGETHER]).T @ values[at : at + TOGETHER]
        out = pd.DataFrame(total, columns=_SUMS)
        out.insert(0, "draw", np.arange(draws))
        yield out

    reachable()
    drawn = cells.select(F.col("g").cast("string").alias("g"), *_SUMS).mapInPandas(add, "draw int, " + ", ".join(f"{c} double" for c in _SUMS))
    return drawn.groupBy("draw").agg(*[F.sum(c).alias(c) for c in _SUMS])


def wild_cluster_bootstrap(rows: DataFrame, y: str, d: str, cluster: str, n_boot: int = 3000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """(wcb_beta, wcb_p, wcb_ci_lo, wcb_ci_hi, wcb_n_clusters, wcb_exact), one row; none where there is no fit.

    Up to 12 clusters: all sign vectors; more: n_boot draws of seeded signs. p comes from refits with the null imposed, the interval from
    unrestricted ones. Fewer than 4 rows, one value of D or one cluster: no row. No variance: nulls.
    """
    spark = rows.sparkSession
    schema = "wcb_beta double, wcb_p double, wcb_ci_lo double, wcb_ci_hi double, wcb_n_clusters long, wcb_exact boolean"
    cells = cluster_sums(rows, y, d, cluster)
    t = cells.agg(F.count("*").alias("g"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("n", "d", "s", "sd")]).first()
    det = t["n"] * t["d"] - t["d"] ** 2
    if t["g"] < 2 or t["n"] < 4 or det <= 0:
        return spark.createDataFrame([], schema)
    b0, b1 = t["d"] * (t["s"] - t["sd"]) / det, (t["n"] * t["sd"] - t["d"] * t["s"]) / det
    c = t["g"] / (t["g"] - 1) * (t["n"] - 1) / (t["n"] - 2)

    def slope(u0, u1):  # the slope's part of a cluster's score
        return (F.lit(t["n"]) * u1 - F.lit(t["d"]) * u0) / F.lit(det)

    told = cells.withColumns({"R": slope(F.col("n"), F.col("d")), "T": slope(F.col("d"), F.col("d"))})
    for kind, f0, f1 in (("r", t["s"] / t["n"], 0.0), ("u", b0, b1)):  # the null imposed, and not
        e0 = F.col("s") - F.lit(f0) * F.col("n") - F.lit(f1) * F.col("d")
        e1 = F.col("sd") - F.lit(f0 + f1) * F.col("d")
        told = told.withColumns({f"{kind}e0": e0, f"{kind}e1": e1, f"{kind}q": slope(e0, e1)})
        told = told.withColumns({f"{kind}qr": F.col(f"{kind}q") * F.col("R"), f"{kind}qt": F.col(f"{kind}q") * F.col("T")})
    fixed = told.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in (("R", "R"), ("T", "T"), ("R", "T"), ("rq", "rq"), ("uq", "uq"))]).first()
    se = float(np.sqrt(c * fixed["uq_uq"]))
    exact = t["g"] <= EXACT_UP_TO
    bits = {str(r["g"]): k for k, r in enumerate(sorted(cells.select("g").collect()))} if exact else None
    sums = signed_sums(told, 2 ** t["g"] if exact else n_boot, seed, bits)
    for kind in "ru":
        m0, m1 = F.col(f"{kind}e0"), F.col(f"{kind}e1")
        move0, move1 = F.lit(t["d"]) * (m0 - m1) / F.lit(det), (F.lit(t["n"]) * m1 - F.lit(t["d"]) * m0) / F.lit(det)
        sums = sums.withColumns({f"{kind}0": move0, f"{kind}1": move1})
        a, b = F.col(f"{kind}0"), F.col(f"{kind}1")
        spread = F.lit(fixed[f"{kind}q_{kind}q"]) + a * a * fixed["R_R"] + b * b * fixed["T_T"] + 2 * a * b * fixed["R_T"] - 2 * a * F.col(f"{kind}qr") - 2 * b * F.col(f"{kind}qt")
        sums = sums.withColumn(f"{kind}v", F.lit(c) * spread)
    none = 1e-12 * c * fixed["uq_uq"]  # a variance that rounding has left of nothing
    hit = (F.col("rv") > none) & (F.abs(F.col("r1") / F.sqrt("rv")) >= F.lit(abs(b1) / se if se > 0 else 0.0) - 1e-12)
    move = F.when(F.col("uv") > none, F.col("u1") / F.sqrt("uv"))
    found = sums.agg(F.count_if(hit).alias("hits"), F.count("*").alias("of"), *[F.percentile(move, q).alias(n) for q, n in ((1 - alpha / 2, "hi"), (alpha / 2, "lo"))])
    ok = F.lit(se > 0)
    return found.select(
        F.lit(b1).alias("wcb_beta"), F.when(ok, F.col("hits") / F.col("of")).alias("wcb_p"),
        F.when(ok, b1 - se * F.col("hi")).alias("wcb_ci_lo"), F.when(ok, b1 - se * F.col("lo")).alias("wcb_ci_hi"),
        F.lit(t["g"]).alias("wcb_n_clusters"), F.lit(exact).alias("wcb_exact"),
    )
