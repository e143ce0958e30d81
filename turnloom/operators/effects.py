"""Descriptives, effect sizes, false discovery rate and shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import signals as S

SENTIMENTS = ("positive", "neutral", "negative")
FOCAL = ("negative", "positive")


def by_sentiment(rows: DataFrame, value: Column, names: Sequence[str] = ("mean", "sd", "n")) -> DataFrame:
    """(sentiment, mean, sd, n) of finite values for each of the three labels; sd of one value is null."""
    kept = rows.where(F.col("sentiment").isin(*SENTIMENTS)).select("sentiment", S.finite(value).alias("v")).where("v is not null")
    return kept.groupBy("sentiment").agg(F.avg("v").alias(names[0]), F.stddev_samp("v").alias(names[1]), F.count("v").alias(names[2]))


def fisher_descriptives(rows: DataFrame, r: str) -> DataFrame:
    """by_sentiment on Fisher's z of |r|, with the r that the mean z stands for."""
    return by_sentiment(rows, S.fisher_z(F.abs(r)), ("mean_z", "sd_z", "n")).withColumn("mean_r", F.tanh("mean_z"))


def cohens_d(rows: DataFrame, value: str, first: str, second: str) -> DataFrame:
    """(n1, n2, d) of two labels, pooled."""
    v = S.finite(F.col(value))
    part = lambda f, s: f(F.when(F.col("sentiment") == s, v))
    m = rows.agg(*[part(f, s).alias(f"{n}{k}") for k, s in ((1, first), (2, second)) for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp))])
    return m.select("n1", "n2", S.pooled_d(*[F.col(c) for c in ("n1", "m1", "s1", "n2", "m2", "s2")]).alias("d"))


def bh_fdr(tests: DataFrame, p: str = "p", family: str = "family", name: str = "q") -> DataFrame:
    """tests with the Benjamini-Hochberg q within each family; missing p has no q and does not count."""
    known = F.when(~F.isnan(p), F.col(p))
    each = Window.partitionBy(family)
    rank = F.count("known_p").over(each.orderBy(F.col("known_p").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, 0))
    out = tests.withColumn("known_p", known).withColumn("m", F.count("known_p").over(each)).withColumn("rank", rank)
    raw = F.least(F.lit(1.0), F.col("known_p") * F.col("m") / F.col("rank"))
    falling = each.orderBy(F.col("known_p").desc_nulls_last()).rangeBetween(Window.unboundedPreceding, 0)
    return out.withColumn("raw_q", raw).withColumn(name, F.when(F.col("known_p").isNotNull(), F.min("raw_q").over(falling))).drop("known_p", "m", "rank", "raw_q")


def shuffled(rows: DataFrame, patient: str, label: str, order: Sequence[str], perms: int, seed: int = 42, first: int = 0) -> DataFrame:
    """rows x perms with the label of another row of the same patient: (perm, patient, rank, shuffled, rest of rows).

    The label at rank r of a keyed hash order goes to natural rank r. order makes the natural order total.
    """
    natural = rows.withColumn("rank", F.row_number().over(Window.partitionBy(patient).orderBy(*order)))
    each = natural.withColumn("perm", F.explode(F.sequence(F.lit(first), F.lit(first + perms - 1))))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("perm").cast("string"), F.col(patient).cast("string"), F.col("rank").cast("string")))
    at = F.row_number().over(Window.partitionBy("perm", patient).orderBy(key))
    dealt = each.select("perm", patient, at.alias("rank"), F.col(label).alias("shuffled"))
    return each.join(dealt, ["perm", patient, "rank"])


def fittable(rows: DataFrame, least: int = 10) -> DataFrame:
    """(n_obs, n_sentiments, n_interviewers, n_participants, fittable)."""
    d = rows.agg(
        F.count("*").alias("n_obs"), F.countDistinct("sentiment").alias("n_sentiments"), F.countDistinct("interviewer_id").alias("n_interviewers"),
        F.countDistinct("participant_id").alias("n_participants"),
    )
    enough = (F.col("n_sentiments") >= 2) & (F.col("n_interviewers") >= 2) & (F.col("n_participants") >= 2) & (F.col("n_obs") >= least)
    return d.withColumn("fittable", enough)


def coverage(sync: DataFrame) -> DataFrame:
    """(n_turns, n_cc, n_ss, share_cc, share_ss): turns with each measure defined."""
    d = sync.agg(F.count("*").alias("n_turns"), F.count("cc_r_peak").alias("n_cc"), F.count_if(F.col("simul_smile_n_frames") > 0).alias("n_ss"))
    return d.select("*", (F.col("n_cc") / F.col("n_turns")).alias("share_cc"), (F.col("n_ss") / F.col("n_turns")).alias("share_ss"))


def pick_p(perm_p: Column, lr_p: Column) -> list[Column]:
    """The permutation p where there is one, else that of the likelihood ratio, and which it is."""
    have = perm_p.isNotNull() & ~F.isnan(perm_p)
    return [F.when(have, perm_p).otherwise(lr_p).alias("p"), F.when(have, "perm").otherwise("lr").alias("q_source")]
