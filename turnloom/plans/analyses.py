"""The two result tables: individual smiling by sentiment, and synchrony by sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import signals as S
from turnloom.operators import bootstrap, crossed, effects, models, permutations
from turnloom.scratch import cut

# Measures with their families, and the columns of the two result tables in their order.
SMILE_MEASURES = (
    ("client", "duchenne_smile_freq", "client_smile_freq", "frequency"),
    ("therapist", "duchenne_smile_freq", "therapist_smile_freq", "frequency"),
    ("client", "duchenne_smile_intensity", "client_smile_intensity", "intensity"),
    ("therapist", "duchenne_smile_intensity", "therapist_smile_intensity", "intensity"),
)
SMILE_RESULT = (
    "person", "measure", "fdr_family", "n_turns", "n_patients", "n_therapists", "grand_mean_raw",
    "mean_positive", "mean_neutral", "mean_negative", "n_turns_positive", "n_turns_neutral", "n_turns_negative",
    "lr_stat", "lr_pval", "coef_positive", "se_positive", "z_positive", "p_positive", "coef_negative", "se_negative", "z_negative", "p_negative",
    "coef_pos_vs_neg", "se_pos_vs_neg", "z_pos_vs_neg", "p_pos_vs_neg", "d_positive", "d_negative", "d_pos_vs_neg",
    "sigma2_patient", "sigma2_resid", "icc", "resid_shapiro_w", "resid_shapiro_p", "resid_skewness", "resid_kurtosis",
    "engine", "method", "perm_p", "perm_n_valid", "q_value_fdr", "q_source",
)
SYNC_RESULT = (
    "measure", "level", "au", "transform",
    "mean_freq_positive", "sd_freq_positive", "mean_freq_neutral", "sd_freq_neutral", "mean_freq_negative", "sd_freq_negative",
    "mean_r_positive", "mean_z_positive", "sd_z_positive", "mean_r_neutral", "mean_z_neutral", "sd_z_neutral", "mean_r_negative", "mean_z_negative", "sd_z_negative",
    "n_positive", "n_neutral", "n_negative", "n_obs", "n_participants", "n_interviewers",
    "estimate", "se", "z", "p_wald", "lrt_stat", "p_lrt", "lrt_source", "odds_ratio", "cohens_d", "cohens_q",
    "sigma2_interviewer", "sigma2_participant", "slope_var_participant", "slope_lrt_stat", "slope_p_lrt", "slope_source",
    "wcb_beta", "wcb_p", "wcb_ci_lo", "wcb_ci_hi", "wcb_n_clusters", "wcb_exact", "converged", "engine", "method",
)
_TEXT = {"person", "measure", "fdr_family", "method", "engine", "q_source", "level", "au", "transform", "lrt_source", "slope_source"}
_FLAG = {"converged", "wcb_exact"}


def _table(spark, rows: list[dict], names: tuple[str, ...]) -> DataFrame:
    def kind(name: str) -> str:
        if name in _TEXT:
            return "string"
        return "boolean" if name in _FLAG else "bigint" if name.startswith("n_") or name in ("wcb_n_clusters", "perm_n_valid") else "double"

    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} {kind(n)}" for n in names))


def smile_descriptives(turns: DataFrame) -> DataFrame:
    """A row for each measure: counts, means by sentiment and the three d, in one aggregation over the turns."""
    value = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, (_, _, c, _) in enumerate(SMILE_MEASURES)])
    long = turns.where(F.col("sentiment").isin(*effects.SENTIMENTS)).select("patient_id", "therapist_id", "sentiment", F.explode(value).alias("m"))
    long = long.select("patient_id", "therapist_id", "sentiment", "m.i", S.finite(F.col("m.v")).alias("v")).where("v is not null")
    of = lambda f, s: f(F.when(F.col("sentiment") == s, F.col("v")))
    sums = long.groupBy("i").agg(
        F.count("*").alias("n_turns"), F.countDistinct("patient_id").alias("n_patients"), F.countDistinct("therapist_id").alias("n_therapists"), F.avg("v").alias("grand_mean_raw"),
        *[of(f, s).alias(f"{n}_{s}") for s in effects.SENTIMENTS for n, f in (("mean", F.avg), ("n_turns", F.count), ("sd", F.stddev_samp))],
    )
    d = lambda a, b: S.pooled_d(*[F.col(f"{n}_{s}") for s in (a, b) for n in ("n_turns", "mean", "sd")])
    pairs = (("positive", "positive", "neutral"), ("negative", "negative", "neutral"), ("pos_vs_neg", "positive", "negative"))
    sums = sums.withColumns({f"d_{name}": d(a, b) for name, a, b in pairs})
    names = F.element_at(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("person", "measure", "fdr_family"), (p, m, f), strict=True)]) for p, m, _, f in SMILE_MEASURES]), F.col("i") + 1)
    return sums.withColumn("name", names).select("i", "name.*", *SMILE_RESULT[3:13], *[f"d_{p[0]}" for p in pairs])


def smile_by_sentiment(turns: DataFrame, perms: int = 0, seed: int = 42) -> DataFrame:
    """Four rows: person, measure, fdr_family, counts, means, fit, effect sizes, permutation p and q within the family.

    turns: patient_id, therapist_id, turn_index, sentiment and the four means. perms 0: q comes from the likelihood
    ratio's p. The turns are written to the scratch folder once, as every measure reads them several times.
    """
    spark, rows, turns = turns.sparkSession, [], cut(turns)
    told = {r["i"]: r.asDict() for r in smile_descriptives(turns).collect()}
    for i, (person, measure, column, family) in enumerate(SMILE_MEASURES):
        kept = turns.where(F.col(column).isNotNull() & F.col("sentiment").isin(*effects.SENTIMENTS))
        row = {"n_turns": 0, "n_patients": 0, "n_therapists": 0} | told.get(i, {}) | models.sentiment_model(kept, column, "patient_id")
        row |= {"person": person, "measure": measure, "fdr_family": family, "engine": "spark_cells_lmm", "perm_p": None, "perm_n_valid": 0}
        if row["method"] != "not_fittable":
            row |= models.residual_normality(kept, column, "patient_id")
        if perms and row["lr_stat"] is not None:
            row |= permutations.permutation_test(kept, column, "patient_id", perms, seed + 100_000 + i, observed=row["lr_stat"]).first().asDict()
        rows.append(row)
    table = _table(spark, rows, SMILE_RESULT[:-2])
    picked = table.select("*", *effects.pick_p(F.col("perm_p"), F.col("lr_pval")))
    return effects.bh_fdr(picked, "p", "fdr_family", "q_value_fdr").select(*SMILE_RESULT)


def _shares(sync: DataFrame) -> DataFrame:
    kept = sync.where(F.col("simul_smile_freq").isNotNull() & (F.col("simul_smile_n_frames") > 0))
    return kept.withColumn("any_smile", (F.col("simul_smile_frames") > 0).cast("double"))


def _peaks(sync: DataFrame) -> DataFrame:
    return sync.where(F.col("cc_r_peak").isNotNull()).withColumn("peak_z", S.fisher_z(F.abs("cc_r_peak")))


def synchrony_descriptives(sync: DataFrame) -> DataFrame:
    """A row for each measure: means, deviations and counts by sentiment, and d (shares) or q (correlations)."""

    def of(f, s: str, c: str):
        return f(F.when(F.col("sentiment") == s, F.col(c)))

    def sums(rows: DataFrame, column: str, mean: str, sd: str) -> DataFrame:
        rows = rows.withColumn("_v", S.finite(F.col(column)))
        return rows.agg(*[of(f, s, "_v").alias(f"{n}_{s}") for s in effects.SENTIMENTS for n, f in ((mean, F.avg), (sd, F.stddev_samp), ("n", F.count))])

    shares, out = _shares(sync), None
    for column, name, transform in (("simul_smile_freq", "simul_smile", "identity"), ("any_smile", "simul_smile_any", "binary")):
        one = sums(shares, column, "mean_freq", "sd_freq")
        d = S.pooled_d(*[F.col(f"{n}_{s}") for s in ("positive", "negative") for n in ("n", "mean_freq", "sd_freq")])
        one = one.select(F.lit(name).alias("measure"), F.lit(transform).alias("transform"), "*", d.alias("cohens_d"))
        out = one if out is None else out.unionByName(one)
    peak = sums(_peaks(sync), "peak_z", "mean_z", "sd_z").withColumns({f"mean_r_{s}": F.tanh(f"mean_z_{s}") for s in effects.SENTIMENTS})
    peak = peak.select(F.lit("duchenne_smile").alias("measure"), F.lit("fisherz").alias("transform"), "*", (F.col("mean_z_positive") - F.col("mean_z_negative")).alias("cohens_q"))
    out = out.unionByName(peak, allowMissingColumns=True)
    return out.select(*[c for c in SYNC_RESULT if c in out.columns])


def synchrony_by_sentiment(sync: DataFrame) -> DataFrame:
    """Three rows: share of joint smiling, whether there was any, and cross-lagged correlation (Fisher z of |r|).

    Each measure filters for itself: a turn may have one without the other; a measure that no turn has gives no row. The
    turns are written to the scratch folder once, as the models and the bootstrap read them several times.
    """
    spark, sync, rows = sync.sparkSession, cut(sync), []
    told = {r["measure"]: r.asDict() for r in synchrony_descriptives(sync).collect()}
    shares, peaks = _shares(sync), _peaks(sync)
    for measure, transform, kept, column in (("simul_smile", "identity", shares, "simul_smile_freq"), ("simul_smile_any", "binary", shares, "any_smile"), ("duchenne_smile", "fisherz", peaks, "peak_z")):
        row = told[measure] | {"level": "synchrony", "au": measure}
        if not sum(row[f"n_{s}"] for s in effects.SENTIMENTS):
            continue
        focal = kept.where(F.col("sentiment").isin(*effects.FOCAL)).withColumn("D", (F.col("sentiment") == "positive").cast("int"))
        if transform == "fisherz":
            row |= crossed.focal_model(focal, column)
        else:
            row |= crossed.focal_binomial(focal, "simul_smile_frames", "simul_smile_n_frames", per_row=transform == "identity") | crossed.focal_slope(focal, column)
        boot = bootstrap.wild_cluster_bootstrap(focal, column, "D", "interviewer_id").first()
        rows.append(row | (boot.asDict() if boot else {"wcb_n_clusters": 0, "wcb_exact": False}))
    return _table(spark, rows, SYNC_RESULT)
