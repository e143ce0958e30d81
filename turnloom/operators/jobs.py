"""Which interviews are analysed: catalog, labelled files, reasons, inclusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTIMENTS = ("positive", "neutral", "negative")


def labelled_index(files: DataFrame) -> DataFrame:
    """(code, path) of the first path of each patient code."""
    return files.where("code is not null").groupBy("code").agg(F.min("path").alias("path"))


def job_status(catalog: DataFrame, index: DataFrame) -> DataFrame:
    """catalog rows with a bindung interview, with path and status: transcript_null, missing_labeled or job."""
    had = catalog.where("has_bindung").withColumn("pid", F.upper(F.trim("patient_id")))
    met = had.join(index.select(F.col("code").alias("pid"), "path"), "pid", "left")
    status = F.when(F.col("transcript").isNull(), "transcript_null").when(F.col("path").isNull(), "missing_labeled").otherwise("job")
    return met.withColumn("status", status)


def build_jobs(catalog: DataFrame, index: DataFrame) -> DataFrame:
    return job_status(catalog, index).where("status = 'job'").drop("status", "pid", "has_bindung")


def status_counts(catalog: DataFrame, index: DataFrame) -> DataFrame:
    return job_status(catalog, index).groupBy("status").agg(F.count("*").alias("n"))


def orphaned(index: DataFrame, catalog: DataFrame) -> DataFrame:
    """Codes of labelled files that no bindung interview has."""
    known = catalog.where("has_bindung").select(F.upper(F.trim("patient_id")).alias("code")).distinct()
    return index.select("code").distinct().join(known, "code", "left_anti")


def strict_match(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files whose code belongs to an interview that names a bindung type, even an empty one."""
    known = catalog.where("names_bindung").select(F.upper(F.trim("patient_id")).alias("code")).where("code <> ''").distinct()
    return files.join(known, "code", "left_semi")


def load_status(jobs: DataFrame, frame_counts: DataFrame, turn_counts: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(job, ok, reason): paths first, then errors (job, kind, message) of reading, then frames of either side, then labelled turns."""
    met = jobs.join(frame_counts, "job", "left").join(turn_counts, "job", "left")
    if errors is not None:
        met = met.join(errors.groupBy("job").agg(F.min(F.concat_ws(":", F.lit("exception"), "kind", "message")).alias("error")), "job", "left")
    none = lambda c: F.coalesce(c, F.lit(0)) == 0
    reason = (
        F.when(F.col("patient_path").isNull() | F.col("therapist_path").isNull() | F.col("labelled_path").isNull(), "missing_paths")
        .when(F.lit(False) if errors is None else F.col("error").isNotNull(), F.lit(None) if errors is None else F.col("error"))
        .when(none("patient_frames") | none("therapist_frames"), "empty_openface")
        .when(none("turns"), "no_labeled_turns")
    )
    return met.select("job", reason.isNull().alias("ok"), reason.alias("reason"))


def failure_histogram(status: DataFrame) -> DataFrame:
    return status.where("not ok").groupBy(F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))


def resume(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs without an output yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def first_files(files: DataFrame, most: int, path_col: str = "path") -> DataFrame:
    """The first files in order of path; 0: all of them."""
    ordered = files.orderBy(path_col)
    return ordered.limit(most) if most else ordered


def eligible(turns: DataFrame, least: int = 0, who: str = "patient_id", labels: Sequence[str] = SENTIMENTS) -> DataFrame:
    """Patients with at least `least` turns of every label; one without any valid label never qualifies."""
    label = F.lower(F.trim("sentiment"))
    counts = turns.where(label.isin(*labels)).groupBy(who).agg(*[F.count_if(label == s).alias(s) for s in labels])
    enough: Column = F.lit(True)
    for s in labels:
        enough = enough & (F.col(s) >= least)
    return counts.where(enough).select(who)


def inclusion_filter(turns: DataFrame, least: int = 0, who: str = "patient_id") -> DataFrame:
    return turns.join(eligible(turns, least, who), who, "left_semi")
