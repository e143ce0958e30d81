"""The analyses from files to files: catalog, labelled turns and frame tables in, turn tables and result tables out."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import signals as S
from turnloom.operators import dyad, jobs
from turnloom.plans import analyses, stages
from turnloom.scratch import cut
from turnloom.sources import documents, readers, sinks


#: Columns of turns beside what an analysis computes: an interview is known by its place in the catalog.
TURN = ("dyad", "patient", "interviewer", "turn_index", "sentiment", "start_s", "end_s")


@dataclass
class Loaded:
    """turns (TURN) and frames (dyad, side, ts, intensity, presence) of the interviews that loaded; jobs (job, patient_id, therapist_id, ok,
    reason) of all that have a transcript and a labelled file; catalog: how many interviews and labelled files were met or not, by status."""

    turns: DataFrame
    frames: DataFrame
    jobs: DataFrame
    catalog: DataFrame

    def report(self, out: str) -> None:
        """jobs, the histogram of reasons and the counts of the catalog, below out."""
        sinks.write_csv(self.jobs, f"{out}/jobs", self.jobs.columns)
        sinks.write_csv(jobs.failure_histogram(self.jobs), f"{out}/failures", ["reason", "n"])
        sinks.write_csv(self.catalog, f"{out}/catalog_counts", self.catalog.columns)


def _existing(spark: SparkSession, candidates: DataFrame) -> DataFrame:
    """path of the files in the folders that candidates (path) name, listed by the driver as Spark does before a scan."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders = [r[0] for r in candidates.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1)).where("path like '%/%'").distinct().collect()]
    found = []
    for folder in filter(None, folders):
        place = jvm.org.apache.hadoop.fs.Path(folder)
        store = place.getFileSystem(conf)
        if store.exists(place):
            found += [(x.getPath().toString(),) for x in store.listStatus(place)]
    return spark.createDataFrame(found, "path string").select(documents.plain(F.col("path")).alias("path"))  # Spark's readers list no empty file


def load(
    spark: SparkSession, data_model: str, labelled_dir: str, root: str, *, threshold: float = 0.5, suffix: str = "_sentiment", label_key: str = "sentiment_label",
) -> Loaded:
    """Every interview by itself, also those of one patient: what can't be read ends that interview, with a reason, and no other."""
    catalog = readers.read_catalog_file(spark, data_model)
    index = jobs.labelled_index(readers.labelled_files(spark, labelled_dir, suffix))
    counts = jobs.status_counts(catalog, index).unionByName(jobs.orphaned(index, catalog).agg(F.lit("orphaned").alias("status"), F.count("*").alias("n")))
    found = jobs.build_jobs(catalog, index).select(
        F.col("interview").cast("string").alias("job"), "patient_id", "therapist_id", documents.plain(F.col("path")).alias("labelled_path"), "patient_openface", "therapist_openface"
    )
    asked = found.select(F.explode(F.array("patient_openface", "therapist_openface")).alias("raw")).where("raw is not null")
    native = readers.native_path(F.col("raw"))
    candidates = asked.select(F.explode(F.array(F.col("raw"), native, F.concat(F.lit(root.rstrip("/") + "/"), native))).alias("path")).distinct()
    there = cut(_existing(spark, candidates))
    for who in ("patient", "therapist"):
        found = readers.first_existing(found, f"{who}_openface", there, root, f"{who}_path")
    found = cut(found.select("job", "patient_id", "therapist_id", "labelled_path", *[documents.plain(F.col(f"{w}_path")).alias(f"{w}_path") for w in ("patient", "therapist")]))

    sides = found.select("job", F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"{who}_path").alias("file")) for k, who in ((0, "patient"), (1, "therapist"))])).alias("s")).select("job", "s.*")
    sides = sides.where("file is not null")
    paths = [r[0] for r in sides.select("file").distinct().collect()]  # as many as Spark's own list of the files it reads
    if paths:
        scanned = cut(readers.scan_frames(spark, paths, threshold))
    else:
        scanned = spark.createDataFrame([], "file string, ts double, au06_r double, au12_r double, au06_c double, au12_c double, kind string, message string")
    errors = scanned.where("kind is not null").groupBy("file").agg(F.min(F.struct("kind", "message")).alias("e")).select("file", "e.*")
    seen = scanned.select("file").distinct().withColumn("seen", F.lit(True))
    bad = sides.join(errors, "file").select("job", "kind", "message")
    bad = bad.unionByName(sides.join(seen, "file", "left_anti").select("job", F.lit("EmptyDataError").alias("kind"), F.lit("no lines").alias("message")))
    frames = scanned.where("kind is null and ts is not null").join(sides, "file").select(
        F.col("job").alias("dyad"), "side", "ts", S.smile_intensity(F.col("au06_r"), F.col("au12_r")).alias("intensity"), S.smile_presence(F.col("au06_c"), F.col("au12_c")).alias("presence"),
    )
    met = readers.scan_labelled(spark, labelled_dir, f"translate_*{suffix}.json", label_key).withColumnRenamed("file", "labelled_path").join(found, "labelled_path")
    met = cut(met.select("job", F.col("patient_id").alias("patient"), F.col("therapist_id").alias("interviewer"), "turn_index", "sentiment", "start_s", "end_s", "kind", "message"))
    bad = bad.unionByName(met.where("kind is not null").select("job", "kind", "message").distinct())
    turns = met.where("kind is null").withColumnRenamed("job", "dyad").select(*TURN)

    n_frames = frames.groupBy(F.col("dyad").alias("job")).agg(*[F.count_if(F.col("side") == k).alias(f"{w}_frames") for k, w in ((0, "patient"), (1, "therapist"))])
    status = jobs.load_status(found, n_frames, turns.groupBy(F.col("dyad").alias("job")).agg(F.count("*").alias("turns")), bad)
    status = cut(status.join(found.select("job", "patient_id", "therapist_id"), "job").select("job", "patient_id", "therapist_id", "ok", "reason"))
    ready = status.where("ok").select(F.col("job").alias("dyad"))
    return Loaded(turns.join(ready, "dyad", "left_semi"), cut(frames.join(ready, "dyad", "left_semi")), status, cut(counts))


def smile(spark: SparkSession, data_model: str, labelled_dir: str, root: str, out: str, *, min_frames: int = dyad.MIN_FRAMES, least: int = 0, perms: int = 0, seed: int = 42, **options) -> DataFrame:
    """Turn table and result table of individual smiling, written below out; returns the result."""
    got = load(spark, data_model, labelled_dir, root, **options)
    got.report(out)
    rows = dyad.turn_means(got.turns, got.frames, min_frames).withColumnsRenamed({"patient": "patient_id", "interviewer": "therapist_id"})
    rows = cut(jobs.inclusion_filter(rows, least))
    sinks.write_csv(rows, f"{out}/turns", sinks.SMILE_TURNS)
    result = analyses.smile_by_sentiment(rows, perms, seed)
    sinks.write_csv(result, f"{out}/smile_by_sentiment", analyses.SMILE_RESULT)
    return result


def synchrony(spark: SparkSession, data_model: str, labelled_dir: str, root: str, out: str, *, min_frames: int = dyad.MIN_FRAMES, least: int = 0, **options) -> DataFrame:
    """Synchrony table, written below out."""
    got = load(spark, data_model, labelled_dir, root, **options)
    got.report(out)
    rows = dyad.synchrony(got.turns, got.frames, min_frames=min_frames)
    who = got.jobs.select(F.col("job").alias("participant_id"), "patient_id")  # models see the patient, also one with several interviews
    rows = rows.join(who, "participant_id").drop("participant_id").withColumnRenamed("patient_id", "participant_id")
    rows = cut(jobs.inclusion_filter(rows, least, "participant_id"))
    sinks.write_csv(rows, f"{out}/synchrony_turns", sinks.SYNC_TURNS)
    return rows


def synchrony_models(spark: SparkSession, sync_turns: str, out: str) -> DataFrame:
    """Result table of synchrony from a synchrony table, written below out."""
    result = analyses.synchrony_by_sentiment(readers.read_synchrony(spark, sync_turns))
    sinks.write_csv(result, f"{out}/synchrony_by_sentiment", analyses.SYNC_RESULT)
    return result


def main(args: Sequence[str] | None = None) -> None:
    """python -m turnloom smile|synchrony|models|transcribe|translate|label ..."""
    parser = argparse.ArgumentParser(prog="turnloom", description=__doc__)
    kinds = parser.add_subparsers(dest="kind", required=True)
    for kind in ("smile", "synchrony"):
        one = kinds.add_parser(kind)
        for name in ("--data-model", "--labelled-dir", "--output-dir"):
            one.add_argument(name, required=True)
        one.add_argument("--root", default=".", help="folder that relative paths of the catalog start from")
        one.add_argument("--labelled-suffix", default="_sentiment")
        one.add_argument("--label-key", default="sentiment_label")
        one.add_argument("--confidence-threshold", type=float, default=0.5)
        one.add_argument("--min-frames-per-turn", type=int, default=dyad.MIN_FRAMES)
        one.add_argument("--min-bucket-turns", type=int, default=0)
        if kind == "smile":
            one.add_argument("--permutations", type=int, default=0)
            one.add_argument("--seed", type=int, default=42)
    models = kinds.add_parser("models")
    models.add_argument("--sync-turns", required=True)
    models.add_argument("--output-dir", required=True)
    stages.add_programs(kinds)
    a = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.kind in ("transcribe", "translate", "label"):
        stages.run_program(spark, a)
        return
    if a.kind == "models":
        synchrony_models(spark, a.sync_turns, a.output_dir)
        return
    more = {"threshold": a.confidence_threshold, "suffix": a.labelled_suffix, "label_key": a.label_key, "min_frames": a.min_frames_per_turn, "least": a.min_bucket_turns}
    if a.kind == "smile":
        more |= {"perms": a.permutations, "seed": a.seed}
    {"smile": smile, "synchrony": synchrony}[a.kind](spark, a.data_model, a.labelled_dir, a.root, a.output_dir, **more)
