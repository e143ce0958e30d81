"""The stages that turn recordings into labelled turns, each from files to files, with the models left to the caller."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.operators import inference, jobs, turns
from turnloom.scratch import cut
from turnloom.sources import documents, readers, sinks

ASR_FIELDS = ("text", "start", "end", "speaker_id")
TRANSLATED_FIELDS = ("turn_index", "text", "start_ms", "end_ms", "speaker_id", "original_turn_indices")


def _named(audio: DataFrame) -> DataFrame:
    """audio with uri, the name that its outputs go by."""
    stem = F.regexp_replace(F.regexp_extract("audio", r"[^/]*$", 0), r"\.[^.]*$", "")
    return audio.withColumn("uri", F.regexp_replace(stem, r"(?U)\s+", "_"))


def _stem(file: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(file, r"[^/]*$", 0), r"\.[^.]*$", "")


def _present(spark: SparkSession, out: str, glob: str, begins: str = "") -> DataFrame:
    """uri of the recordings that have a document of this kind already."""
    return documents.listed(spark, out, glob).select(F.regexp_replace(_stem(F.col("path")), f"^{begins}", "").alias("uri")).distinct()


def diarization(spark: SparkSession, audio: DataFrame, out: str, make: Callable[[], Any], *, speakers: int = 2, skip_existing: bool = False) -> None:
    """<uri>/<uri>.rttm of each recording, below out."""
    asked = _named(audio)
    if skip_existing:
        asked = jobs.resume(asked, _present(spark, out, "*.rttm"), "uri")
    sinks.write_rttm(inference.diarize(asked, make, speakers), out, overwrite=not skip_existing)


def recognition(spark: SparkSession, audio: DataFrame, out: str, make: Callable[[], Any], *, both_speakers: bool = False, skip_existing: bool = False) -> None:
    """<uri>/results_<uri>.json of each recording below out: segments that last, on their own clock."""
    segments = readers.read_rttm(spark, out).withColumn("file", F.col("uri"))
    asked = _named(audio)
    if skip_existing:
        asked = jobs.resume(asked, _present(spark, out, "results_*.json", "results_"), "uri")
    roles = turns.speaker_roles(segments).select("file", "speaker", "role")
    kept = turns.segment_filter(segments.join(roles, ["file", "speaker"]), F.coalesce("role", F.lit("other")), both_speakers)
    kept = kept.join(asked.select(F.col("uri").alias("file"), "audio"), "file")
    found = inference.transcribe(kept, make, ["file", "start_ms", "end_ms", "role"])
    item = found.select("file", F.struct("start_ms", "end_ms", "part").alias("idx"), "text", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), F.col("role").alias("speaker_id"))
    sinks.write_json(item, out, ASR_FIELDS, overwrite=not skip_existing, path=F.concat("file", F.lit("/results_"), "file", F.lit(".json")))


def process_media(
    spark: SparkSession, in_dir: str, out: str, stage: str = "full", *, diarizer: Callable[[], Any] | None = None, recogniser: Callable[[], Any] | None = None,
    extractor: Callable[[], Any] | None = None, use_temp_audio: bool = False, speakers: int = 2, both_speakers: bool = False, skip_existing: bool = False,
) -> None:
    """diarization, asr or full (both) of the recordings below a folder, or of the sound already extracted to out/temp_audio
    (Spark lists no folder whose name begins with _)."""
    if stage not in ("diarization", "asr", "full"):
        raise ValueError(f"unknown stage: {stage}")
    media = readers.discover_media(spark, in_dir, temp_audio=f"{out}/temp_audio" if use_temp_audio else None)
    media = media.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    audio = cut(inference.extract_audio(media, extractor or inference.with_ffmpeg(f"{out}/temp_audio")).where(F.col("audio").isNotNull()).select("audio"))
    if stage != "asr":
        diarization(spark, audio, out, diarizer, speakers=speakers, skip_existing=skip_existing)
    if stage != "diarization":
        recognition(spark, audio, out, recogniser, both_speakers=both_speakers, skip_existing=skip_existing)


def translate(spark: SparkSession, in_dir: str, out: str | None, make: inference.Make = inference.identity, *, most: int = 192, overwrite: bool = False, glob: str = "results_*.json") -> None:
    """translate_<id>.json for every result file: its speaker turns, translated chunk by chunk. Sub-folders are mirrored below out (None: the
    input folder itself); files that are there already are neither read nor translated. One that is no list is left out."""
    names = documents.listed(spark, in_dir, glob)
    own = F.concat(F.regexp_extract("path", "^(?:.*/)?", 0), F.lit("translate_"), F.regexp_replace(_stem(F.col("path")), "^results_", ""), F.lit(".json"))
    names = names.select(own.alias("name"), F.col("full").alias("file"))
    if not overwrite:
        names = names.join(documents.listed(spark, out or in_dir).select(F.col("path").alias("name")), "name", "left_anti")
    items = readers.read_asr_turns(spark, in_dir, glob, strict=False).withColumn("file", documents.plain(F.url_decode(F.regexp_replace("file", r"\+", "%2B"))))
    islands = turns.speaker_islands(items.join(names, "file").drop("file").withColumnRenamed("name", "file"))
    done = inference.translate_turns(islands, make, most).withColumn("idx", F.col("turn_index"))
    sinks.write_json(done, out or in_dir, TRANSLATED_FIELDS, overwrite=overwrite, path=F.col("file"))


def label(
    spark: SparkSession, in_dir: str, out: str, make: inference.Make | None, *, labeller: Callable[[DataFrame], DataFrame] | None = None, data_model: str | None = None, strict_patient_match: bool = False, max_files: int = 0,
    turns_before: int = 2, label_key: str = "sentiment_label", overwrite: bool = True,
) -> DataFrame:
    """<stem>_sentiment.json for every translated file of a bindung interview, with a label on the client's turns, and the summary of all
    labelled files in out. Returns (file, status): done, skipped (there already) or failed (no list).

    make: a model of texts; or None and labeller, which gives turns (file, idx, speaker, text) their label_key, as by requests to a server.
    strict_patient_match: only patients that the data model lists for it. max_files: the first ones by name; 0: all.
    """
    found = documents.listed(spark, in_dir, "translate_*.json").select("path", F.col("full").alias("file"))
    found = readers.bindung_files(found).withColumn("code", X.patient_code(F.regexp_extract("path", r"[^/]*$", 0)))
    if strict_patient_match:
        found = jobs.strict_match(found, readers.read_catalog_file(spark, data_model))
    found = jobs.first_files(found, max_files)
    named = found.select("file", F.concat(_stem(F.col("path")), F.lit("_sentiment.json")).alias("name"))
    there = documents.listed(spark, out, "*_sentiment.json").select(F.col("path").alias("name"))
    todo = cut(named if overwrite else named.join(there, "name", "left_anti"))
    items = readers.read_turns(spark, in_dir, "translate_*.json", readers.TRANSLATED_TURN, strict=False).drop("sentiment_label")
    items = items.withColumn("file", documents.plain(F.url_decode(F.regexp_replace("file", r"\+", "%2B")))).join(todo, "file").drop("file").withColumnRenamed("name", "file")
    asked = cut(items.withColumnRenamed("speaker_id", "speaker"))
    done = labeller(asked) if labeller else inference.label_turns(asked, make, turns_before, label_key)
    done = done.withColumnRenamed("speaker", "speaker_id")
    sinks.write_json(done, out, [*TRANSLATED_FIELDS, label_key], overwrite=overwrite, path=F.col("file"))
    summarize(spark, out, label_key)
    ok = asked.select(F.col("file").alias("name")).distinct().withColumn("ok", F.lit(True))
    status = named.join(todo.select("name", F.lit(True).alias("todo")), "name", "left").join(ok, "name", "left")
    return status.select(F.col("name").alias("file"), F.when(F.col("todo").isNull(), "skipped").when(F.col("ok").isNull(), "failed").otherwise("done").alias("status"))


def summarize(spark: SparkSession, folder: str, label_key: str = "sentiment_label") -> None:
    """sentiment_label_summary.txt over all labelled files of a folder, those of earlier runs included."""
    whole = spark.read.option("pathGlobFilter", "*_sentiment.json").text(folder, wholetext=True) if documents.listed(spark, folder, "*_sentiment.json", False).count() else None
    if whole is None:
        labels = spark.createDataFrame([], "file string, label string")
    else:
        items = F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")
        each = whole.select(F.regexp_extract(documents.source_file(), r"[^/]*$", 0).alias("file"), F.explode_outer(items).alias("item"))
        labels = each.select("file", F.try_variant_get("item", f"$['{label_key}']", "string").alias("label"))
    sinks.write_label_report(labels, folder)


def loaded(name: str) -> Callable:
    """module:function, as programs take models."""
    from importlib import import_module

    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


def add_programs(kinds) -> None:
    """transcribe, translate and label for the parser of python -m turnloom."""
    one = kinds.add_parser("transcribe")
    one.add_argument("--input-dir", required=True)
    one.add_argument("--output-dir", required=True)
    one.add_argument("--stage", choices=("diarization", "asr", "full"), default="full")
    one.add_argument("--use-temp-audio", action="store_true")
    one.add_argument("--skip-existing", action="store_true")
    one.add_argument("--both-speakers", action="store_true")
    one.add_argument("--speakers", type=int, default=2)
    for model in ("--diarizer", "--recogniser", "--extractor"):
        one.add_argument(model, help="module:function that makes the model; the sound is taken out by ffmpeg without one")
    one = kinds.add_parser("translate")
    one.add_argument("--input-dir", required=True)
    one.add_argument("--output-dir", help="the input folder if not given")
    one.add_argument("--translator", required=True, help="module:function that makes a function from texts to texts")
    one.add_argument("--max-input-tokens", type=int, default=192)
    one.add_argument("--overwrite", action="store_true")
    one = kinds.add_parser("label")
    for name in ("--input-dir", "--output-dir", "--data-model"):
        one.add_argument(name, required=True)
    one.add_argument("--server-url", default="http://localhost:8080/v1")
    one.add_argument("--model-name", default="local")
    one.add_argument("--answers", help="folder of the answers kept from run to run; below the output folder if not given")
    one.add_argument("--concurrency", type=int, default=8)
    one.add_argument("--context-turns", type=int, default=2)
    one.add_argument("--label-key", default="sentiment_label")
    one.add_argument("--strict-patient-match", action="store_true")
    one.add_argument("--max-files", type=int, default=0)


def run_program(spark: SparkSession, a) -> None:
    if a.kind == "transcribe":
        made = {k: loaded(v) if (v := getattr(a, k)) else None for k in ("diarizer", "recogniser", "extractor")}
        process_media(spark, a.input_dir, a.output_dir, a.stage, use_temp_audio=a.use_temp_audio, speakers=a.speakers, both_speakers=a.both_speakers, skip_existing=a.skip_existing, **made)
    elif a.kind == "translate":
        translate(spark, a.input_dir, a.output_dir, loaded(a.translator), most=a.max_input_tokens, overwrite=a.overwrite)
    else:
        client, store = inference.chat_client(a.server_url, a.model_name), a.answers or f"{a.output_dir.rstrip('/')}/answers"
        ask = lambda t: inference.label_turns_by_requests(t, client, store, max(0, a.context_turns), a.label_key, concurrency=a.concurrency)
        told = label(spark, a.input_dir, a.output_dir, None, labeller=ask, data_model=a.data_model, strict_patient_match=a.strict_patient_match, max_files=a.max_files, label_key=a.label_key)
        for r in told.groupBy("status").count().orderBy("status").collect():
            print(f"{r['status']}: {r['count']}")
