"""Readers of the engine's inputs, always with explicit schemas."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.functions import text as X
from turnloom.sources import documents
from turnloom.sources.columns import SYNC_TURNS

ASR_TURN = "array<struct<text:string,start:string,end:string,speaker_id:string>>"
TRANSLATED_TURN = "array<struct<turn_index:int,text:string,start_ms:bigint,end_ms:bigint,speaker_id:string,original_turn_indices:array<int>,sentiment_label:string>>"
CATALOG = T.StructType([
    T.StructField("therapist_id", T.StringType()), T.StructField("patient_id", T.StringType()), T.StructField("names_bindung", T.BooleanType()), T.StructField("has_bindung", T.BooleanType()),
    T.StructField("transcript", T.StringType()), T.StructField("patient_openface", T.StringType()), T.StructField("therapist_openface", T.StringType()),
    T.StructField("interview", T.LongType()),
])
SYNC = T.StructType([
    T.StructField(name, T.LongType() if name in ("turn_index", "n_frames", "simul_smile_frames", "simul_smile_n_frames") else
                  T.StringType() if name in ("participant_id", "interviewer_id", "sentiment", "level", "au") else T.DoubleType())
    for name in SYNC_TURNS
])
UNITS = ("AU06_r", "AU12_r", "AU06_c", "AU12_c")
MEDIA = ("*.mov", "*.mp4", "*.wav")


def parse_rttm(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """keep, uri, start_s, dur_s, speaker of SPEAKER lines in column value; other and blank lines are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    kept = lines.withColumn("p", parts).where((F.col("p")[0] == "SPEAKER") & (F.size("p") > 7))
    number = lambda i: F.col("p")[i].try_cast("double")
    return kept.select(*keep, F.col("p")[1].alias("uri"), number(3).alias("start_s"), number(4).alias("dur_s"), F.col("p")[7].alias("speaker"))


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.rttm").text(path)
    return parse_rttm(lines.select("value", F.col("_metadata.file_path").alias("file")), ["file"])


def _listed(items: Column, strict: bool) -> Column:
    """The items, or an error for a file whose top level is no list."""
    return F.coalesce(items, F.raise_error(F.concat(F.lit("not a JSON list: "), F.col("file"))).cast("void")) if strict else items


def read_turns(spark: SparkSession, path: str, glob: str = "results_*.json", schema: str = ASR_TURN, recursive: bool = True, strict: bool = True) -> DataFrame:
    """file, idx and the fields of each item of JSON arrays, with places kept. A file that is no array is an error; if not
    strict it has no rows, see malformed()."""
    found = _documents(spark, path, glob, schema, recursive).select("file", F.posexplode(_listed(F.col("items"), strict)).alias("idx", "item"))
    return found.select("file", "idx", "item.*")


def read_asr_turns(spark: SparkSession, path: str, glob: str = "results_*.json", recursive: bool = True, strict: bool = True) -> DataFrame:
    """file, idx, speaker, text, start, end of each item, in the types that the items have: numbers are cut to whole
    milliseconds, a JSON null text or speaker is the word None, an absent one blank or unknown. start is 0 and end the start
    where there is none that can be read."""
    whole = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).text(path, wholetext=True)
    parsed = whole.select(F.col("_metadata.file_path").alias("file"), F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>").alias("items"))
    each = parsed.select("file", F.posexplode(_listed(F.col("items"), strict)).alias("idx", "item"))
    field = lambda name: F.try_variant_get("item", f"$.{name}", "variant")
    start = X.coerce_json_ms(field("start"), F.lit(0).cast("bigint"))
    return each.select(
        "file", "idx", X.json_text(field("speaker_id"), "unknown").alias("speaker"), X.json_text(field("text"), "").alias("text"),
        start.alias("start"), X.coerce_json_ms(field("end"), F.greatest(start, F.lit(0).cast("bigint"))).alias("end"),
    )


def malformed(spark: SparkSession, path: str, glob: str = "results_*.json", recursive: bool = True) -> DataFrame:
    """Files whose top level is not a list."""
    return _documents(spark, path, glob, ASR_TURN, recursive).where("items is null").select("file")


def _documents(spark: SparkSession, path: str, glob: str, schema: str, recursive: bool) -> DataFrame:
    whole = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).text(path, wholetext=True)
    is_list = F.ltrim("value").startswith("[")
    return whole.select(F.col("_metadata.file_path").alias("file"), F.when(is_list, F.from_json("value", schema)).alias("items"))


def analysis_turns(labelled: DataFrame, label_key: str = "sentiment_label") -> DataFrame:
    """file, turn_index, sentiment, start_s, end_s of the turns that carry a label."""
    kept = labelled.where(F.col(label_key).isNotNull())
    return kept.select("file", "turn_index", F.lower(X.strip(F.col(label_key))).alias("sentiment"), (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"))


def labelled_files(spark: SparkSession, path: str, suffix: str = "_sentiment") -> DataFrame:
    """path and code of labelled files in a folder."""
    named = spark.read.format("binaryFile").option("pathGlobFilter", f"translate_*{suffix}.json").load(path).select("path")
    return named.withColumn("code", X.patient_code(F.regexp_extract("path", r"[^/]*$", 0)))


def bindung_files(files: DataFrame) -> DataFrame:
    """Files whose name tells a bindung interview."""
    return files.where(F.lower(F.regexp_extract("path", r"[^/]*$", 0)).rlike("bindung|brfi"))


def read_catalog(spark: SparkSession, document: dict[str, Any]) -> DataFrame:
    """The data model (a parsed YAML document, a row for each interview, numbered from 0)."""
    rows = []
    for number, item in enumerate(document.get("interviews") or []):
        types = item.get("types") or {}
        one = types.get("bindung") or {}
        text = lambda v: str(v or "").strip()
        rows.append((
            text((item.get("therapist") or {}).get("therapist_id")), text((item.get("patient") or {}).get("patient_id")), "bindung" in types, bool(one),
            one.get("transcript"), text(one.get("patient_openface")) or None, text(one.get("therapist_openface")) or None, number,
        ))
    return spark.createDataFrame(rows, CATALOG)


def read_catalog_file(spark: SparkSession, path: str) -> DataFrame:
    """The data model from a YAML or JSON file in any store that Spark reads."""
    text = spark.read.text(path, wholetext=True).first()
    if text is None:
        return read_catalog(spark, {})
    if text[0].lstrip().startswith("{"):
        return read_catalog(spark, json.loads(text[0]))
    import yaml  # only here: a session without it can still read JSON

    return read_catalog(spark, yaml.safe_load(text[0]) or {})


def read_synchrony(spark: SparkSession, path: str) -> DataFrame:
    """The synchrony table from CSV, by the names in its header: absent columns and empty cells are null, others are left out."""
    raw = spark.read.option("header", True).csv(path, enforceSchema=False)

    def cell(field: T.StructField) -> Column:
        value = F.col(field.name) if field.name in raw.columns else F.lit(None).cast("string")
        if field.dataType == T.StringType():
            return value.alias(field.name)
        number = value.try_cast("double")
        number = F.when(~F.isnan(number), number)
        return (number.cast("bigint") if field.dataType == T.LongType() else number).alias(field.name)

    return raw.select(*map(cell, SYNC.fields))


def read_openface(spark: SparkSession, path: str | list[str], threshold: float = 0.5, drop: bool = False) -> DataFrame:
    """file, ts and the four units of frame tables; frames below the confidence lose their values, or go if `drop`."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path, enforceSchema=False)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    number = lambda c: F.col(c).try_cast("double")
    sure = number("confidence") >= threshold if "confidence" in raw.columns else F.lit(True)

    def unit(name: str) -> Column:
        value = number(name) if name in raw.columns else F.lit(None).cast("double")
        return F.when(sure & ~F.isnan(value), value).alias(name.lower())

    out = raw.where(sure) if drop else raw
    return out.select(F.col("_metadata.file_path").alias("file"), number("timestamp").alias("ts"), *map(unit, UNITS))


def scan_frames(spark: SparkSession, paths: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """file, ts and the four units of frame tables, each read by its own header; kind and message (else null) for what can't be read.

    KeyError: no header names a timestamp. ParserError: a line has more cells than its header. A bad file is no error of the scan, and other
    files' rows stay; large files are read in splits. Cells are parted at commas, without quotes. An empty file has no row.
    """
    lines = spark.read.text(list(paths)).where(F.trim("value") != "").select(documents.source_file().alias("file"), "value")
    cells = F.transform(F.split("value", ","), lambda x: F.trim(x))
    heads = lines.where(F.col("value").contains("timestamp")).select("file", cells.alias("head")).where(F.array_contains("head", "timestamp"))
    heads = heads.groupBy("file").agg(F.min("head").alias("head"))
    at = {name: F.array_position("head", name).cast("int") for name in ("timestamp", "confidence", *UNITS)}
    heads = heads.select("file", F.size("head").alias("width"), *[c.alias(f"at_{n}") for n, c in at.items()])
    met = lines.join(heads, "file", "left").withColumn("cells", cells)
    wide = F.size("cells") > F.col("width")
    kind = F.when(F.col("width").isNull(), "KeyError").when(wide, "ParserError")
    message = F.when(F.col("width").isNull(), "'timestamp'").when(wide, F.format_string("expected %d fields, saw %d", "width", F.size("cells")))

    def number(name: str) -> Column:
        return F.when(F.col(f"at_{name}") > 0, F.get("cells", F.col(f"at_{name}") - 1)).try_cast("double")

    sure = F.when(F.col("at_confidence") > 0, number("confidence") >= threshold).otherwise(F.lit(True))

    def unit(name: str) -> Column:
        value = number(name)
        return F.when(sure & ~F.isnan(value), value).alias(name.lower())

    told = met.where(~F.array_contains("cells", "timestamp") | F.col("width").isNull())
    return told.select("file", number("timestamp").alias("ts"), *map(unit, UNITS), kind.alias("kind"), message.alias("message"))


def scan_labelled(spark: SparkSession, path: str, glob: str, label_key: str = "sentiment_label") -> DataFrame:
    """file, turn_index, sentiment, start_s, end_s of the labelled turns of JSON documents in a folder; kind and message (else null) of
    documents that can't be read: JSONDecodeError, or TypeError where the top level is no list. A document without labelled turns has no row."""
    whole = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    parsed = whole.select(documents.source_file().alias("file"), F.try_parse_json("value").alias("v"))
    parsed = parsed.withColumn("items", F.try_variant_get("v", "$", "array<variant>"))
    kind = F.when(F.col("v").isNull(), "JSONDecodeError").when(F.col("items").isNull(), "TypeError")
    message = F.when(F.col("v").isNull(), "not a JSON document").when(F.col("items").isNull(), "not a JSON list")
    each = parsed.select("file", kind.alias("kind"), message.alias("message"), F.explode_outer("items").alias("item"))
    field = lambda name, of: F.try_variant_get("item", f"$['{name}']", of)
    label = field(label_key, "string")
    each = each.select(
        "file", field("turn_index", "int").alias("turn_index"), F.lower(X.strip(label)).alias("sentiment"),
        (field("start_ms", "double") / 1000).alias("start_s"), (field("end_ms", "double") / 1000).alias("end_s"), "kind", "message",
    )
    return each.where(F.col("kind").isNotNull() | F.col("sentiment").isNotNull())


def discover_media(spark: SparkSession, path: str, globs: Sequence[str] = MEDIA, temp_audio: str | None = None) -> DataFrame:
    """Paths of recordings below a folder, in order. temp_audio: the folder of extracted sound, which alone is looked through."""
    if temp_audio is not None:
        path, globs = temp_audio, ("*.wav",)
    found = None
    for glob in globs:
        one = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path")
        found = one if found is None else found.union(one)
    return found.distinct().orderBy("path")


def bindung_counts(files: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """(found, kept, skipped_name, skipped_patient): how many files a discovery keeps; with a catalog codes must match."""
    named = F.lower(F.regexp_extract("path", r"[^/]*$", 0)).rlike("bindung|brfi")
    if catalog is None:
        marked = files.withColumn("known", F.lit(True))
    else:
        known = catalog.where("names_bindung").select(F.upper(X.strip(F.col("patient_id"))).alias("code"), F.lit(True).alias("known")).where("code <> ''").distinct()
        marked = files.join(known, "code", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return marked.agg(
        F.count("*").alias("found"), F.count_if(named & F.col("known")).alias("kept"), F.count_if(~named).alias("skipped_name"),
        F.count_if(named & ~F.col("known")).alias("skipped_patient"),
    )


def first_existing(rows: DataFrame, path_col: str, existing: DataFrame, root: str, name: str = "resolved") -> DataFrame:
    """rows with the first of the path, its rewrite for the other system, or the path below root, that `existing` (path) lists.

    Paths of /mnt/ are rewritten one way, those with a drive the other, any else is taken from the root. None listed: null.
    """
    raw = F.col(path_col)
    other = F.when(raw.startswith("/mnt/"), windows_path(raw)).when(raw.rlike("^.:.") , native_path(raw)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), raw))
    asked = rows.where(raw.isNotNull() & (raw != "")).select(raw.alias("_raw"), F.posexplode(F.array(raw, other)).alias("_place", "_path")).distinct()
    listed = existing.select(F.regexp_replace("path", r"^file:/+", "/").alias("_path")).distinct()
    best = asked.join(listed, "_path").groupBy("_raw").agg(F.min_by("_path", "_place").alias(name))
    return rows.join(best, raw.eqNullSafe(F.col("_raw")), "left").drop("_raw")


def native_path(path: Column) -> Column:
    """/mnt/c/x for C:\\x; anything else as it is."""
    drive, rest = F.lower(F.substring(path, 1, 1)), F.translate(F.substring(path, 3, 10_000), "\\", "/")
    return F.when(path.rlike(r"^[A-Za-z]:[\\/]"), F.concat(F.lit("/mnt/"), drive, rest)).otherwise(path)


def windows_path(path: Column) -> Column:
    """C:\\x for /mnt/c/x; anything else as it is."""
    drive = F.upper(F.regexp_extract(path, r"^/mnt/([A-Za-z])(?=/)", 1))
    return F.when(drive != "", F.concat(drive, F.lit(":"), F.translate(F.substring(path, 7, 10_000), "/", "\\"))).otherwise(path)
