"""Writers of the engine's outputs. Folders are written by tasks; one file only where the format asks for it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.sources import documents
from turnloom.sources.columns import SMILE_TURNS, SYNC_TURNS  # noqa: F401

def mode(overwrite: bool) -> str:
    """Existing output is left alone unless asked otherwise."""
    return "overwrite" if overwrite else "ignore"


def write_csv(df: DataFrame, path: str, columns: Sequence[str], overwrite: bool = True) -> None:
    """A header and the columns in the given order; absent columns, nulls and NaN are empty cells."""

    def cell(name: str):
        if name not in df.columns:
            return F.lit(None).cast("string").alias(name)
        c = F.col(name)
        return (F.when(~F.isnan(c), c).alias(name) if df.schema[name].dataType.simpleString() in ("double", "float") else c)

    df.select(*map(cell, columns)).write.mode(mode(overwrite)).option("header", True).csv(path)


def rttm_lines(segments: DataFrame) -> DataFrame:
    """file, value: one SPEAKER line for each segment (uri, start_s, dur_s, speaker), blanks in names made _."""
    clean = lambda c: T.sanitize_uri(F.col(c))
    line = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", clean("uri"), F.col("start_s"), F.col("dur_s"), clean("speaker"))
    return segments.select(clean("uri").alias("file"), "start_s", line.alias("value"))


def write_rttm(segments: DataFrame, root: str, overwrite: bool = True) -> None:
    """<uri>/<uri>.rttm for each recording, its lines by start."""
    each = F.array_sort(F.collect_list(F.struct("start_s", "value")))
    docs = rttm_lines(segments).groupBy("file").agg(each.alias("lines"))
    documents.write(docs.select(F.concat("file", F.lit("/"), "file", F.lit(".rttm")).alias("path"), F.concat(F.array_join("lines.value", "\n"), F.lit("\n")).alias("value")), root, overwrite)


def json_documents(items: DataFrame, fields: Sequence[str], file_col: str = "file", order: str = "idx") -> DataFrame:
    """file, value: a JSON list of each file's items in order; a field that is null in an item is left out there."""
    each = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*fields).alias("item"))))
    docs = items.groupBy(file_col).agg(each.alias("all"))
    return docs.select(F.col(file_col).alias("file"), F.to_json(F.col("all.item"), {"ignoreNullFields": "true"}).alias("value"))


def write_json(
    items: DataFrame, root: str, fields: Sequence[str], overwrite: bool = False, file_col: str = "file", order: str = "idx", path: Column | None = None,
) -> None:
    """One document for each file with its list of items, under its own name: path, an expression over file (<file>.json if None)."""
    docs = json_documents(items, fields, file_col, order)
    documents.write(docs.select((F.concat("file", F.lit(".json")) if path is None else path).alias("path"), "value"), root, overwrite)


# The name of the labelled files' summary, its heading lines and the forms of its counts.
REPORT_NAME = "sentiment_label_summary.txt"
REPORT_HEAD = ("Sentiment-label summary", "=" * 40, "", "Overall counts:")
REPORT_FILES = "Per-file counts:"
REPORT_COUNT, REPORT_FILE = "  %-12s %6d", "  %s: %s"


def label_report(labels: DataFrame) -> DataFrame:
    """path, value: one text with the counts of each label over all files, their total, and a line for each file. labels: file, label (blank
    or null: the file is named all the same)."""
    counts = labels.groupBy("file", "label").agg(F.count("*").alias("n")).where("label <> ''")
    part = F.format_string("%s=%d", "label", "n")
    told = counts.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(part)), ", ").alias("said"))
    by_file = labels.select("file").distinct().join(told, "file", "left")
    by_file = by_file.agg(F.array_sort(F.collect_list(F.format_string(REPORT_FILE, "file", F.coalesce("said", F.lit(""))))).alias("files"))
    total = counts.groupBy("label").agg(F.sum("n").alias("n"))
    total = total.agg(F.array_sort(F.collect_list(F.format_string(REPORT_COUNT, "label", "n"))).alias("labels"), F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    head, middle = F.array(*map(F.lit, REPORT_HEAD)), F.array(F.format_string(REPORT_COUNT, F.lit("TOTAL"), "all"), F.lit(""), F.lit(REPORT_FILES))
    lines = F.concat(head, "labels", middle, "files")
    both = total.withColumn("one", F.lit(1)).join(by_file.withColumn("one", F.lit(1)), "one")  # a row each
    return both.select(F.lit(REPORT_NAME).alias("path"), F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("value"))


def write_label_report(labels: DataFrame, root: str) -> None:
    documents.write(label_report(labels), root, overwrite=True)
