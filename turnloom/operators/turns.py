"""Operators on the ordered turns of a file: roles, islands, indices, context, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import text as T

MIN_SEGMENT_MS = 1500


def segment_filter(segments: DataFrame, role: Column, both_speakers: bool = False, least_ms: int = MIN_SEGMENT_MS) -> DataFrame:
    """Segments (start_s, dur_s) of the client, or of both, that last long enough once cut to whole ms."""
    start = (F.col("start_s") * 1000).cast("bigint")
    end = ((F.col("start_s") + F.col("dur_s")) * 1000).cast("bigint")
    out = segments.withColumn("start_ms", start).withColumn("end_ms", end)
    out = out.where(F.col("end_ms") - F.col("start_ms") >= least_ms)
    return out if both_speakers else out.where(role != "therapist")


def in_time_order(segments: DataFrame, file_col: str = "file") -> DataFrame:
    """Segments by file and time, with their place in the file."""
    along = Window.partitionBy(file_col).orderBy("start_s", "dur_s")
    return segments.withColumn("place", (F.row_number().over(along) - 1).cast("bigint")).orderBy(file_col, "place")


def speaker_roles(segments: DataFrame, file_col: str = "file", speaker_col: str = "speaker") -> DataFrame:
    """(file, speaker, covered_s, role): who speaks longest is the client, the first other the therapist.

    Overlapping segments of one speaker count once. Equally long: the name that comes first. Needs start_s, dur_s.
    """
    key = [file_col, speaker_col]
    order = Window.partitionBy(*key).orderBy("start_s", "dur_s")
    end = F.col("start_s") + F.col("dur_s")
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(end - F.greatest(F.col("start_s"), F.coalesce(reached, F.col("start_s"))), F.lit(0.0))
    spoken = segments.withColumn("fresh", fresh).groupBy(*key).agg(F.sum("fresh").alias("covered_s"))
    rank = F.row_number().over(Window.partitionBy(file_col).orderBy(F.desc(F.round("covered_s", 9)), speaker_col))
    others = F.row_number().over(Window.partitionBy(file_col, F.col("rank") == 1).orderBy(speaker_col))
    spoken = spoken.withColumn("rank", rank).withColumn("nth", others)
    role = F.when(F.col("rank") == 1, "client").when(F.col("nth") == 1, "therapist")
    return spoken.select(*key, "covered_s", role.alias("role"))


def speaker_islands(turns: DataFrame, file_col: str = "file") -> DataFrame:
    """Runs of one speaker, blank turns left out first: (file, turn_index, speaker_id, text, start_ms, end_ms,
    original_turn_indices). A run ends when its last turn ends, which need not be the latest end.

    turns: file, idx, speaker, text, start, end (longs). A missing speaker is unknown, a missing text blank.
    """
    kept = turns.select(
        F.col(file_col).alias("file"), "idx", F.lower(T.strip(F.coalesce("speaker", F.lit("unknown")))).alias("speaker"),
        T.strip(F.coalesce("text", F.lit(""))).alias("text"), *[c.alias(n) for c, n in zip(T.clamp_span(F.col("start"), F.col("end")), ("start_ms", "end_ms"), strict=True)],
    ).where("text <> ''")
    along = Window.partitionBy("file").orderBy("idx")
    change = (~F.col("speaker").eqNullSafe(F.lag("speaker").over(along))).cast("int")
    runs = kept.withColumn("change", change).withColumn("island", F.sum("change").over(along) - 1)
    parts = F.array_sort(F.collect_list(F.struct("idx", "text", "start_ms", "end_ms")))
    out = runs.groupBy("file", "island", "speaker").agg(parts.alias("p"))
    return out.select(
        F.col("file").alias(file_col), F.col("island").cast("int").alias("turn_index"), F.col("speaker").alias("speaker_id"),
        F.array_join("p.text", " ").alias("text"), F.col("p")[0]["start_ms"].alias("start_ms"),
        F.element_at("p", -1)["end_ms"].alias("end_ms"), F.col("p.idx").alias("original_turn_indices"),
    )


def context_window(turns: DataFrame, turns_before: int | None = 2, file_col: str = "file") -> DataFrame:
    """(file, idx, text, context) of client turns with the texts before them, of any speaker, blanks left out.

    turns_before 0 gives all earlier texts, as the slice [-0:] does; None says the same plainly.
    """
    kept = turns.withColumn("text", T.strip(F.coalesce("text", F.lit("")))).where("text <> ''")
    client = T.canonical_speaker(F.col("speaker")) == "client"
    if turns_before:
        frame = Window.partitionBy(file_col).orderBy("idx").rowsBetween(-turns_before, -1)
        return kept.withColumn("context", F.collect_list("text").over(frame)).where(client).select(file_col, "idx", "text", "context")
    # A file's transcript is shuffled once; what a turn has before it is a slice of that, cut where it is used.
    whole = kept.select(file_col, F.struct("idx", "text", client.alias("client")).alias("t")).groupBy(file_col).agg(F.array_sort(F.collect_list("t")).alias("all"))
    each = whole.select(file_col, "all", F.posexplode(F.col("all")).alias("place", "t")).where("t.client")
    return each.select(file_col, "t.idx", "t.text", F.slice(F.col("all.text"), F.lit(1), F.col("place")).alias("context"))


def write_back(turns: DataFrame, labels: DataFrame, label_key: str = "sentiment_label", file_col: str = "file") -> DataFrame:
    """turns with the label of (file, idx), null where there is none."""
    return turns.join(labels.select(file_col, "idx", F.col("label").alias(label_key)), [file_col, "idx"], "left")


def label_summary(labels: DataFrame, file_col: str = "file") -> DataFrame:
    """(file, label, n): by file and label, and over all files (file null). Empty labels are left out."""
    kept = labels.where(F.coalesce("label", F.lit("")) != "")
    sets = kept.groupingSets([[file_col, "label"], ["label"], []], file_col, "label")
    return sets.agg(F.count("*").alias("n")).select(file_col, "label", "n")


def summary_lines(summary: DataFrame) -> DataFrame:
    return summary.select(F.format_string("  %-12s %6d", F.coalesce("label", F.lit("TOTAL")), "n").alias("line"))


def progress(turns: DataFrame, every: int = 64, file_col: str = "file") -> DataFrame:
    """(file, batch, n, done): the client's turns in batches of `every`, as a labelling run reports them."""
    kept = turns.where((T.strip(F.coalesce("text", F.lit(""))) != "") & (T.canonical_speaker(F.col("speaker")) == "client"))
    place = F.row_number().over(Window.partitionBy(file_col).orderBy("idx")) - 1
    each = kept.withColumn("place", place).groupBy(file_col, F.floor(F.col("place") / every).cast("int").alias("batch"))
    return each.agg(F.count("*").alias("n"), (F.max("place") + 1).cast("bigint").alias("done"))


def turn_totals(turns: DataFrame, file_col: str = "file") -> DataFrame:
    role = T.canonical_speaker(F.col("speaker"))
    return turns.groupBy(file_col).agg(
        F.count("*").alias("turns"), F.count_if(role == "client").alias("client_turns"), F.count_if(role != "client").alias("other_turns")
    )


def asr_explode(segments: DataFrame, texts: Column, keep: Sequence[str]) -> DataFrame:
    """A row for each text a recogniser found in a segment, with the segment's clock."""
    return segments.select(*keep, F.posexplode(texts).alias("part", "text"))
