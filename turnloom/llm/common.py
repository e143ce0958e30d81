"""Helpers that the operators share: batch sizes, hold-out rule, bounded samples, free names; scratch tables from turnloom.scratch."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.scratch import cut, drop  # noqa: F401
from turnloom.workers import BATCH_BYTES, bound_batches  # noqa: F401


def remainder(doc_id: Column, by: int) -> Column:
    """crc32(doc_id as text) mod by; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(by)


def drawn(rows: DataFrame, key: Column, rows_wanted: int, count: int) -> DataFrame:
    """About rows_wanted of count rows by the hash of a key, the same ones in every run, and never more than twice as many.

    Rows that repeat a key are drawn or left together; the hard limit holds even so, and takes those of the least hash of all
    their columns. The sample is written to the scratch folder, so rows are read once for it.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    chosen = cut(rows.where(place < int(min(1.0, rows_wanted / max(count, 1)) * (1 << 30))))
    if chosen.count() <= 2 * rows_wanted:
        return chosen
    mark = free_name("place", rows.columns)
    return chosen.withColumn(mark, F.xxhash64(*rows.columns)).orderBy(mark, *rows.columns).limit(2 * rows_wanted).drop(mark)


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """wanted, with underscores before it until no column has that name."""
    names = {x.lower() for x in taken}
    while wanted.lower() in names:
        wanted = "_" + wanted
    return wanted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
