"""Importance resampling towards a target distribution, in Spark's own functions.

Hashed n-gram counts of the corpus and of the target give every bucket a gain; a document's weight is the sum over its
features; with a keyed Gumbel term added, the highest scores are a draw without replacement.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Words of a feature from, to; buckets; percent of the documents with enough words that are drawn; key of the draw.
GRAMS, BUCKETS, PERCENT, LEAST_WORDS, SEED = (1, 1), 10_000, 10, 20, "2024"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLACE = (1 << 33) - 1


def words(text: Column) -> Column:
    """Runs of a-z, digits and characters beyond ASCII, after lower-casing A-Z and nothing else; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def features(found: Column, grams: tuple[int, int] = GRAMS) -> Column:
    """All runs of grams[0] to grams[1] consecutive words, joined by one space, repeats included. found: an attribute."""

    def runs(n: int) -> Column:
        starts = F.slice(found, 1, F.greatest(F.size(found) - (n - 1), F.lit(0)))
        return starts if n == 1 else F.transform(starts, lambda x, i: F.concat_ws(" ", x, *[F.get(found, i + k) for k in range(1, n)]))

    out = [runs(n) for n in range(grams[0], grams[1] + 1)]
    return out[0] if len(out) == 1 else F.concat(*out)


def _exploded(rows: DataFrame, found: str, grams: tuple[int, int], buckets: int, keep: list[str]) -> DataFrame:
    """A row for each feature with its bucket, and one with a null bucket for rows without features."""
    each = rows.select(*keep, F.explode_outer(features(F.col(found), grams)).alias("feature"))
    return each.select(*keep, (F.crc32(F.col("feature").cast("binary")) % F.lit(buckets)).cast("int").alias("bucket"))


def bucket_counts(rows: DataFrame, text_col: str, grams: tuple[int, int] = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how often features of the texts fall in it; `buckets` rows at most, summed before they are shuffled."""
    found = rows.select(words(F.col(text_col)).alias("found"))
    each = _exploded(found, "found", grams, buckets, [])
    return each.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for the buckets of the corpus: floor(1000 ln) of the ratio of shares, each with one count added to every bucket."""
    all_s, all_t = (int(x.agg(F.sum("n")).first()[0] or 0) for x in (corpus, target))
    both = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    s, t = F.col("s").cast("double"), F.coalesce("t", F.lit(0)).cast("double")
    ratio = (t + 1.0) * F.lit(float(all_s + buckets)) / ((s + 1.0) * F.lit(float(all_t + buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def gumbel(id_: Column, seed: str = SEED) -> Column:
    """floor(1000 x) of a Gumbel variate x that the seed and the id decide; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    grams: tuple[int, int] = GRAMS,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """One row for each row of docs: id, n_words, n_features, weight, score, rank (1, 2, ... for those drawn, else null).

    Drawn are percent of the documents with least_words or more, rounded down: highest scores first, ties to the smaller id, null
    ids last, then to fewer words. Repeated rows and ids are documents of their own. Null and empty texts have no features and
    weight 0. Without target texts all buckets count as never seen there. Other columns of docs, whatever their names, are not read.

    Only bucket counts are broadcast (`buckets` rows at most). Texts are read twice, and what is shuffled is a row of numbers a document:
    its features are summed in the task that reads it. Ranks are places in range partitions plus the rows of the partitions before.
    """
    corpus = cut(bucket_counts(docs, text_col, grams, buckets))
    wanted = cut(bucket_counts(target, target_col, grams, buckets))
    gain = cut(gains(corpus, wanted, buckets))
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("found"))
    keyed = found.select("row", "id", F.size("found").cast("long").alias("n_words"), "found")
    each = _exploded(keyed, "found", grams, buckets, ["row", "id", "n_words"]).join(F.broadcast(gain), "bucket", "left")
    summed = each.groupBy("row", "id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    scored = cut(summed.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)))
    enough = F.col("n_words") >= least_words
    drawn = percent * scored.where(enough).count() // 100
    order = [F.when(enough, 0).otherwise(1), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_words"), F.col("row")]
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)).alias("place")))
    before, starts = 0, []
    for part, n in sorted(placed.groupBy("part").count().collect()):  # a row for each partition
        starts.append((part, before))
        before += n
    offsets = docs.sparkSession.createDataFrame(starts, "part int, start long")
    rank = F.col("start") + F.col("place") + 1
    return placed.join(F.broadcast(offsets), "part").select(
        "id", "n_words", "n_features", "weight", "score", F.when(enough & (rank <= drawn), rank).alias("rank")
    )
