"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a token target (weights share a budget; no source passes `max_epochs` passes). Its
documents lie one after another in the order of a keyed hash, pass after pass, until the target is used up.
A source's weight changes over training time; the integral of that schedule is its cumulative demand, and
inverting it turns the point where a document starts into a training position between 0 and 1.

Running sums never gather a source in one task: sizes are summed by (source, hash prefix), those sums are
accumulated by source, and only the rows of one hash prefix are put in order together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
#: Weight at training times 0, 1/2 and 1, relative to the source's mean weight; sources take them in turn.
CURRICULUM = ((1.5, 1.0, 0.5), (0.5, 1.0, 1.5), (1.0, 1.0, 1.0))
#: Hex digits of the order hash that name a bucket, least and most, and the rows of a bucket that they aim at. The order of
#: the rows does not depend on how many digits there are.
BUCKET_DIGITS, BUCKET_ROWS = (3, 5), 20_000


def words(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _in_turn(rank: Column, values: Sequence[float]) -> Column:
    out = F.lit(values[-1])
    for i, v in enumerate(values[:-1]):
        out = F.when(rank % len(values) == i, F.lit(v)).otherwise(out)
    return out


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """(src, n_rank, source_size, target) of rows with src (struct; nulls are a source too) and size.

    Sources take `weights` in turn by code point, null last. Their shares of budget x all sizes are cut at
    max_epochs x the source's size and the excess goes to the others by weight until none is above: with
    sources in the order of cap / weight, the first that is below its cap fixes the common level.
    One row for each source; an empty table gives none.
    """
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    per = per.withColumn("n_rank", F.row_number().over(by_name) - 1)
    per = per.withColumn("w", _in_turn(F.col("n_rank"), [float(x) for x in weights]))
    per = per.withColumn("cap", F.col("source_size").cast("double") * float(max_epochs))
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), "n_rank")
    whole = Window.partitionBy()
    per = per.withColumn("at", F.row_number().over(order))
    per = per.withColumn("all_words", F.sum("source_size").over(whole).cast("double") * float(budget))
    per = per.withColumn(
        "level",
        (F.col("all_words") - (F.sum("cap").over(order) - F.col("cap")))
        / (F.sum("w").over(whole) - (F.sum("w").over(order) - F.col("w"))),
    )
    open_ = F.col("cap") > F.col("level") * F.col("w")
    first = F.min(F.when(open_, F.struct("at", "level"))).over(whole)
    per = per.withColumn("first", first)
    capped = F.col("first").isNull() | (F.col("at") < F.col("first.at"))
    target = F.when(capped, F.col("cap")).otherwise(F.col("first.level") * F.col("w"))
    return per.select("src", "n_rank", "source_size", target.alias("target"))


def invert_demand(share: Column, rank: Column, curriculum: Sequence[Sequence[float]] = CURRICULUM) -> Column:
    """Time in [0, 1] by which a source has used `share` of its demand, its weight linear between the knots."""
    n = len(curriculum[0]) - 1
    knots = [_in_turn(rank, [float(c[j]) for c in curriculum]) for j in range(n + 1)]
    areas = [(knots[j] + knots[j + 1]) / (2.0 * n) for j in range(n)]
    whole = areas[0]
    for a in areas[1:]:
        whole = whole + a
    need, before, out = share * whole, F.lit(0.0), None
    steps = []
    for j in range(n):
        left = need - before
        slope = (knots[j + 1] - knots[j]) * float(n)
        root = F.sqrt(F.greatest(knots[j] * knots[j] + slope * left * 2.0, F.lit(0.0)))
        steps.append((before + areas[j], j / n + left * 2.0 / (knots[j] + root)))
        before = before + areas[j]
    out = steps[-1][1]
    for upto, value in reversed(steps[:-1]):
        out = F.when(need <= upto, value).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def mix(
    docs: DataFrame,
    keep: Sequence[str] = (),
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    budget: float = BUDGET,
    max_epochs: int = MAX_EPOCHS,
    curriculum: Sequence[Sequence[float]] = CURRICULUM,
) -> DataFrame:
    """One row for each row of docs: id, size, src, source_size, target, taken, positions, kept (struct of `keep`).

    taken: words of this document in the mix, repeats counted; the document at which a source's target runs
    out counts with the words up to there. positions: the training time of each pass that starts.
    Rows lie in the order of a hash of id and text, so rows that repeat an id or have none are spread like others.
    Null text: size 0, nothing taken. Null ids count as the empty text. Repeated rows are separate documents.
    Other columns of docs, whatever their names, are not read unless they are in `keep`.
    """
    h = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))
    digits = min(max(math.ceil(math.log(max(docs.count(), 1) / BUCKET_ROWS, 16)), BUCKET_DIGITS[0]), BUCKET_DIGITS[1])
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.struct(F.col(source_col).alias("name")).alias("s"),
        words(F.col(text_col)).alias("size"),
        h.alias("h"),
        *([F.struct(*keep).alias("kept")] if keep else []),
    )
    # A null source is a value of its own here: joins on a plain null would lose it.
    rows = rows.withColumn("src", F.concat(F.when(F.col("s.name").isNull(), "1").otherwise("0"), F.coalesce("s.name", F.lit(""))))
    rows = rows.drop("s").withColumn("bucket", F.substring("h", 1, digits))
    if not keep:
        rows = cut(rows)
    sums = cut(rows.groupBy("src", "bucket").agg(F.sum("size").alias("size")))
    targets = source_targets(sums, weights, budget, max_epochs)
    along = Window.partitionBy("src").orderBy("bucket")
    base = sums.withColumn("base", F.sum("size").over(along) - F.col("size")).drop("size")
    base = base.join(targets, "src")
    demand = F.floor("target")
    full = F.when(F.col("source_size") > 0, F.floor(demand / F.col("source_size"))).otherwise(0)
    base = base.withColumn("demand", demand).withColumn("full", full)
    base = cut(base)
    inside = Window.partitionBy("src", "bucket").orderBy("h", "id", "size")
    out = rows.join(base, ["src", "bucket"])
    out = out.withColumn("start", F.col("base") + F.sum("size").over(inside) - F.col("size"))
    rest = F.col("demand") - F.col("full") * F.col("source_size") - F.col("start")
    out = out.withColumn("taken", F.col("full") * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size"))))
    starts = F.array(*[F.col("start") + F.col("source_size") * p for p in range(max_epochs)])
    begun = F.when(F.col("size") > 0, F.filter(starts, lambda x: x < F.col("demand"))).otherwise(F.array().cast("array<bigint>"))
    positions = F.transform(begun, lambda x: invert_demand(x / F.col("target"), F.col("n_rank"), curriculum))
    return out.select(
        "id", "size", "src", "source_size", "target", F.col("taken").cast("long").alias("taken"),
        positions.alias("positions"), *(["kept"] if keep else []),
    )


def in_training_order(mixed: DataFrame, *order: Column) -> DataFrame:
    """Range-sorted by first position (documents that are not taken come last), then by `order` and id."""
    first = F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0))
    keys = [first, *order, F.col("id")]
    return mixed.repartitionByRange(*keys).sortWithinPartitions(*keys)


def training_stream(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them, in training order: a row for each pass of which at least half is taken.

    Columns are those of docs; whole documents only.
    """
    names = docs.columns
    mixed = mix(docs, names, **options)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    passes = mixed.select("kept", "id", F.explode(F.slice("positions", F.lit(1), F.greatest(copies, F.lit(0)))).alias("position"))
    passes = passes.repartitionByRange("position", "id").sortWithinPartitions("position", "id")
    return passes.select(*[F.col("kept").getField(n).alias(n) for n in names])
