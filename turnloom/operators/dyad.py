"""Operators that align the frames of two partners with turns.

frames: dyad, side (0 participant, 1 interviewer), ts (seconds), intensity, presence (null where missing).
turns: dyad, turn_index, start_s, end_s and whatever else; one row for each (dyad, turn_index).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import signals as S
from turnloom.workers import bound_batches, reachable

HZ = 30.0
MAX_LAG_S = 2.5
MIN_TURN_S = 4 * MAX_LAG_S
MIN_FRAMES = 3
#: Seconds of one time bucket of the range join.
BUCKET_S = 600.0
#: Points that a worker holds before it passes them on.
POINTS = 1 << 16


def range_join(turns: DataFrame, points: DataFrame, at: str, *, closed: bool, bucket: float = BUCKET_S) -> DataFrame:
    """turns left-joined with the points of their dyad from start_s up to end_s (included if closed).

    A turn is listed under each time bucket that it meets and a point under its own, so the join has equal keys
    and no interview is one task's. Points that have a column `bucket` are taken to lie there, and stay where they are if they
    are dealt by (dyad, bucket).
    """
    first, last = F.floor(F.col("start_s") / bucket), F.floor(F.col("end_s") / bucket)
    listed = turns.withColumn("bucket", F.explode(F.sequence(first, F.greatest(first, last))))
    own = F.col("bucket") if "bucket" in points.columns else F.floor(F.col(at) / bucket)
    there = points.withColumn("at_bucket", own).withColumnRenamed("dyad", "at_dyad").drop("bucket")
    upper = F.col(at) <= F.col("end_s") if closed else F.col(at) < F.col("end_s")
    on = (F.col("dyad") == F.col("at_dyad")) & (F.col("bucket") == F.col("at_bucket")) & (F.col(at) >= F.col("start_s")) & upper
    return listed.join(there, on, "left").drop("at_dyad", "at_bucket", "bucket")


def turn_means(turns: DataFrame, frames: DataFrame, min_frames: int = MIN_FRAMES, bucket: float = BUCKET_S) -> DataFrame:
    """turns with the four means of smiling, each over the person's own frames in [start_s, end_s).

    A mean over fewer than max(1, min_frames) finite values is null; turns without frames stay.
    """
    least, names = max(1, min_frames), turns.columns
    met = range_join(turns, frames.select("dyad", "side", "ts", "intensity", "presence"), "ts", closed=False, bucket=bucket)

    def mean(side: int, column: str) -> Column:
        v = S.finite(F.when(F.col("side") == side, F.col(column)))
        return F.when(F.count(v) >= least, F.avg(v))

    return met.groupBy(*names).agg(
        mean(0, "intensity").alias("client_smile_intensity"), mean(1, "intensity").alias("therapist_smile_intensity"),
        mean(0, "presence").alias("client_smile_freq"), mean(1, "presence").alias("therapist_smile_freq"),
    )


def spans(frames: DataFrame, hz: float = HZ) -> DataFrame:
    """(dyad, t0, last): the common grid's first time and last number, a row for each dyad; fewer than 3 points: none."""
    ends = frames.groupBy("dyad").agg(*[f(F.when(F.col("side") == s, F.col("ts"))).alias(n) for s in (0, 1) for f, n in ((F.min, f"lo{s}"), (F.max, f"hi{s}"))])
    ends = ends.where("lo0 is not null and lo1 is not null")
    span = ends.select("dyad", F.greatest("lo0", "lo1").alias("t0"), F.least("hi0", "hi1").alias("t1"))
    steps = F.floor((F.col("t1") - F.col("t0")) * hz + F.lit(1e-9)).cast("long")
    return span.select("dyad", "t0", steps.alias("last")).where("last >= 2")


def common_grid(frames: DataFrame, hz: float = HZ) -> DataFrame:
    """(dyad, i, t): t0 + i / hz over the time both partners have frames; fewer than 3 points: none."""
    span = spans(frames, hz)
    return span.select("dyad", "t0", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("i")).select("dyad", "i", (F.col("t0") + F.col("i") / hz).alias("t"))


def _frame(column: str) -> Column:
    return F.struct(F.col("ts").alias("t"), F.col(column).cast("double").alias("v"))


def _dealt(places: DataFrame, frames: DataFrame, bucket: float, **values: Column) -> DataFrame:
    """A row for each (dyad, bucket) of places, with what else they have, and for each value the frames of both sides, <name>_0 and <name>_1:
    array<struct<t, v>> in order, those of the bucket with the last frame before it and the first after it.

    places: one row for each bucket that holds points. values: by name the (t, v) struct of a frame, null where the frame does not count. Frames are
    shuffled once, however many values they have; points are not. The frames before and after a bucket come from a table of one row a
    bucket, so a long recording is not one task's, and a row is bounded by a bucket's length.
    """
    none = {n: F.lit(None).cast("struct<t:double,v:double>") for n in values}
    with_own = [c for c in places.columns if c not in ("dyad", "bucket")]
    key = ["dyad", "side", "bucket"]
    known = frames.where(F.col("ts").isNotNull()).select("dyad", F.col("side").cast("int").alias("side"), F.floor(F.col("ts") / bucket).alias("bucket"), *[c.alias(n) for n, c in values.items()])
    edges = {f"{n}_{at}": (f(F.col(n)["t"]), by(F.col(n)["v"], F.col(n)["t"])) for n in values for at, f, by in (("first", F.min, F.min_by), ("last", F.max, F.max_by))}
    sides = places.select("dyad", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "bucket", F.lit(True).alias("place"))
    ends = known.unionByName(sides, allowMissingColumns=True).groupBy(*key)  # of numbers, so by hash, and once
    ends = ends.agg(*[c.alias(f"{n}_{x}") for n, pair in edges.items() for x, c in zip("tv", pair, strict=True)], F.max("place").alias("place"))
    ends = ends.select(*key, *[F.when(F.col(f"{n}_t").isNotNull(), F.struct(F.col(f"{n}_t").alias("t"), F.col(f"{n}_v").alias("v"))).alias(n) for n in edges], "place")
    along = Window.partitionBy("dyad", "side").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("dyad", "side").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.struct(*[(end if n == m else none[m]).alias(m) for m in values]) for n in values for end in (F.last(f"{n}_last", ignorenulls=True).over(along), F.last(f"{n}_first", ignorenulls=True).over(back))]
    carried = ends.select(*key, "place", F.array(*carried).alias("all")).where("place").select(*key, F.explode("all").alias("one")).select(*key, "one.*")
    rows = known.unionByName(carried).unionByName(places, allowMissingColumns=True).repartition("dyad", "bucket")
    lists = [F.array_sort(F.collect_list(F.when(F.col("side") == k, F.col(n)))).alias(f"{n}_{k}") for n in values for k in (0, 1)]
    return rows.groupBy("dyad", "bucket").agg(*[F.first(c, ignorenulls=True).alias(c) for c in with_own], *lists).where(F.col(with_own[0]).isNotNull())


def _places(span: DataFrame, hz: float, bucket: float) -> DataFrame:
    """(dyad, bucket, t0, last): the buckets that a grid meets, from spans()."""
    first, end = F.floor(F.col("t0") / bucket), F.floor((F.col("t0") + F.col("last") / hz) / bucket)
    return span.select("dyad", F.explode(F.sequence(first, end)).alias("bucket"), "t0", "last")


def _points_in(t0: float, last: int, hz: float, at: int, bucket: float) -> tuple[int, np.ndarray]:
    """Number of a bucket's first grid point and the times of its points."""
    lo, hi = max(0, math.floor((at * bucket - t0) * hz) - 2), min(last, math.ceil(((at + 1) * bucket - t0) * hz) + 2)
    t = t0 + np.arange(lo, hi + 1) / hz
    own = np.flatnonzero(np.floor(t / bucket) == at)
    return (lo + int(own[0]), t[own]) if len(own) else (lo, t[:0])


class _Lists:
    """A column of lists of (t, v) structs without nulls among them: what a row's list holds, as numbers."""

    def __init__(self, column: pa.ListArray):
        flat = column.values
        self.to, self.t, self.v = column.offsets.to_numpy(), flat.field("t").to_numpy(zero_copy_only=False), flat.field("v")
        self.values = self.v.to_numpy(zero_copy_only=False).astype(float)

    def around(self, row: int, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each time the places in the column of the last frame at or before it and of the first at or after it; -1: none."""
        lo, hi = self.to[row], self.to[row + 1]
        own = self.t[lo:hi]
        a, b = np.searchsorted(own, t, "right") - 1, np.searchsorted(own, t, "left")
        return np.where(a < 0, -1, a + lo), np.where(b == hi - lo, -1, b + lo)

    def nearest(self, row: int, t: np.ndarray) -> np.ndarray:
        """Place of the nearer of the frames around each time, of two equally near the earlier; -1: none."""
        a, b = self.around(row, t)
        if not len(self.t):
            return a
        return np.where((b < 0) | ((a >= 0) & (t - self.t[a] <= self.t[b] - t)), a, b)

    def linear(self, row: int, t: np.ndarray) -> np.ndarray:
        """Value between the frames around each time; beyond the first or last frame, its value; NaN without frames."""
        a, b = self.around(row, t)
        if self.to[row] == self.to[row + 1]:
            return np.full(len(t), np.nan)
        ta, tb, va, vb = self.t[a], self.t[b], self.values[a], self.values[b]
        with np.errstate(all="ignore"):
            between = va + (vb - va) * ((t - ta) / (tb - ta))
        return np.where(a < 0, vb, np.where((b < 0) | (tb <= ta), va, between))


def _together(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Rows of columns, numpy or Arrow, one after the other."""
    return pa.RecordBatch.from_arrays([pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in c]) for c in zip(*rows, strict=True)], names)


def _resampled(grid: DataFrame, frames: DataFrame, bucket: float, value: Column, hz: float | None, line: bool) -> DataFrame:
    """(dyad, side, i, t, v) of a grid of points (dyad, i, t) or, with hz, of spans (dyad, t0, last)."""
    if hz is None:
        points = grid.withColumn("bucket", F.floor(F.col("t") / bucket)).groupBy("dyad", "bucket").agg(F.array_sort(F.collect_list(F.struct("t", "i"))).alias("at"))
    else:
        points = _places(grid, hz, bucket)
    found = _dealt(points, frames, bucket, f=value)

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dyad", "side", "i", "t", "v"]
        for batch in batches:
            sides, dyads, out, held = [_Lists(batch.column(f"f_{k}")) for k in (0, 1)], batch.column("dyad"), [], 0
            if hz is None:
                at = batch.column("at")
                to, ts, numbers = at.offsets.to_numpy(), at.values.field("t").to_numpy(), at.values.field("i").to_numpy()
            else:
                t0s, lasts, buckets = (batch.column(c).to_numpy() for c in ("t0", "last", "bucket"))
            for row in range(batch.num_rows):
                if hz is None:
                    t, i = ts[to[row] : to[row + 1]], numbers[to[row] : to[row + 1]]
                else:
                    lo, t = _points_in(float(t0s[row]), int(lasts[row]), hz, int(buckets[row]), bucket)
                    i = np.arange(lo, lo + len(t))
                for k, side in enumerate(sides):
                    if line:
                        empty = side.to[row] == side.to[row + 1]
                        v = pa.array(side.linear(row, t), mask=np.full(len(t), empty))
                    else:
                        near = side.nearest(row, t)
                        v = side.v.take(pa.array(near, mask=near < 0))
                    out.append((dyads.take(pa.array(np.full(len(t), row))), np.full(len(t), k, "int32"), i, t, v))
                held += 2 * len(t)
                if held > POINTS:
                    yield _together(out, names)
                    out, held = [], 0
            if out:
                yield _together(out, names)

    bound_batches()
    kind = frames.schema["dyad"].dataType.simpleString()
    return found.mapInArrow(resample, f"dyad {kind}, side int, i long, t double, v double")


def resample_nearest(grid: DataFrame, frames: DataFrame, column: str = "presence", bucket: float = BUCKET_S, hz: float | None = None) -> DataFrame:
    """(dyad, side, i, t, v): the value of the nearest frame, of two equally near the earlier; missing stays null.

    grid: points as of common_grid() or, with hz, spans(), whose points are made where the frames lie.
    """
    return _resampled(grid, frames, bucket, _frame(column), hz, False)


def resample_linear(grid: DataFrame, frames: DataFrame, column: str = "intensity", bucket: float = BUCKET_S, hz: float | None = None) -> DataFrame:
    """(dyad, side, i, t, v): linear between the frames with a value; beyond the first or last of them, its value. grid: as for resample_nearest()."""
    return _resampled(grid, frames.where(F.col(column).isNotNull()), bucket, _frame(column), hz, True)


def _met(turns: DataFrame, frames: DataFrame, hz: float, bucket: float, min_turn_s: float | None = None, smiles: bool = False) -> DataFrame:
    """(dyad, turn_index, n, k, at): a turn's points on the common grid, both ends included, and how many find both smiling (smiles);
    at, with min_turn_s: its parts by bucket, array<struct<i, p, q>>, of participant and interviewer, linear, of turns as long as that.

    Frames and turns are dealt by (dyad, bucket). Points are made there, from the frames of a bucket, and leave it as arrays: one row for each turn and
    bucket, bounded by both. No row is made for a point. By hint no turn is broadcast: the size that Spark reckons with is that before they are listed by bucket.
    """
    values = {}
    if smiles:
        values["near"] = F.struct(F.col("ts").alias("t"), F.when(F.coalesce(F.col("presence") >= 0.5, F.lit(False)), 1.0).otherwise(0.0).alias("v"))
    if min_turn_s is not None:
        values["line"] = F.when(F.col("intensity").isNotNull(), _frame("intensity"))
    found = _dealt(_places(spans(frames, hz), hz, bucket), frames, bucket, **values)
    first, last = F.floor(F.col("start_s") / bucket), F.floor(F.col("end_s") / bucket)
    listed = turns.select("dyad", F.explode(F.sequence(first, F.greatest(first, last))).alias("bucket"), F.struct("turn_index", F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s")).alias("turn"))
    listed = listed.repartition("dyad", "bucket").groupBy("dyad", "bucket").agg(F.collect_list("turn").alias("turns"))
    names, wanted = ["dyad", "turn_index", "n", "k", "i", "p", "q"], set(values)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, line = ([_Lists(batch.column(f"{n}_{s}")) for s in (0, 1)] if n in wanted else [] for n in ("near", "line"))
            t0s, lasts, buckets = (batch.column(c).to_numpy() for c in ("t0", "last", "bucket"))
            dyads, lists = batch.column("dyad"), batch.column("turns")
            to, each = lists.offsets.to_numpy(), lists.values
            starts, ends = (each.field(c).to_numpy() for c in ("start_s", "end_s"))
            out, held = [], 0

            def told(out: list[tuple], dyads: pa.Array = dyads, each: pa.StructArray = each) -> pa.RecordBatch:
                row, turn, n, k, i, p, q = zip(*out, strict=True)
                sides = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in side])]).astype("int32")), pa.array(np.concatenate(side))) for side in (p, q)]
                return pa.RecordBatch.from_arrays([dyads.take(pa.array(row)), each.field("turn_index").take(pa.array(turn)), pa.array(n, "int64"), pa.array(k, "int64"), pa.array(i, "int64"), *sides], names)

            for row in range(batch.num_rows):
                i, t = _points_in(float(t0s[row]), int(lasts[row]), hz, int(buckets[row]), bucket)
                if not len(t):
                    continue
                if near:
                    both = np.ones(len(t), bool)
                    for side in near:
                        at = side.nearest(row, t)
                        both &= (at >= 0) & (side.values[at] > 0) if len(side.values) else False
                    both = np.concatenate([[0], np.cumsum(both)])
                p, q = (side.linear(row, t) for side in line) if line else (t[:0], t[:0])
                for turn in range(to[row], to[row + 1]):
                    a, b = np.searchsorted(t, starts[turn], "left"), np.searchsorted(t, ends[turn], "right")
                    if b <= a:
                        continue
                    long = bool(line) and ends[turn] - starts[turn] >= min_turn_s
                    out.append((row, turn, b - a, both[b] - both[a] if near else 0, i + a, p[a:b] if long else p[:0], q[a:b] if long else q[:0]))
                    held += b - a if long else 1
                    if held > POINTS:
                        yield told(out)
                        out, held = [], 0
            if out:
                yield told(out)

    bound_batches()
    kinds = turns.schema["dyad"].dataType.simpleString(), turns.schema["turn_index"].dataType.simpleString()
    parts = found.join(listed.hint("shuffle_hash"), ["dyad", "bucket"]).mapInArrow(cut, f"dyad {kinds[0]}, turn_index {kinds[1]}, n long, k long, i long, p array<double>, q array<double>")
    at = [F.array_sort(F.collect_list(F.when(F.size("p") > 0, F.struct("i", "p", "q")))).alias("at")] if min_turn_s is not None else []
    return parts.groupBy("dyad", "turn_index").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), *at)


def _beside(turns: DataFrame, told: DataFrame) -> DataFrame:
    """turns left-joined with what is told of them. By hint it is a merge: a filter behind it may turn it round and broadcast turns, by their size before they are listed."""
    return turns.hint("merge").join(told, ["dyad", "turn_index"], "left")


def _shared(n: Column, k: Column, min_frames: int) -> list[Column]:
    enough = n >= max(3, min_frames)
    return [F.when(enough, k).otherwise(0).cast("long").alias("simul_smile_frames"), n.alias("simul_smile_n_frames"), F.when(enough, k / n).alias("simul_smile_freq")]


def simul_smile(turns: DataFrame, frames: DataFrame, hz: float = HZ, min_frames: int = MIN_FRAMES, bucket: float = BUCKET_S) -> DataFrame:
    """turns with simul_smile_frames, simul_smile_n_frames, simul_smile_freq on the common grid, both ends included.

    A missing presence is not a smile, but its point counts. Fewer than max(3, min_frames) points: 0 frames, n
    kept, no share.
    """
    key = ["dyad", "turn_index"]
    out = _beside(turns, _met(turns.select(*key, "start_s", "end_s"), frames, hz, bucket, smiles=True))
    n, k = (F.coalesce(c, F.lit(0)).cast("long") for c in ("n", "k"))
    return out.select(*turns.columns, *_shared(n, k, min_frames))


def lag_scan(p: np.ndarray, q: np.ndarray, most: int, flat: float = 1e-12) -> tuple[float | None, int | None, float | None]:
    """(r at lag 0, lag of the largest |r|, r there) over lags of up to `most` points, p against q that many points later.

    A lag with fewer than 3 points where both have a value, or a flat side, has no r. Sizes are compared to 12
    places; of equal ones the smallest lag counts.
    """
    zero, best, size = None, None, -1.0
    for k in range(-most, most + 1):
        x, y = p[max(0, -k) : len(p) - max(0, k)], q[max(0, k) : len(q) - max(0, -k)]
        both = np.isfinite(x) & np.isfinite(y)
        if not both.all():
            x, y = x[both], y[both]
        if len(x) < 3:
            continue
        x, y = x - x.mean(), y - y.mean()
        sx, sy = float(np.sqrt(x @ x / len(x))), float(np.sqrt(y @ y / len(y)))
        if sx < flat or sy < flat:
            continue
        r = float(x @ y) / len(x) / (sx * sy)
        zero = r if k == 0 else zero
        if round(abs(r), 12) > size:
            best, size = (k, r), round(abs(r), 12)
    return zero, *(best or (None, None))


def _scanned(at: str, most: int, least: int) -> Column:
    """struct<cc_r, k, r> of a turn's parts as _met() gathers them."""

    def scan(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ps, qs in batches:
            found = [(None, None, None) if len(p) < least else lag_scan(np.array(p, float), np.array(q, float), min(most, len(p) - 3)) for p, q in zip(ps, qs, strict=True)]
            yield pd.DataFrame({"cc_r": pd.Series([f[0] for f in found], dtype="Float64"), "k": pd.Series([f[1] for f in found], dtype="Int64"), "r": pd.Series([f[2] for f in found], dtype="Float64")})

    reachable()
    return F.pandas_udf(scan, "cc_r double, k long, r double")(F.flatten(F.col(f"{at}.p")), F.flatten(F.col(f"{at}.q")))


def cross_lag(
    turns: DataFrame, frames: DataFrame, hz: float = HZ, max_lag_s: float = MAX_LAG_S, min_turn_s: float = MIN_TURN_S,
    min_frames: int = MIN_FRAMES, bucket: float = BUCKET_S,
) -> DataFrame:
    """turns with cc_r (lag 0), cc_r_peak (the signed r of the largest size), peak_lag_s, n_frames.

    Lags up to K = max(0, min(round(max_lag_s * hz), n - 3)) points; of equal sizes the smallest lag; a positive lag
    says that the participant leads. Turns that are short, or have few points, keep n_frames only. A turn's points are
    gathered once, as one array bounded by the turn's length, and all its lags are slices of that: no row for each lag or point.
    """
    key = ["dyad", "turn_index"]
    met = _met(turns.select(*key, "start_s", "end_s"), frames, hz, bucket, min_turn_s)
    peak = met.select(*key, F.col("n").alias("n_frames"), _scanned("at", round(max_lag_s * hz), max(3, min_frames)).alias("f"))
    peak = peak.select(*key, "n_frames", "f.cc_r", (F.col("f.k") / hz).alias("peak_lag_s"), F.col("f.r").alias("cc_r_peak"))
    out = _beside(turns, peak)
    return out.select(*turns.columns, "cc_r", "peak_lag_s", "cc_r_peak", F.coalesce("n_frames", F.lit(0)).cast("long").alias("n_frames"))


def synchrony(
    turns: DataFrame, frames: DataFrame, hz: float = HZ, max_lag_s: float = MAX_LAG_S, min_turn_s: float = MIN_TURN_S,
    min_frames: int = MIN_FRAMES, bucket: float = BUCKET_S,
) -> DataFrame:
    """The synchrony table, as sync_turns() of cross_lag() and simul_smile() gives it, from one resampling of both measures.

    Frames are shuffled once, by (dyad, bucket); both resamplings stay there, and turns meet their points once.
    """
    key = ["dyad", "turn_index"]
    met = _met(turns.select(*key, "start_s", "end_s"), frames, hz, bucket, min_turn_s, smiles=True)
    told = met.select(*key, "n", "k", _scanned("at", round(max_lag_s * hz), max(3, min_frames)).alias("f"))
    told = told.select(
        *key, F.col("n").alias("n_frames"), "f.cc_r", (F.col("f.k") / hz).alias("peak_lag_s"), F.col("f.r").alias("cc_r_peak"),
        *_shared(F.col("n"), F.col("k"), min_frames),
    )
    return _table(_beside(turns, told))


def sync_turns(turns: DataFrame, cc: DataFrame, ss: DataFrame) -> DataFrame:
    """The synchrony table: one row for each turn, whichever measures it has."""
    key = ["dyad", "turn_index"]
    out = turns.join(cc.select(*key, "cc_r", "peak_lag_s", "cc_r_peak", "n_frames"), key, "left")
    return _table(out.join(ss.select(*key, "simul_smile_frames", "simul_smile_n_frames", "simul_smile_freq"), key, "left"))


def _table(out: DataFrame) -> DataFrame:
    return out.select(
        F.col("dyad").alias("participant_id"), F.col("interviewer").alias("interviewer_id"), "turn_index", F.lower(F.trim("sentiment")).alias("sentiment"),
        F.round(F.col("end_s") - F.col("start_s"), 3).alias("duration_s"), F.coalesce("n_frames", F.lit(0)).alias("n_frames"),
        F.lit("synchrony").alias("level"), F.lit("duchenne_smile").alias("au"), "cc_r", "peak_lag_s", "cc_r_peak",
        F.coalesce("simul_smile_frames", F.lit(0)).alias("simul_smile_frames"), F.coalesce("simul_smile_n_frames", F.lit(0)).alias("simul_smile_n_frames"), "simul_smile_freq",
    )
