"""Work and memory that grow no faster than the input."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators import blocks, crossed, dyad, models
from turnloom.plans import queries as plans

FRAME = "dyad bigint, side int, ts double, intensity double, presence double"
TURNS = "dyad bigint, interviewer bigint, turn_index int, sentiment string, start_s double, end_s double"


@pytest.mark.parametrize("measure", [dyad.cross_lag, dyad.simul_smile, dyad.synchrony])
def test_no_row_for_a_point(spark, measure):
    """The grid is not written out, neither before a shuffle (in as many tasks as there are of short rows of spans) nor behind it."""
    f = spark.createDataFrame([(1, s, float(t), 1.0, 1.0) for s in (0, 1) for t in (0, 9)], FRAME)
    turns = spark.createDataFrame([(1, 0, 0, "neutral", 0.0, 9.0)], TURNS)
    plan = measure(turns, f, hz=1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0" not in plan and "last" in plan


@pytest.mark.parametrize("name", ["simul_smile", "sync_turns", "synchrony_descriptives", "cross_lag", "cross_lag_peak", "coverage"])
def test_queries_make_no_row_for_a_point(spark, tmp_path, name):
    """No query writes the grid out; edges of buckets are aggregated by hash, without a sort."""
    rows = [(k, datetime(2024, 1, 1 + 9 * (k // 2)), k % 2, 70.0, '{"k": 30}') for k in range(4)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    plan = plans.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution()
    assert "sequence(0" not in plan.optimizedPlan().toString() and "SortAggregate" not in plan.executedPlan().toString()


@pytest.mark.parametrize("name", ["simul_smile", "sync_turns", "synchrony_descriptives", "cross_lag", "cross_lag_peak", "coverage"])
def test_turns_are_dealt_and_not_broadcast(spark, tmp_path, name):
    """Turns by bucket meet frames where both are dealt: no table of them goes through one task, the driver and every task."""
    rows = [(k, datetime(2024, 1, 1 + 9 * (k // 2)), k % 2, 70.0, '{"k": 30}') for k in range(4)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    plan = plans.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().splitlines()
    joins = [x.partition("Join ")[0].split()[-1] for x in plan if "Join [dyad" in x and ", bucket#" in x]
    assert joins and set(joins) == {"ShuffledHash"}
    beside = [x.partition("Join ")[0].split()[-1] for x in plan if "Join [dyad" in x and ", turn_index#" in x]
    assert beside and set(beside) == {"SortMerge"}
    turns = [k for k, x in enumerate(plan) if "partial_collect_list(turn#" in x]
    assert turns and all("Exchange hashpartitioning(dyad#" in plan[k + 1] and ", bucket#" in plan[k + 1] for k in turns)


def near(own, t):
    """Value of the nearest of (time, value), written out; of two equally near the earlier."""
    return min(own, key=lambda x: (abs(x[0] - t), x[0]))[1]


def test_turns_on_points_that_are_not_rows(spark):
    """Counts, joint smiles and correlation against rows written out; a turn without times stays; few frames for many points."""
    rng = np.random.default_rng(5)
    rows = [(1, s, float(t), float(rng.normal()), float(rng.integers(2)) if rng.random() > 0.2 else None) for s in (0, 1) for t in sorted(rng.uniform(0, 200, 25))]
    f = spark.createDataFrame(rows, FRAME)
    side = lambda s, c: [(r[2], r[c]) for r in rows if r[1] == s and (c == 4 or r[c] is not None)]
    spots = [(3.0, 170.25), (40.0, 90.0), (None, None), (500.0, 600.0)]
    t = spark.createDataFrame([(1, 0, k, "neutral", a, b) for k, (a, b) in enumerate(spots)], TURNS)
    t0, t1 = max(side(0, 4)[0][0], side(1, 4)[0][0]), min(side(0, 4)[-1][0], side(1, 4)[-1][0])
    grid = [t0 + i / 4 for i in range(math.floor((t1 - t0) * 4 + 1e-9) + 1)]
    for bucket in (11.0, 600.0):
        smile = {r.turn_index: r for r in dyad.simul_smile(t, f, 4.0, bucket=bucket).collect()}
        lag = {r.turn_index: r for r in dyad.cross_lag(t, f, 4.0, 0.0, 10.0, bucket=bucket).collect()}
        assert sorted(smile) == sorted(lag) == [0, 1, 2, 3]
        for k, (a, b) in enumerate(spots):
            own = [x for x in grid if a is not None and a <= x <= b]
            both = sum(all((near(side(s, 4), x) or 0) >= 0.5 for s in (0, 1)) for x in own)
            assert (smile[k].simul_smile_n_frames, smile[k].simul_smile_frames, lag[k].n_frames) == (len(own), both, len(own))
            p, q = (np.interp(own, *zip(*side(s, 3), strict=True)) for s in (0, 1))
            assert lag[k].cc_r is None if not own else math.isclose(lag[k].cc_r, np.corrcoef(p, q)[0, 1], rel_tol=1e-9)


def test_resampling_of_spans_is_that_of_points(spark):
    """Missing and NaN values, frames at one time, a partner without values."""
    nan, rng = float("nan"), np.random.default_rng(6)
    one = lambda: [None, nan, float(rng.normal())][min(int(rng.integers(6)), 2)]
    rows = [(d, s, float(t) + 0.5 * (d == 2), None if d == 3 and s else one(), one()) for d in (1, 2, 3) for s in (0, 1) for t in (*range(0, 40, 3), 41)]
    f = spark.createDataFrame(rows, FRAME)
    span, grid = dyad.spans(f, 2.0), dyad.common_grid(f, 2.0)
    for resample in (dyad.resample_nearest, dyad.resample_linear):
        a, b = (x.select("dyad", "side", "i", F.round("t", 9).alias("t"), "v").orderBy("dyad", "side", "i").collect() for x in (resample(span, f, bucket=7.0, hz=2.0), resample(grid, f, bucket=7.0)))
        assert str(a) == str(b)
        if resample is dyad.resample_nearest:
            assert len(a) == 2 * grid.count()
            want = [near([(r[2], r[4]) for r in rows if r[0] == x.dyad and r[1] == x.side], x.t) for x in a]
            assert str([x.v for x in a]) == str(want)
        else:
            assert all(x.v is None for x in a if x.dyad == 3 and x.side == 1) and any(x.v is not None and math.isnan(x.v) for x in a)


def test_a_text_is_split_once(spark):
    """Runs of a long text are cut from its words as they were split once: work grows with the text, not with its square."""
    long = " ".join(f"w{k}" for k in range(100_000))
    texts = spark.createDataFrame([(long,), (" a  b ",), ("",), (None,)], "t string")
    runs = T.split_oversized(F.col("t"), 7)
    assert str(runs).count("split(") == 1
    got = [r[0] for r in texts.select(runs).collect()]
    words = long.split()
    assert got == [[" ".join(words[k : k + 7]) for k in range(0, len(words), 7)], ["a b"], [], []]


@pytest.mark.parametrize("per_row", [True, False])
def test_participants_with_the_same_cells_count_once(spark, monkeypatch, per_row):
    """They are one participant with a number: the same deviances as of all, on the driver and in Spark, from a third of the cells or fewer."""
    rng = np.random.default_rng(9)
    one = [(int(rng.integers(4)), j, ("positive", "negative")[int(rng.integers(2))], int(rng.integers(3)), 4) for j in range(40) for _ in range(4)]
    rows = [(i, j + 100 * c, s, k, n) for c in range(3) for i, j, s, k, n in one]
    k, n = ("succ", "total") if per_row else ("least(succ, 1)", "1")
    rows = spark.createDataFrame(rows, "interviewer_id int, participant_id int, sentiment string, succ int, total int")
    cells = rows.groupBy("interviewer_id", "participant_id", "sentiment", F.expr(k).cast("double").alias("succ"), F.expr(n).cast("double").alias("n")).agg(F.count("*").alias("times")).cache()
    few = crossed.alike(cells, "succ", "n", "times")
    assert 3 * few.count() <= cells.count() and few.select("participant_id", "alike").distinct().agg(F.sum("alike")).first()[0] == 120
    monkeypatch.setattr(blocks, "BLOCK_CELLS", 30)
    points = [np.array(v)[: 5 if per_row else 4] for v in ([-0.5, 0.3, 0.6, 0.5, 0.4], [0.0, 0.0, 0.0, 0.0, 0.0], [2.0, -3.0, 1.5, 2.5, 1.0])]
    want = crossed.Binomial(models.local(cells), per_row).deviances(points)
    table = blocks.BinomialBlocks(blocks.Blocks(few, ("succ", "n", "times", "alike")), blocks.binomial_totals(few), per_row)
    assert np.allclose(want, crossed.Binomial(models.local(few), per_row).deviances(points), rtol=1e-10)
    assert np.allclose(want, table.deviances(points), rtol=1e-10)
    assert np.allclose(want[::-1], table.deviances(points[::-1]), rtol=1e-10)  # modes sought from those of another point
