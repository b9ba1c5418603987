import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from rollcast.operators.series import (
    SeriesLayout,
    _late_rows,
    cut_table,
    grid_layout,
    measure_series,
    training_runs,
    with_rank_from_end,
)
from rollcast.operators.windows import (
    cv_folds,
    holdout_split,
    inference_frame,
    lag_windows,
    last_n,
)
from conftest import PANEL, at, make_panel, rows


@pytest.fixture(scope="module")
def skewed(spark):
    """One series with most rows, crowded at one end; a medium one; many short ones."""
    draw = random.Random(3)
    points = sorted({draw.randrange(50) for _ in range(40)} | set(range(5000, 5600)))
    data = [(0, at(i), float(draw.randrange(1000))) for i in points]
    data += [(1, at(7 * i), float(draw.randrange(1000))) for i in range(150)]
    data += [(uid, at(i), float(draw.randrange(1000))) for uid in range(2, 30) for i in range(uid)]
    draw.shuffle(data)
    return spark.createDataFrame(data, "unique_id bigint, ds timestamp_ntz, y double").repartition(4)


@pytest.fixture(scope="module")
def cut(skewed):
    return measure_series(skewed, piece_rows=32)


@pytest.fixture(scope="module")
def whole(skewed):
    return measure_series(skewed)


def sizes(panel):
    return {r["unique_id"]: r["count"] for r in panel.groupBy("unique_id").count().collect()}


def test_small_panels_are_not_cut(whole, skewed):
    assert not whole.is_cut()
    assert whole.rows == skewed.count() and whole.largest == max(sizes(skewed).values())


def test_buckets_count_every_row(cut, skewed):
    assert {r["unique_id"]: r["n"] for r in cut.buckets.groupBy("unique_id").agg(F.sum("n").alias("n")).collect()} == sizes(skewed)
    for row in cut.buckets.collect():
        earlier = [b for b in cut.buckets.where(f"unique_id = {row['unique_id']}").collect() if b["start"] > row["start"]]
        assert row["after"] == sum(b["n"] for b in earlier)
        break


@pytest.mark.parametrize("spacing", [timedelta(seconds=1), timedelta(minutes=5), timedelta(days=400)])
def test_pieces_are_bounded_and_cover_the_series(skewed, spacing):
    layout = measure_series(skewed, piece_rows=32, spacing=spacing)
    pieces = cut_table(layout, 32).select("unique_id", "__piece", "__after", "__own").distinct().collect()
    large = {u: n for u, n in sizes(skewed).items() if n > 32}
    assert {r["unique_id"] for r in pieces} == set(large)
    for uid, n in large.items():
        own = sorted((r["__piece"], r["__after"], r["__own"]) for r in pieces if r["unique_id"] == uid)
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert sum(rows_ for _, _, rows_ in own) == n
        assert all(a + o == b for (_, a, o), (_, b, _) in zip(own, own[1:]))
        assert max(o for _, _, o in own) <= 32 + 32 // 4


def test_pieces_do_not_grow_with_the_table(spark):
    """Ten times the rows: ten times the pieces, none of them larger."""
    found = []
    for factor in (1, 10):
        panel = make_panel(spark, {1: range(600 * factor), 2: range(40)})
        layout = measure_series(panel, piece_rows=64)
        pieces = cut_table(layout, 64).select("unique_id", "__piece", "__own").distinct()
        found.append(pieces.agg(F.count("*"), F.max("__own")).first())
    assert found[1][0] >= 9 * found[0][0] and max(found[0][1], found[1][1]) <= 80


def test_full_buckets_are_counted_again(spark):
    """A crowd of rows within a second, in a series that is sparse elsewhere."""
    dense = [(1, at(0) + timedelta(microseconds=37 * i), float(i)) for i in range(500)]
    panel = spark.createDataFrame(dense + [(1, at(10_000 * i), 0.0) for i in range(1, 20)], PANEL)
    layout = measure_series(panel, piece_rows=16, spacing=timedelta(days=1))
    assert len(layout.shifts) > 2
    assert layout.buckets.agg(F.max("n")).first()[0] <= 4
    plain = SeriesLayout(layout.rows, layout.largest, layout.piece_rows)
    assert rows(with_rank_from_end(panel, layout)) == rows(with_rank_from_end(panel, plain))
    options = {"input_size": 5, "horizon": 2}
    assert rows(lag_windows(panel, layout=layout, **options)) == rows(lag_windows(panel, layout=plain, **options))


def test_null_ids_and_times(spark):
    """A NULL id is a series; NULL times are the oldest rows of theirs."""
    draw = random.Random(5)
    data = [(None, at(i), float(i)) for i in range(90)] + [(1, None, float(i)) for i in range(30)]
    data += [(1, at(i), float(i)) for i in range(60)] + [(2, None, float(i)) for i in range(50)] + [(None, None, -1.0)]
    draw.shuffle(data)
    panel = spark.createDataFrame(data, PANEL)
    cut, plain = measure_series(panel, piece_rows=8), SeriesLayout(231, 91, 1_000_000)
    assert cut.is_cut() and cut.rows == 231 and cut.largest == 91
    ranked = {(r["unique_id"], r["ds"], r["y"]): r["rank_from_end"] for r in with_rank_from_end(panel, cut).collect()}
    expected = {}
    for uid in (None, 1, 2):
        own = sorted((r for r in data if r[0] == uid), key=lambda r: (r[1] is not None, r[1] or at(0), r[2]), reverse=True)
        expected |= {r: i for i, r in enumerate(own, 1)}
    assert ranked == expected
    for operator in (
        lambda lay: last_n(panel, 20, lay), lambda lay: holdout_split(panel, 12, lay),
        lambda lay: inference_frame(panel, horizon=4, input_size=10, plot_points=20, layout=lay),
        lambda lay: lag_windows(panel, input_size=5, horizon=2, layout=lay),
    ):
        assert rows(operator(cut)) == rows(operator(plain))


@pytest.mark.parametrize("ids, times", [((None,), (0, 1, 2)), ((1, None), (None,)), ((None,), (None,))])
def test_only_nulls(spark, ids, times):
    data = [(i, None if t is None else at(t), float(k)) for i in ids for t in times for k in range(20)]
    panel = spark.createDataFrame(data, PANEL)
    layout = measure_series(panel, piece_rows=4)
    assert layout.is_cut()
    found = with_rank_from_end(panel, layout).groupBy("unique_id").agg(F.sort_array(F.collect_list("rank_from_end")).alias("r"))
    assert all(r["r"] == list(range(1, 20 * len(times) + 1)) for r in found.collect())


def test_empty_panels(spark):
    layout = measure_series(make_panel(spark, {1: [1]}).where("false"))
    assert (layout.rows, layout.largest, layout.is_cut()) == (0, 0, False)


def test_ranks_are_exact_when_cut(skewed, cut, whole):
    assert rows(with_rank_from_end(skewed, cut)) == rows(with_rank_from_end(skewed, whole))


@pytest.mark.parametrize(
    "operator",
    [
        lambda p, lay: last_n(p, 40, lay),
        lambda p, lay: last_n(p, 5, lay),
        lambda p, lay: with_rank_from_end(p, lay, last=45),
        lambda p, lay: holdout_split(p, 12, lay),
        lambda p, lay: inference_frame(p, horizon=4, input_size=10, plot_points=20, layout=lay),
        lambda p, lay: cv_folds(p, horizon=4, n_windows=3, step=2, input_size=9, layout=lay),
        lambda p, lay: lag_windows(p, input_size=9, horizon=4, layout=lay),
        lambda p, lay: lag_windows(p, input_size=30, horizon=20, hold_out=8, layout=lay),
    ],
)
def test_cutting_changes_no_result(skewed, cut, whole, operator):
    expected = rows(operator(skewed, whole))
    assert expected and rows(operator(skewed, cut)) == expected


def test_every_window_lies_in_exactly_one_run(skewed, cut):
    runs, keys = training_runs(skewed, 10, cut, hold_out=3)
    assert keys == ["unique_id", "run"]
    per_run = runs.groupBy("unique_id", "run").agg(
        F.count("*").alias("n"), F.sum(F.col("first_of_run").cast("int")).alias("starts")
    )
    collected = per_run.collect()
    assert all(r["starts"] == 1 and r["n"] <= cut.piece_rows * 5 // 4 + 9 for r in collected)
    windows: dict = {}
    assert len(collected) > 30 + 20
    for r in collected:
        windows[r["unique_id"]] = windows.get(r["unique_id"], 0) + max(0, r["n"] - 9)
    counts = {r["unique_id"]: r["count"] for r in skewed.groupBy("unique_id").count().collect()}
    assert {u: n for u, n in windows.items() if n} == {u: n - 12 for u, n in counts.items() if n > 12}


def test_results_do_not_depend_on_partitions(spark, skewed, cut):
    def run():
        return rows(lag_windows(skewed, input_size=6, horizon=2, layout=cut))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    expected = run()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert run() == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def jobs_of(spark, work):
    """Runs ``work`` and counts the Spark jobs it starts."""
    tracker, group = spark.sparkContext.statusTracker(), f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        result = work()
        return result, len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_last_rows_are_limited_before_the_shuffle(spark):
    panel = make_panel(spark, {1: range(10), 2: range(5)})
    frame, jobs = jobs_of(spark, lambda: last_n(panel, 1000))
    assert jobs == 0 and "row_number(), 1000, Partial" in plan_of(frame)


def test_long_tails_are_filtered_before_the_sort(spark):
    """Beyond what Spark limits itself: a filter by time, then ranks of the tail only."""
    panel = make_panel(spark, {1: range(5000), 2: range(300), 3: range(1200)})
    for n in (1000, 1001, 2000):
        layout = measure_series(panel, piece_rows=256)
        frame = last_n(panel, n, layout)
        expected = {1: n, 2: 300, 3: min(n, 1200)}
        assert sizes(frame) == expected
        assert {r[0]: r[1] for r in frame.groupBy("unique_id").agg(F.min("y")).collect()} == {1: 5000 - n, 2: 0, 3: 1200 - expected[3]}
    late = _late_rows(panel, measure_series(panel, piece_rows=256), 1001)
    # The rows asked for and at most one bucket.
    assert sizes(late)[1] <= 1001 + 64 and sizes(late)[2] == 300
    plan = plan_of(late)
    assert "BroadcastHashJoin" in plan and "Sort" not in plan


def test_ties_in_holdout(spark):
    """Rows of one time: ordered by target, then by a hash; equal rows stay together."""
    data = [(1, at(0), float(i)) for i in range(6)] + [(2, at(0), 1.0)] * 4 + [(2, at(1), 2.0)]
    panel = spark.createDataFrame(data, PANEL)
    tagged = holdout_split(panel, 2)
    assert sorted(r["y"] for r in tagged.where("unique_id = 1 AND role = 'holdout'").collect()) == [4.0, 5.0]
    assert tagged.where("unique_id = 2 AND role = 'holdout'").count() == 5
    assert holdout_split(panel, 0).where("role = 'holdout'").count() == 0


def test_holdout_sorts_tails_only(spark, skewed):
    """No window over whole series: the only window has a group limit."""
    for frame in (holdout_split(skewed, 12), inference_frame(skewed, horizon=4, input_size=10, plot_points=20)):
        plan = plan_of(frame)
        assert plan.count("Window [") == 1 and "WindowGroupLimit" in plan


def test_a_grid_bounds_the_series():
    day = timedelta(days=1)
    layout = grid_layout(at(0), at(0) + 9 * day, day)
    assert layout.largest == 10 and not layout.is_cut()
    assert grid_layout(at(0), at(0) + 9 * day, day, piece_rows=9) is None
    assert grid_layout(at(0), at(0) + 9 * day, timedelta(microseconds=1)) is None


def test_ranks_of_cut_series_take_one_shuffle(skewed, cut):
    for frame in (with_rank_from_end(skewed, cut), training_runs(skewed, 5, cut)[0]):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        # The fixture is spread round-robin; ranking adds one exchange by series and piece.
        assert plan.count("Exchange hashpartitioning") == 1


def test_pieces_need_rows(spark):
    with pytest.raises(ValueError):
        measure_series(make_panel(spark, {1: [1]}), piece_rows=0)


def test_text_ids(spark):
    panel = make_panel(spark, {"a": range(100), "b": range(5)}, "unique_id string, ds timestamp_ntz, y double")
    layout = measure_series(panel, piece_rows=10)
    assert {r["unique_id"] for r in cut_table(layout, 10).collect()} == {"a"}
    assert rows(last_n(panel, 2, layout), "unique_id", "y") == [("a", 98.0), ("a", 99.0), ("b", 3.0), ("b", 4.0)]
