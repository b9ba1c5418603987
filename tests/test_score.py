import math

import pytest

from rollcast.operators.score import (
    leaderboard,
    leaderboard_by_metric,
    leaderboard_means,
    leaderboard_wide,
    metrics_wide,
    model_names,
    model_ranking,
    predictions_wide,
    reshape_summary,
    score,
    wide_to_long,
)
from conftest import at, rows

CV = "model string, unique_id string, ds timestamp_ntz, cutoff timestamp_ntz, y double, y_hat double"
METRICS = "model string, unique_id bigint, metric string, value double"


def forecasts(spark, pairs, model="M", uid="seq_1"):
    data = [(model, uid, at(i), at(0), y, y_hat) for i, (y, y_hat) in enumerate(pairs)]
    return spark.createDataFrame(data, CV)


def scored(frame, **options):
    return {r["metric"]: r["value"] for r in score(frame, **options).collect()}


def test_constant_error(spark):
    pairs = [(float(v), float(v - 2)) for v in range(180, 200)]
    result = score(forecasts(spark, pairs, "TestModel"))
    values = {r["metric"]: r["value"] for r in result.collect()}
    assert (values["mae"], values["mse"], values["rmse"]) == (2.0, 4.0, 2.0)
    assert values["mape"] == pytest.approx(sum(2 / v * 100 for v in range(180, 200)) / 20)
    assert {r["n_scored"] for r in result.collect()} == {20}


def test_percentage_with_zero_targets(spark):
    assert math.isinf(scored(forecasts(spark, [(0.0, 1.0), (2.0, 1.0)]))["mape"])
    assert math.isnan(scored(forecasts(spark, [(0.0, 0.0), (2.0, 1.0)]))["mape"])
    assert scored(forecasts(spark, [(0.0, 1.0), (2.0, 1.0)]), mape="fraction")["mape"] == 0.5
    assert scored(forecasts(spark, [(0.0, 1.0)]), mape="fraction")["mape"] is None
    assert scored(forecasts(spark, [(-4.0, -2.0)]))["mape"] == 50.0
    with pytest.raises(ValueError):
        score(forecasts(spark, []), mape="ratio")


def test_missing_forecasts_are_skipped(spark):
    result = score(forecasts(spark, [(1.0, None), (1.0, float("nan")), (5.0, 2.0)]))
    values = {r["metric"]: (r["value"], r["n_scored"]) for r in result.collect()}
    assert values["mae"] == (3.0, 1) and values["mape"] == (60.0, 1)
    nothing = score(forecasts(spark, [(1.0, None)]))
    assert {(r["value"], r["n_scored"]) for r in nothing.collect()} == {(None, 0)}


def test_no_shuffle_is_added_after_series_are_grouped(spark):
    """Scores of forecasts that are already grouped by series need no exchange."""
    from rollcast.operators.forecast import Naive, cross_validate
    from rollcast.operators.series import measure_series
    from conftest import make_panel

    panel = make_panel(spark, {1: range(30), 2: range(30)})
    cv = cross_validate(panel, [Naive()], horizon=2, input_size=4, layout=measure_series(panel))
    for frame in (score(cv), metrics_wide(score(cv), ["Naive"]), predictions_wide(cv, ["Naive"])):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1


@pytest.fixture
def metrics(spark):
    data = [
        ("A", 1, "mae", 1.0), ("A", 2, "mae", 3.0), ("A", 1, "rmse", 2.0), ("A", 2, "rmse", 2.0),
        ("B", 1, "mae", 1.5), ("B", 1, "rmse", 9.0), ("B", 2, "mae", None),
    ]
    return spark.createDataFrame(data, METRICS)


def test_leaderboard(metrics):
    board = {(r["model"], r["metric"]): (r["mean"], r["std"], r["n_series"]) for r in leaderboard(metrics).collect()}
    assert board[("A", "mae")] == (2.0, pytest.approx(math.sqrt(2)), 2)
    assert board[("A", "rmse")] == (2.0, 0.0, 2)
    # One series: no sample standard deviation. A NULL score does not count.
    assert board[("B", "mae")] == (1.5, None, 1)


def test_layouts(spark, metrics):
    summary = leaderboard(metrics)
    wide = leaderboard_wide(summary, ["mae", "rmse"])
    assert wide.columns == ["model", "MAE_mean", "MAE_std", "RMSE_mean", "RMSE_std"]
    assert [r["model"] for r in wide.collect()] == ["B", "A"]
    means = leaderboard_means(summary, ["rmse", "mae"])
    assert [tuple(r) for r in means.collect()] == [("B", 1.5, 9.0), ("A", 2.0, 2.0)]
    assert means.columns == ["model", "mae", "rmse"]
    by_metric = leaderboard_by_metric(summary)
    assert by_metric.columns == ["metric", "A_mean", "A_std", "B_mean", "B_std"]
    back = reshape_summary(by_metric, ["mae", "rmse"])
    assert [tuple(r) for r in back.collect()] == [("B", 1.5, 9.0), ("A", 2.0, 2.0)]
    assert [tuple(r) for r in model_ranking(by_metric).collect()] == [("B", 1.5), ("A", 2.0)]
    assert leaderboard_means(summary, ["rmse"]).columns == ["model", "rmse"]


def test_missing_scores_sort_first(spark):
    data = [("A", "mae", 2.0, 0.0), ("B", "mae", None, None), ("C", "mae", 1.0, 0.0), ("D", "mae", 1.0, 0.0)]
    summary = spark.createDataFrame(data, "model string, metric string, mean double, std double")
    assert [r["model"] for r in leaderboard_means(summary, ["mae"]).collect()] == ["B", "C", "D", "A"]


def test_wide_metrics_keep_gaps_and_go_back(metrics):
    wide = metrics_wide(metrics)
    assert rows(wide, "unique_id", "metric", "A", "B") == [
        (1, "mae", 1.0, 1.5), (1, "rmse", 2.0, 9.0), (2, "mae", 3.0, None), (2, "rmse", 2.0, None),
    ]
    long = wide_to_long(wide, ["unique_id", "metric"])
    assert long.columns == ["unique_id", "metric", "model", "value"]
    assert long.where("value is not null").count() == 6


def test_wide_to_long_takes_numeric_columns_only(spark):
    wide = spark.createDataFrame([(1, "note", 2, 3.5)], "unique_id bigint, text string, A int, `B.1` double")
    assert rows(wide_to_long(wide, ["unique_id"])) == [(1, "A", 2.0), (1, "B.1", 3.5)]


def test_wide_predictions(spark):
    data = [("A", 1, at(0), 1.0), ("A", 1, at(1), 2.0), ("B", 1, at(1), 3.0), ("B", 2, at(0), 4.0)]
    frame = spark.createDataFrame(data, "model string, unique_id bigint, ds timestamp_ntz, y_hat double")
    assert model_names(frame) == ["A", "B"]
    assert rows(predictions_wide(frame), "unique_id", "ds", "A", "B") == [
        (1, at(0), 1.0, None), (1, at(1), 2.0, 3.0), (2, at(0), None, 4.0),
    ]


def test_states_merge(spark):
    """States of parts give the scores and the leaderboard of the whole, empty parts included."""
    from rollcast.operators.score import board_of_state, board_state, merge_boards, merge_states, score_state, state_metrics

    data = [("A", u, at(i), float(y), f) for u in range(5) for i, (y, f) in enumerate([(0, 1.0), (2, None), (1e9 + u, 1e9), (3, float("nan"))])]
    data += [("B", 1, at(0), 1.0, None)]
    forecasts = spark.createDataFrame(data, "model string, unique_id bigint, ds timestamp_ntz, y double, y_hat double")
    for mape in ("percent", "fraction"):
        whole = score(forecasts, mape=mape)
        parts = [score_state(forecasts.where(c), mape=mape) for c in ("ds = '2024-01-01'", "ds > '2024-01-01'", "false")]
        assert rows(state_metrics(merge_states(*parts))) == rows(whole)
        boards = [board_state(whole.where(c)) for c in ("unique_id < 2", "unique_id >= 2", "false")]
        merged = {(r["model"], r["metric"]): r for r in board_of_state(merge_boards(*boards)).collect()}
        expected = leaderboard(whole).collect()
        assert len(merged) == len(expected)
        for r in expected:
            found = merged[r["model"], r["metric"]]
            assert found["n_series"] == r["n_series"]
            for name in ("mean", "std"):
                assert found[name] == r[name] or found[name] == pytest.approx(r[name], nan_ok=True)
