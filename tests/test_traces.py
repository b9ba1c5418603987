from rollcast.operators.traces import comparison_traces, dashboard_traces, prediction_traces
from conftest import at, make_panel, rows

PREDICTIONS = "model string, unique_id string, ds timestamp_ntz, y_hat double"
TEXT_PANEL = "unique_id string, ds timestamp_ntz, y double"


def chart_panel(spark, uid="seq_1"):
    return make_panel(spark, {uid: range(100, 200)}, TEXT_PANEL)


def forecasts(spark, model, shift, uid="seq_1", value=True):
    data = [(model, uid, at(i), float(100 + i + shift) if value else None) for i in range(80, 100)]
    return spark.createDataFrame(data, PREDICTIONS)


def counts(frame):
    return dict(rows(frame.groupBy("trace").count()))


def test_actual_and_predicted(spark):
    traces = prediction_traces(chart_panel(spark), forecasts(spark, "TestModel", -2), "TestModel")
    assert counts(traces) == {"Actual": 100, "Predicted": 20}
    assert traces.columns == ["unique_id", "ds", "trace", "value", "tick"]
    actual = traces.where("trace = 'Actual'").orderBy("ds").collect()
    assert [r["tick"] for r in actual[:2]] == ["2024-01-01 00:00:00", "2024-01-01 00:05:00"]
    assert len({r["tick"] for r in actual}) == 100


def test_first_series_only(spark):
    panel = make_panel(spark, {c: range(5) for c in "edcba"}, TEXT_PANEL)
    data = [("M", c, at(4), 1.0) for c in "edcb"]
    traces = prediction_traces(panel, spark.createDataFrame(data, PREDICTIONS), "M", max_series=2)
    assert {r["unique_id"] for r in traces.collect()} == {"b", "c"}


def test_models_without_forecasts_are_left_out(spark):
    both = forecasts(spark, "Model1", 0, value=False).unionByName(forecasts(spark, "Model2", 0))
    traces = comparison_traces(chart_panel(spark), both, "seq_1")
    assert counts(traces) == {"Actual": 100, "Model2": 20}
    filled = forecasts(spark, "Model1", -2).unionByName(forecasts(spark, "Model2", 0))
    assert counts(comparison_traces(chart_panel(spark), filled, "seq_1")) == {
        "Actual": 100, "Model1": 20, "Model2": 20}
    assert counts(comparison_traces(chart_panel(spark), filled, "seq_1", models=["Model1"])) == {
        "Actual": 100, "Model1": 20}


def test_nothing_to_compare_gives_no_rows(spark):
    panel, predictions = chart_panel(spark), forecasts(spark, "M", 0)
    assert comparison_traces(panel, predictions, "seq_2").count() == 0
    assert comparison_traces(panel, forecasts(spark, "M", 0, value=False), "seq_1").count() == 0
    metrics = spark.createDataFrame([("M", "seq_1", "mae", 50.0)], "model string, unique_id string, metric string, value double")
    assert comparison_traces(panel, predictions, "seq_1", metrics=metrics, max_mae=40.0).count() == 0
    assert counts(comparison_traces(panel, predictions, "seq_1", metrics=metrics, max_mae=60.0)) == {
        "Actual": 100, "M": 20}


def test_dashboard_numbers_series_and_models(spark):
    panel = make_panel(spark, {c: range(3) for c in "dcba"}, TEXT_PANEL)
    data = [(m, c, at(3), 1.0) for m in ("Y", "X") for c in "abcd"]
    predictions = spark.createDataFrame(data, PREDICTIONS)
    board = dashboard_traces(panel, predictions, max_series=2)
    found = set(rows(board.select("unique_id", "trace", "panel_no", "model_no").distinct()))
    assert found == {("a", "Actual", 1, None), ("a", "X", 1, 0), ("a", "Y", 1, 1),
                     ("b", "Actual", 2, None), ("b", "X", 2, 0), ("b", "Y", 2, 1)}
    chosen = dashboard_traces(panel, predictions, ids=["d", "a"])
    assert set(rows(chosen.select("unique_id", "panel_no").distinct())) == {("d", 1), ("a", 2)}
