import numpy as np
import pytest

from rollcast.operators.forecast import (
    LocalForecaster, Naive, SeriesForecaster, WindowAverage, cv_runs, fit_status, run_inference,
)
from rollcast.operators.linear import DLinear, LinearExog, NLinear
from rollcast.operators.score import leaderboard, score
from rollcast.operators.runs import run_list
from rollcast.operators.series import measure_series
from rollcast.plans.backtest import backtest, new_run_id, open_run
from rollcast.plans.predict import choose_models, predict_job, predict_stored
from rollcast.plans.summarize import summarize
from rollcast.sources.generations import read_current
from rollcast.sources.results import export_by_model, load_params, read_metrics, read_summary
from conftest import at, make_panel, rows

SHAPE = {"horizon": 2, "input_size": 4, "n_windows": 2}


@pytest.fixture(scope="module")
def panel(spark):
    draw = np.random.default_rng(1)
    series = {u: 50 + np.cumsum(draw.normal(size=40)) for u in (1, 2)}
    return make_panel(spark, {**series, 3: range(5)})


class Broken(NLinear):
    def features(self, input_size):
        raise RuntimeError("no features")


def test_backtest_goes_on_when_a_model_fails(spark, panel, tmp_path):
    models = [Naive(), NLinear(), DLinear(), Broken(name="Broken"), LocalForecaster("Half", lambda x, h: x[-h:] / 2)]
    run = backtest(panel, models, run_id="run_1", folder=str(tmp_path / "out"), **SHAPE)
    assert rows(run.failures, "model", "stage", "error") == [("Broken", "fit", "RuntimeError: no features")]
    assert rows(run.cv_results.groupBy("model").count()) == [("DLinear", 8), ("Half", 8), ("NLinear", 8), ("Naive", 8)]
    assert {r["model"] for r in run.summary.collect()} == {"DLinear", "Half", "NLinear", "Naive"}
    skipped = rows(run.status.where("status = 'skipped'"), "model", "unique_id", "error")
    assert skipped == [(m, 3, "fewer than 8 rows") for m in ("DLinear", "Half", "NLinear", "Naive")]
    assert rows(run.params.groupBy("model").count()) == [("DLinear", 2), ("NLinear", 2)]
    expected = score(run.cv_results.drop("run_id"), mape="fraction")
    columns = ("model", "unique_id", "metric", "n_scored")
    assert rows(run.metrics, *columns) == rows(expected, *columns)


def test_all_linear_models_may_fail(spark, tmp_path):
    panel = make_panel(spark, {1: range(9)})
    run = backtest(panel, [Naive(), NLinear()], run_id="r", folder=str(tmp_path / "o"), horizon=2, input_size=4, n_windows=2)
    assert rows(run.failures, "model", "stage") == [("NLinear", "fit")]
    assert run.params is None and run.cv_results.count() == 4
    with pytest.raises(RuntimeError):
        backtest(panel, [NLinear()], run_id="r", horizon=2, input_size=4, n_windows=2)


def test_a_repeated_run_replaces_its_rows(spark, panel, tmp_path):
    folder = str(tmp_path / "out")
    for _ in range(2):
        run = backtest(panel, [Naive()], run_id="r", folder=folder, **SHAPE)
    other = backtest(panel, [WindowAverage()], run_id="s", folder=folder, **SHAPE)
    assert run.cv_results.count() == 8
    assert rows(other.cv_results.groupBy("model").count()) == [("WindowAverage", 8)]
    with pytest.raises(ValueError):
        backtest(panel, [Naive(), Naive()], **SHAPE)


def test_a_repeated_run_shows_no_old_rows(spark, panel, tmp_path):
    folder = str(tmp_path / "out")
    backtest(panel, [Naive(), WindowAverage(), NLinear()], run_id="a b/1", folder=folder, **SHAPE)
    kept = backtest(panel, [Naive()], run_id="other", folder=folder, **SHAPE)
    wanting = LinearExog(name="Wanting", exogenous=("absent",))
    again = backtest(panel, [Naive(), Broken(name="NLinear"), wanting], run_id="a b/1", folder=folder, **SHAPE)
    assert rows(again.failures, "model", "stage", "error") == [
        ("NLinear", "fit", "RuntimeError: no features"), ("Wanting", "prepare", "missing columns: absent")]
    for table in (again.cv_results, again.metrics, again.summary, again.status):
        assert {r["model"] for r in table.collect()} == {"Naive"}
    assert load_params(spark, f"{folder}/model_params", "a b/1") == []
    stored = spark.read.parquet(f"{folder}/cv_results").groupBy("run_id", "model").count()
    assert rows(stored) == [("a b/1", "Naive", 8), ("other", "Naive", 8)]
    assert rows(again.settings, "run_id", "horizon", "models") == [("a b/1", 2, ["Naive"])]
    assert kept.failures.count() == 0
    # A run in which no model succeeds does not replace the one before.
    with pytest.raises(RuntimeError, match="no features"):
        backtest(panel, [Broken(name="NLinear")], run_id="a b/1", folder=folder, **SHAPE)
    assert rows(open_run(spark, folder, "a b/1").failures, "model") == [("NLinear",), ("Wanting",)]


class Stopped(Exception):
    pass


@pytest.mark.parametrize("where", ["publish", "remove_older"])
def test_a_stopped_run_leaves_the_old_one(spark, panel, tmp_path, monkeypatch, where):
    """Whenever a run stops, readers see the old run or the new one, never parts of both."""
    folder = str(tmp_path / "out")
    old = backtest(panel, [Naive(), WindowAverage()], run_id="r", folder=folder, **SHAPE)
    before = rows(old.cv_results)

    def stop(*_):
        raise Stopped

    with monkeypatch.context() as patch:
        patch.setattr(f"rollcast.plans.backtest.{where}", stop)
        with pytest.raises(Stopped):
            backtest(panel, [NLinear()], run_id="r", folder=folder, **SHAPE)
    seen = open_run(spark, folder)
    models = ["NLinear"] if where == "remove_older" else ["Naive", "WindowAverage"]
    for table in (seen.cv_results, seen.metrics, seen.summary, seen.status):
        assert sorted({r["model"] for r in table.collect()}) == models
    assert seen.settings.first()["models"] == models and (seen.params is None) == (models[0] == "Naive")
    if where != "remove_older":
        assert rows(seen.cv_results) == before
    # What was left behind goes with the next replacement.
    again = backtest(panel, [Naive()], run_id="r", folder=folder, **SHAPE)
    for table in ("cv_results", "metrics", "summary", "fit_status", "runs"):
        kept = {r["generation"] for r in spark.read.parquet(f"{folder}/{table}").select("generation").distinct().collect()}
        assert kept == {again.generation}
    assert sorted({r["model"] for r in read_current(spark, folder, "cv_results").collect()}) == ["Naive"]


def test_no_run(spark, tmp_path):
    with pytest.raises(ValueError, match="no published run"):
        open_run(spark, str(tmp_path))


def test_predict_from_the_folder_alone(spark, panel, tmp_path):
    folder = str(tmp_path / "out")
    backtest(panel, [Naive()], run_id="run_1", folder=folder, **SHAPE)
    half = LocalForecaster("Half", lambda x, h: x[-h:] / 2)
    run = backtest(panel, [Naive(), NLinear(), half], run_id="run_2", folder=folder, **SHAPE)
    job = predict_stored(panel, folder)
    assert job.models == ["NLinear", "Naive"] or job.models == ["Naive", "NLinear"]
    [model] = [m for m in load_params(spark, f"{folder}/model_params", "run_2")]
    expected = run_inference(panel, [Naive(), model], horizon=2, input_size=4)
    assert rows(job.predictions, "model", "unique_id", "ds", "y_hat") == rows(expected)
    assert rows(open_run(spark, folder).predictions.groupBy("run_id").count()) == [("run_2", expected.count())]
    assert set(predict_stored(panel, folder, others=[half]).models) == {"Naive", "NLinear", "Half"}
    assert predict_stored(panel, folder, run_id="run_1").models == ["Naive"]
    one = predict_stored(panel, folder, pick="best", plot_points=8)
    assert one.unique_id in (1, 2) and one.traces.count()
    # A repeated run takes its predictions with it.
    assert backtest(panel, [Naive()], run_id="run_2", folder=folder, **SHAPE).predictions is not run.predictions
    remaining = open_run(spark, folder, "run_2").predictions
    assert remaining is None or remaining.isEmpty()
    listed = run_list(*[read_current(spark, folder, t) for t in ("runs", "fit_status", "model_params")])
    assert [(r["run_id"], r["horizon"], r["n_models"], r["has_models"]) for r in listed.collect()] == [
        ("run_2", 2, 1, False), ("run_1", 2, 1, False)]


def slope(**options):
    """Goes on with the last step of the history; functions are local, so that tasks get them by value."""

    def fit(history):
        if history["y"].iloc[0] > 900:
            raise ValueError("too high")
        return history["y"].iloc[-1] - history["y"].iloc[-2]

    def ahead(step, past, times):
        if past["y"].iloc[-1] == 25:
            raise RuntimeError("bad fold")
        return past["y"].iloc[-1] + step * np.arange(1, len(times) + 1)

    return SeriesForecaster("Slope", fit, ahead, **options)


def test_series_forecasters(spark):
    """Fitted once per series; a failing fit or fold stays by itself; long series are reported."""
    panel = make_panel(spark, {1: range(20), 2: range(1000, 1020), 3: range(10, 30), 4: range(0, 60, 2), 5: range(4)})
    model = slope(max_rows=24)
    runs = cv_runs(panel, [Naive(), model], step=None, test_size=None, layout=measure_series(panel), **SHAPE)
    found = {(r["unique_id"], r["fold"]): r for r in runs.where("model = 'Slope'").collect()}
    assert sorted(found) == [(u, k) for u in (1, 2, 3, 4) for k in (1, 2)]
    assert found[1, 2]["y_hat"] == [18.0, 19.0] and [s["y"] for s in found[1, 2]["steps"]] == [18.0, 19.0]
    assert found[2, 1]["y_hat"] is None and found[2, 2]["error"] == "ValueError: too high"
    assert found[3, 1]["error"] == "RuntimeError: bad fold" and found[3, 2]["y_hat"] == [28.0, 29.0]
    assert found[4, 1]["note"] == "fitted on the last 24 rows" and found[4, 1]["y_hat"] == [52.0, 54.0]
    status = {r["unique_id"]: (r["status"], r["error"]) for r in fit_status(runs.where("model = 'Slope'")).collect()}
    assert status == {1: ("ok", None), 2: ("failed", "ValueError: too high"), 3: ("failed", "RuntimeError: bad fold"),
                      4: ("bounded", "fitted on the last 24 rows")}
    with pytest.raises(ValueError):
        cv_runs(panel, [slope(max_rows=3)], step=None, test_size=None,
                layout=measure_series(panel), **SHAPE)


def test_series_forecasters_predict_and_backtest(spark, tmp_path):
    panel = make_panel(spark, {1: range(20), 2: range(1000, 1020), 3: range(3)})
    model = slope()
    ahead = run_inference(panel, [Naive(), model], horizon=2, input_size=4)
    assert rows(ahead.where("model = 'Slope'"), "unique_id", "ds", "y_hat") == [
        (1, at(20), 20.0), (1, at(21), 21.0), (2, at(20), None), (2, at(21), None)]
    run = backtest(panel, [Naive(), model], run_id="r", folder=str(tmp_path / "o"), **SHAPE)
    assert rows(run.status.where("model = 'Slope'"), "unique_id", "status") == [(1, "ok"), (2, "failed"), (3, "skipped")]


def test_summarize_stores_what_the_readers_read(spark, panel, tmp_path):
    from rollcast.operators.forecast import cross_validate

    cv = cross_validate(panel, [Naive(), WindowAverage()], layout=measure_series(panel), **SHAPE)
    export_by_model(cv, str(tmp_path), "cv_results_")
    result = summarize(spark, str(tmp_path), out=str(tmp_path / "scores"))
    board = read_summary(spark, str(tmp_path / "scores" / "metrics_summary.csv"))
    assert {r["model"] for r in board.collect()} == {"Naive", "WindowAverage"}
    back = read_metrics(spark, str(tmp_path / "scores" / "metrics.csv"))
    assert rows(back, "model", "unique_id", "metric") == rows(result.metrics, "model", "unique_id", "metric")


def test_a_run_with_a_number_for_a_name(spark, panel, tmp_path):
    run = backtest(panel, [Naive(name="1"), NLinear()], run_id="007", folder=str(tmp_path / "o"), **SHAPE)
    assert rows(run.cv_results.select("run_id", "model").distinct()) == [("007", "1"), ("007", "NLinear")]
    assert [m.name for m in load_params(spark, f"{run.folder}/model_params", "007")] == ["NLinear"]


def test_exogenous_models_in_a_backtest(spark, panel):
    wide = panel.selectExpr("*", "y % 3 as carbs")
    run = backtest(wide, [LinearExog(exogenous=("carbs",)), NLinear()], **SHAPE)
    assert run.failures.count() == 0
    assert run.run_id.startswith("run_") and len(new_run_id()) == len("run_20240101_000000")


def test_summarize_scores_stored_files(spark, panel, tmp_path):
    from rollcast.operators.forecast import cross_validate

    cv = cross_validate(panel, [Naive(), WindowAverage()], layout=measure_series(panel), **SHAPE)
    export_by_model(cv, str(tmp_path), "cv_results_")
    (tmp_path / "cv_results_Bad.csv").write_text("unique_id,ds,y\n1,2024-01-01T00:00:00,1\n")
    result = summarize(spark, str(tmp_path))
    assert list(result.skipped) == [f"{tmp_path}/cv_results_Bad.csv"]
    assert result.wide.columns == ["unique_id", "metric", "Naive", "WindowAverage"]
    assert result.board.columns == ["model", "mae", "mape", "mse", "rmse"]
    direct = {r["model"]: r["mean"] for r in leaderboard(score(cv)).where("metric = 'mae'").collect()}
    assert {r["model"]: r["mae"] for r in result.board.collect()} == pytest.approx(direct)


def test_choose_models(spark):
    available = [Naive(), WindowAverage()]
    summary = spark.createDataFrame([("X", "mae", 0.5), ("WindowAverage", "mae", 1.0)], "model string, metric string, mean double")
    def names(*args, **options):
        return [m.name for m in choose_models(available, *args, **options)]

    assert names(summary, None) == ["WindowAverage"]
    assert names(summary.where("model = 'X'"), None) == ["Naive", "WindowAverage"]
    assert names(None, None) == ["Naive", "WindowAverage"]
    assert names(summary, ["Naive"]) == ["Naive"]
    with pytest.raises(ValueError):
        choose_models(available, None, ["Naive", "X"])


def test_predict_one_series(spark, panel):
    options = {"horizon": 2, "input_size": 4, "plot_points": 10}
    job = predict_job(panel, [Naive(), WindowAverage()], unique_id=1, **options)
    assert job.models == ["Naive", "WindowAverage"] and job.unique_id == 1
    # Held out: forecasts cover the last two known rows.
    assert [r["ds"] for r in job.predictions.where("model = 'Naive'").orderBy("ds").collect()] == [at(38), at(39)]
    counts = rows(job.traces.groupBy("trace").count())
    assert counts == [("Actual", 10), ("Naive", 2), ("WindowAverage", 2)]
    short = predict_job(panel, [Naive()], unique_id=3, **options)
    assert [r["ds"] for r in short.predictions.orderBy("ds").collect()] == [at(5), at(6)]
    with pytest.raises(ValueError):
        predict_job(panel, [Naive()], unique_id=99, **options)


def test_predict_all_and_picked_series(spark, panel):
    every = predict_job(panel, [Naive()], horizon=2, input_size=4)
    assert every.unique_id is None and every.traces is None
    assert rows(every.predictions.groupBy("unique_id").count()) == [(1, 2), (2, 2), (3, 2)]
    metrics = spark.createDataFrame(
        [("Naive", 1, "mae", 2.0), ("Naive", 2, "mae", 1.0), ("WindowAverage", 2, "mae", 9.0)],
        "model string, unique_id bigint, metric string, value double")
    options = {"metrics": metrics, "horizon": 2, "input_size": 4}
    assert predict_job(panel, [Naive()], pick="best", **options).unique_id == 1
    assert predict_job(panel, [Naive()], pick="random", seed=3, **options).unique_id in (1, 2)
    limited = predict_job(panel, [Naive(), WindowAverage()], unique_id=2, max_mae=5.0, **options)
    assert {r["trace"] for r in limited.traces.collect()} == {"Actual", "Naive"}
    with pytest.raises(ValueError):
        predict_job(panel, [Naive()], pick="best", horizon=2, input_size=4)
    with pytest.raises(ValueError):
        predict_job(panel, [Naive()], pick="worst", **options)
