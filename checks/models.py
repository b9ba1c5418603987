"""Queries on forecasting: cross-validation, prediction, fitted models, user functions."""

from __future__ import annotations

from datetime import timedelta

import numpy as np
from pyspark.sql import functions as F

from checks.panels import small_pieces
from checks.registry import query, r6
from checks.sql import (
    EVENTS,
    ORDERS,
    RANKED,
    SUMMARY,
    SUPPLIERS,
    baseline_cv,
    folds,
    scores,
    training,
    with_,
)
from rollcast.operators import forecast
from rollcast.operators.forecast import LocalForecaster, Naive, WindowAverage
from rollcast.operators.linear import DLinear, LinearExog, LinearModel, NLinear
from rollcast.operators.windows import holdout_split, lag_windows
from rollcast.operators.runs import run_list as list_runs
from rollcast.plans.backtest import backtest as run_backtest
from rollcast.plans.backtest import open_run
from rollcast.plans.predict import predict_stored
from rollcast.sources.generations import read_current
from rollcast.sources.panels import events_panel, orders_panel, supplier_layout, supplier_panel
from rollcast.sources.results import load_params, save_params
from rollcast.sources.scratch import delete_at_end, shared_folder, store

BASELINES = [Naive(), WindowAverage()]
EVENT_SHAPE = {"horizon": 6, "input_size": 24, "n_windows": 3}
SUPPLIER_SHAPE = {"horizon": 12, "input_size": 48, "n_windows": 3}

EVENT_CV = (EVENTS, RANKED, folds(6, 3, input_size=24), baseline_cv(6, 24))
SUPPLIER_CV = (SUPPLIERS, RANKED, folds(12, 3, input_size=48), baseline_cv(12, 48))
CV_COLUMNS = f"SELECT model, unique_id, ds, cutoff, {r6('y', 'y')}, {r6('y_hat', 'y_hat')} FROM cv"


def event_cv(spark, folder):
    return forecast.cross_validate(events_panel(spark, folder), BASELINES, **EVENT_SHAPE)


def supplier_cv(spark, folder):
    layout = supplier_layout(spark, folder)
    return forecast.cross_validate(
        supplier_panel(spark, folder), BASELINES, layout=layout, **SUPPLIER_SHAPE
    )


@query(with_(*SUPPLIER_CV) + CV_COLUMNS)
def cross_validate_baselines(spark, folder):
    return supplier_cv(spark, folder)


@query(with_(*EVENT_CV) + CV_COLUMNS)
def cross_validate_cut_series(spark, folder):
    panel = events_panel(spark, folder)
    layout = small_pieces(panel)
    return forecast.cross_validate(panel, BASELINES, layout=layout, **EVENT_SHAPE)


def linear_cv(model: str, lags: int, fit: str, forecast_sql: str) -> str:
    """SQL of a pooled linear model with one or two features, on events with h=3, 2 folds."""
    return with_(
        EVENTS, RANKED, folds(3, 2, input_size=lags), training(3, lags, 6), fit,
        f"""inputs AS (
  SELECT a.unique_id, f.fold, a.y AS x1, b.y AS x2, a.carbs AS e1
  FROM ranked a JOIN fold_list f ON a.r = f.newest + 4
  LEFT JOIN ranked b ON b.unique_id = a.unique_id AND b.r = a.r + 1)""",
    ) + f"""SELECT '{model}' AS model, d.unique_id, d.ds, d.cutoff, {r6('d.y', 'y')},
  {r6(forecast_sql, 'y_hat')}
FROM folds d
JOIN inputs i ON i.unique_id = d.unique_id AND i.fold = d.fold
JOIN fit ON fit.step = d.step"""


SMALL_SHAPE = {"horizon": 3, "n_windows": 2}

NLINEAR_FIT = """fit AS (
  SELECT step, regr_slope(target - x1, x2 - x1) AS w, regr_intercept(target - x1, x2 - x1) AS b
  FROM training GROUP BY step)"""


@query(linear_cv("NLinear", 2, NLINEAR_FIT, "i.x1 + fit.b + fit.w * (i.x2 - i.x1)"))
def cross_validate_nlinear(spark, folder):
    panel = events_panel(spark, folder)
    return forecast.cross_validate(panel, [NLinear()], input_size=2, **SMALL_SHAPE)


# With two lags and a kernel of 25 points the trend is (13 x2 + 12 x1)/25 and (12 x2 + 13 x1)/25,
# the remainder the rest. Ridge on those four features M x, each in units of its variance d, is a
# ridge with the matrix inverse(M' diag(1/d) M) on the two lags.
_M = DLinear().decomposition(2).tolist()
_D = [f"({a!r} * {a!r} * v2 + {b!r} * {b!r} * v1 + 2 * {a!r} * ({b!r}) * v12)" for a, b in _M]


def _k(i: int, j: int) -> str:
    return " + ".join(f"({row[i]!r}) * ({row[j]!r}) / {d}" for row, d in zip(_M, _D))


DLINEAR_FIT = f"""plain AS (
  SELECT step, avg(target) AS mt, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS v1, var_pop(x2) AS v2,
         covar_pop(x1, x2) AS v12, covar_pop(x1, target) AS c1t, covar_pop(x2, target) AS c2t
  FROM training GROUP BY step),
units AS (SELECT *, {_k(0, 0)} AS k22, {_k(1, 1)} AS k11, {_k(0, 1)} AS k12 FROM plain),
sums AS (
  SELECT *, v1 + 0.001 * k22 / (k11 * k22 - k12 * k12) AS c11, v2 + 0.001 * k11 / (k11 * k22 - k12 * k12) AS c22,
         v12 - 0.001 * k12 / (k11 * k22 - k12 * k12) AS c12
  FROM units),
fit AS (
  SELECT step, mt, m1, m2, (c1t * c22 - c2t * c12) / (c11 * c22 - c12 * c12) AS w1,
         (c2t * c11 - c1t * c12) / (c11 * c22 - c12 * c12) AS w2
  FROM sums)"""


@query(
    linear_cv("DLinear", 2, DLINEAR_FIT, "fit.mt + fit.w1 * (i.x1 - fit.m1) + fit.w2 * (i.x2 - fit.m2)")
)
def cross_validate_dlinear(spark, folder):
    panel = events_panel(spark, folder)
    return forecast.cross_validate(panel, [DLinear()], input_size=2, **SMALL_SHAPE)


EXOG_FIT = """fit AS (
  SELECT step, avg(target - x1) AS b, avg(e1) AS me1,
         covar_pop(e1, target - x1) / (var_pop(e1) * 1.001) AS w
  FROM training GROUP BY step)"""


@query(linear_cv("Linear_exog", 1, EXOG_FIT, "i.x1 + fit.b + fit.w * (i.e1 - fit.me1)"))
def cross_validate_linear_exog(spark, folder):
    """With one lag the only feature beside the intercept is the exogenous value."""
    panel = events_panel(spark, folder)
    model = LinearExog(exogenous=("carbs",))
    return forecast.cross_validate(panel, [model], input_size=1, **SMALL_SHAPE)


@query()
def cross_validate_all_models(spark, folder):
    """Default window sizes; the fits are compared with a direct solution in the tests."""
    models = [*BASELINES, NLinear(), DLinear()]
    layout = supplier_layout(spark, folder)
    return forecast.cross_validate(
        supplier_panel(spark, folder), models, layout=layout, **SUPPLIER_SHAPE
    )


def middle(lags, horizon):
    """User function that refuses some windows."""
    if lags.max() > 250:
        raise ValueError("reading above 250")
    return [float(np.median(lags))] * horizon


LOCAL = """local AS (
  SELECT a.unique_id, f.fold, median(a.y) AS mid, max(a.y) AS top
  FROM ranked a JOIN fold_list f ON a.r > f.newest + 6 AND a.r <= f.newest + 30
  WHERE a.n >= 42 GROUP BY a.unique_id, f.fold)"""


@query(
    with_(EVENTS, RANKED, folds(6, 3, input_size=24), LOCAL)
    + f"SELECT 'Median' AS model, d.unique_id, d.ds, d.cutoff, {r6('d.y', 'y')}, "
    + r6("CASE WHEN l.top <= 250 THEN l.mid END", "y_hat")
    + " FROM folds d JOIN local l ON l.unique_id = d.unique_id AND l.fold = d.fold"
)
def cross_validate_local(spark, folder):
    models = [LocalForecaster("Median", middle)]
    return forecast.cross_validate(events_panel(spark, folder), models, **EVENT_SHAPE)


STATUS = """status AS (
  SELECT 'Median' AS model, unique_id, CASE WHEN max(top) > 250 THEN 'failed' ELSE 'ok' END AS status,
         CASE WHEN max(top) > 250 THEN 'ValueError: reading above 250' END AS error
  FROM local GROUP BY unique_id
  UNION ALL
  SELECT 'Naive', unique_id, 'ok', NULL FROM local GROUP BY unique_id)"""


def event_status(spark, folder):
    panel = events_panel(spark, folder)
    models = [LocalForecaster("Median", middle), Naive()]
    runs = forecast.cv_runs(
        panel, models, step=None, test_size=None, layout=forecast.measure_series(panel), **EVENT_SHAPE
    )
    return forecast.fit_status(runs)


@query(with_(EVENTS, RANKED, folds(6, 3, input_size=24), LOCAL, STATUS) + "SELECT * FROM status")
def fit_status(spark, folder):
    return event_status(spark, folder)


@query(
    with_(EVENTS, RANKED, folds(6, 3, input_size=24), LOCAL, STATUS)
    + "SELECT model, status, count(*) AS n_series FROM status GROUP BY model, status"
)
def fit_summary(spark, folder):
    return forecast.fit_summary(event_status(spark, folder))


def line_of(history):
    """A regression line over days; refuses a series whose history reaches 148."""
    if history["y"].max() >= 148:
        raise ValueError("reading of 148 or more")
    days = (history["ds"] - np.datetime64("1995-01-01")) / np.timedelta64(1, "D")
    return np.polyfit(days, history["y"], 1)


def on_line(line, past, times):
    days = (np.array(times, "datetime64[us]") - np.datetime64("1995-01-01")) / np.timedelta64(1, "D")
    return np.polyval(line, days)


@query(
    with_(
        SUPPLIERS, RANKED,
        """fixed AS (
  SELECT s AS step, l AS lag, ((l * 7 + s * 3) % 11 - 5) / 100.0::DOUBLE AS w FROM range(1, 13) a(s), range(1, 49) b(l)),
sums AS (
  SELECT a.unique_id, f.step, f.step / 10.0::DOUBLE + sum(a.y * f.w) AS y_hat, max(a.ds) AS cutoff
  FROM ranked a JOIN fixed f ON f.lag = 49 - a.r WHERE a.r <= 48 AND a.n >= 48 GROUP BY a.unique_id, f.step)""",
    )
    + "SELECT 'Fixed' AS model, unique_id, cutoff + step * INTERVAL '1 day' AS ds, " + r6("y_hat", "y_hat") + " FROM sums"
)
def predict_at_the_default_shape(spark, folder):
    """Given coefficients for 48 inputs and 12 steps, applied to the last windows of all series."""
    step, lag = np.meshgrid(np.arange(1, 13), np.arange(1, 49), indexing="ij")
    model = LinearModel("Fixed", 48, np.arange(1, 13) / 10, ((lag * 7 + step * 3) % 11 - 5) / 100)
    return forecast.predict(
        supplier_panel(spark, folder), model, horizon=12, input_size=48, freq=timedelta(days=1),
        layout=supplier_layout(spark, folder),
    )


@query(
    "SELECT CAST(s AS BIGINT) AS step, CAST(l AS BIGINT) AS lag, true AS orthogonal "
    "FROM range(1, 13) a(s), range(0, 48) b(l)"
)
def nlinear_solves_the_normal_equations(spark, folder):
    """The default shape: errors of the fit sum to zero, and have no product with any feature.

    ``lag`` 0 is the constant, ``lag`` i the i-th lag minus the last one.
    """
    panel, layout = supplier_panel(spark, folder), supplier_layout(spark, folder)
    [model] = forecast.fit_all(panel, [NLinear()], horizon=12, input_size=48, layout=layout)
    windows = lag_windows(panel, input_size=48, horizon=12, layout=layout)
    last = F.element_at("lags", -1)
    features = F.concat(F.array(F.lit(1.0)), F.transform(F.slice("lags", 1, 47), lambda x: x - last))
    fitted = windows.select(features.alias("x"), "targets", model.forecast(12).alias("fit"))
    spread = fitted.select("x", F.posexplode(F.arrays_zip("targets", "fit")).alias("at", "z"))
    error = F.col("z.targets") - F.col("z.fit")
    sums = [F.sum(F.get("x", F.lit(i)) * F.col("error")).alias(f"p{i}") for i in range(48)]
    sizes = [F.sqrt(F.sum(F.pow(F.get("x", F.lit(i)), 2))).alias(f"s{i}") for i in range(48)]
    found = spread.select("x", "at", error.alias("error")).groupBy("at").agg(
        *sums, *sizes, F.sqrt(F.sum(F.pow("error", 2))).alias("size")
    )
    cells = [
        F.struct(F.lit(i).alias("lag"), (F.abs(F.col(f"p{i}")) <= 1e-9 * F.col(f"s{i}") * F.col("size")).alias("orthogonal"))
        for i in range(48)
    ]
    return found.select((F.col("at") + 1).alias("step"), F.inline(F.array(*cells)))


LINE = """lines AS (
  SELECT unique_id, regr_slope(y, t) AS slope, regr_intercept(y, t) AS start, max(y) AS top, max(n) AS n
  FROM (SELECT *, epoch(ds - TIMESTAMP '1995-01-01') / 86400 AS t FROM ranked) q
  WHERE r > 36 AND r <= {most} GROUP BY unique_id)"""


@query(
    with_(SUPPLIERS, RANKED, folds(12, 3, input_size=48), LINE.format(most=10_000))
    + f"SELECT 'Line' AS model, d.unique_id, d.ds, d.cutoff, {r6('d.y', 'y')}, round(CASE WHEN l.top < 148 THEN "
    "l.start + l.slope * epoch(d.ds - TIMESTAMP '1995-01-01') / 86400 END, 3) AS y_hat "
    "FROM folds d JOIN lines l USING (unique_id)"
)
def cross_validate_per_series(spark, folder):
    """A user's regression, fitted once per series, forecasts every fold; some series fail."""
    found = forecast.cross_validate(
        supplier_panel(spark, folder), [forecast.SeriesForecaster("Line", line_of, on_line)], **SUPPLIER_SHAPE
    )
    return found.withColumn("y_hat", F.round("y_hat", 3))


@query(
    with_(SUPPLIERS, RANKED, folds(12, 3, input_size=48), LINE.format(most=500))
    + """SELECT 'Line' AS model, unique_id,
  CASE WHEN top >= 148 THEN 'failed' WHEN n > 500 THEN 'bounded' ELSE 'ok' END AS status,
  CASE WHEN top >= 148 THEN 'ValueError: reading of 148 or more'
       WHEN n > 500 THEN 'fitted on the last 500 rows' END AS error
FROM lines WHERE n >= 84"""
)
def fit_status_per_series(spark, folder):
    """Series with more rows than the model takes are fitted on their tail, and reported."""
    runs = forecast.cv_runs(
        supplier_panel(spark, folder), [forecast.SeriesForecaster("Line", line_of, on_line, max_rows=500)],
        step=None, test_size=None, layout=supplier_layout(spark, folder), **SUPPLIER_SHAPE,
    )
    return forecast.fit_status(runs)


FUTURE = """future AS (
  SELECT a.unique_id, max(a.ds) AS cutoff, max(CASE WHEN a.r = 1 THEN a.y END) AS last_y,
         avg(a.y) AS mean_y
  FROM ranked a WHERE a.r <= {lags} AND a.n >= {lags} GROUP BY a.unique_id),
predictions AS (
  SELECT 'Naive' AS model, unique_id, cutoff + i * INTERVAL '{freq}' AS ds, last_y AS y_hat
  FROM future, range(1, {horizon} + 1) steps(i)
  UNION ALL
  SELECT 'WindowAverage', unique_id, cutoff + i * INTERVAL '{freq}', mean_y
  FROM future, range(1, {horizon} + 1) steps(i))"""

EVENT_FUTURE = (EVENTS, RANKED, FUTURE.format(lags=24, horizon=6, freq="5 minutes"))


def event_predictions(spark, folder, models=BASELINES, input_size=24):
    return forecast.run_inference(
        events_panel(spark, folder), models, horizon=6, input_size=input_size, freq=timedelta(minutes=5)
    )


@query(with_(*EVENT_FUTURE) + "SELECT model, unique_id, ds, " + r6("y_hat", "y_hat") + " FROM predictions")
def run_inference(spark, folder):
    return event_predictions(spark, folder)


def runs_with_unusable_models(spark, folder):
    """Beside the baselines, a model fitted for another horizon and one without its column."""
    panel = events_panel(spark, folder)
    [other] = forecast.fit_all(panel, [NLinear()], horizon=3, input_size=2)
    absent = LinearModel("Absent", 24, np.zeros(6), np.zeros((6, 48)), ("no_such_column",))
    return forecast.inference_runs(
        panel, [other, *BASELINES, absent], horizon=6, input_size=24, freq=timedelta(minutes=5)
    )


@query(with_(*EVENT_FUTURE) + "SELECT model, unique_id, ds, " + r6("y_hat", "y_hat") + " FROM predictions")
def inference_beside_unusable_models(spark, folder):
    runs, _ = runs_with_unusable_models(spark, folder)
    return forecast.forecast_rows(runs).select("model", "unique_id", "ds", "y_hat")


@query(
    with_(*EVENT_FUTURE)
    + """SELECT model, count(DISTINCT unique_id) AS n_ok, CAST(0 AS BIGINT) AS n_failed, CAST(NULL AS VARCHAR) AS error
FROM predictions GROUP BY model
UNION ALL SELECT 'NLinear', 0, 0, 'fitted for 3 steps, not 6'
UNION ALL SELECT 'Absent', 0, 0, 'missing columns: no_such_column'"""
)
def inference_status(spark, folder):
    return forecast.inference_status(*runs_with_unusable_models(spark, folder))


@query(
    with_(SUPPLIERS, RANKED, FUTURE.format(lags=48, horizon=12, freq="1 day"))
    + "SELECT model, unique_id, ds, " + r6("y_hat", "y_hat") + " FROM predictions WHERE model = 'WindowAverage'"
)
def predict(spark, folder):
    return forecast.predict(
        supplier_panel(spark, folder), WindowAverage(), horizon=12, input_size=48,
        freq=timedelta(days=1), layout=supplier_layout(spark, folder),
    )


@query(
    with_(
        EVENTS, RANKED, training(3, 2, 0), NLINEAR_FIT,
        """ends AS (
  SELECT a.unique_id, a.ds AS cutoff, a.y AS x1, b.y AS x2
  FROM ranked a JOIN ranked b ON b.unique_id = a.unique_id AND b.r = 2 WHERE a.r = 1)""",
    )
    + "SELECT 'NLinear' AS model, unique_id, cutoff + fit.step * INTERVAL '5 minutes' AS ds, "
    + r6("x1 + fit.b + fit.w * (x2 - x1)", "y_hat")
    + " FROM ends, fit"
)
def predict_with_stored_model(spark, folder):
    """Fit on the whole panel, store the coefficients, read them back, forecast."""
    panel = events_panel(spark, folder)
    path = shared_folder(spark)
    fitted = forecast.fit_all(panel, [NLinear()], horizon=3, input_size=2)
    save_params(spark, fitted, path, "run_1")
    models = load_params(spark, path, "run_1")
    return forecast.run_inference(panel, models, horizon=3, input_size=2)


@query(
    with_(
        ORDERS, RANKED,
        """ends AS (SELECT unique_id, ds AS cutoff, y AS y_hat FROM ranked WHERE r = 13)""",
    )
    + "SELECT 'Naive' AS model, e.unique_id, p.ds, " + r6("e.y_hat", "y_hat") + ", " + r6("p.y", "y")
    + " FROM ends e JOIN panel p ON p.unique_id = e.unique_id AND p.ds > e.cutoff "
    "AND p.ds <= e.cutoff + INTERVAL '12 days'"
)
def attach_actuals(spark, folder):
    panel = orders_panel(spark, folder)
    seen = holdout_split(panel, 12).where("role = 'inference'").drop("role")
    future = store(forecast.predict(seen, Naive(), horizon=12, input_size=1, freq=timedelta(days=1)))
    return forecast.attach_actuals(future, panel)


@query(with_(*EVENT_CV) + CV_COLUMNS + " WHERE model = 'Naive'")
def backtest(spark, folder):
    """A whole run with stored tables; the linear models share one fit."""
    models = [*BASELINES, NLinear(), DLinear(), LinearExog(exogenous=("carbs",))]
    run = run_backtest(events_panel(spark, folder), models, run_id="run_1", **EVENT_SHAPE)
    rows = run.cv_results.where(F.col("model") == "Naive")
    return rows.select("model", "unique_id", "ds", "cutoff", "y", "y_hat")


class Unfit(NLinear):
    """Fails in its fit."""

    def features(self, input_size):
        raise RuntimeError("no features")


@query(with_(*EVENT_CV) + CV_COLUMNS + " WHERE model = 'Naive'")
def backtest_repeated(spark, folder):
    """The second run under the same id has one model less and one that fails."""
    panel, out = events_panel(spark, folder), shared_folder(spark)
    delete_at_end(spark, out)
    run_backtest(panel, [*BASELINES, NLinear()], run_id="run_1", folder=out, **EVENT_SHAPE)
    run = run_backtest(panel, [Naive(), Unfit()], run_id="run_1", folder=out, **EVENT_SHAPE)
    return run.cv_results.select("model", "unique_id", "ds", "cutoff", "y", "y_hat")


@query(
    with_(*EVENT_FUTURE)
    + "SELECT 'run_2' AS run_id, model, unique_id, ds, " + r6("y_hat", "y_hat") + " FROM predictions"
)
def predict_from_stored_run(spark, folder):
    """Two runs are stored; the forecasts need the folder and the panel only, and are read back from it."""
    panel, out = events_panel(spark, folder), shared_folder(spark)
    delete_at_end(spark, out)
    run_backtest(panel, [Naive()], run_id="run_1", folder=out, **EVENT_SHAPE)
    run_backtest(panel, BASELINES, run_id="run_2", folder=out, **EVENT_SHAPE)
    predict_stored(panel, out, freq=timedelta(minutes=5))
    return open_run(spark, out).predictions.select("run_id", "model", "unique_id", "ds", "y_hat")


@query(
    with_(EVENTS, "sizes AS (SELECT unique_id, count(*) AS n FROM panel GROUP BY unique_id)")
    + """SELECT run_id, horizon, input_size, n_models, n_models * count_if(n >= input_size + 18)::BIGINT AS n_ok,
  0::BIGINT AS n_bounded, 0::BIGINT AS n_failed, n_models * count_if(n < input_size + 18)::BIGINT AS n_skipped, has_models
FROM sizes, (VALUES ('run_1', 6::BIGINT, 24::BIGINT, 1::BIGINT, false), ('run_2', 6, 40, 3, true))
  t(run_id, horizon, input_size, n_models, has_models)
GROUP BY run_id, horizon, input_size, n_models, has_models"""
)
def run_list(spark, folder):
    """The runs of a folder with their shape and outcome; the first run was stored twice."""
    panel, out = events_panel(spark, folder), shared_folder(spark)
    delete_at_end(spark, out)
    run_backtest(panel, [*BASELINES], run_id="run_1", folder=out, **EVENT_SHAPE)
    run_backtest(panel, [*BASELINES, NLinear()], run_id="run_2", folder=out, **{**EVENT_SHAPE, "input_size": 40})
    run_backtest(panel, [Naive()], run_id="run_1", folder=out, **EVENT_SHAPE)
    return list_runs(*[read_current(spark, out, name) for name in ("runs", "fit_status", "model_params")])


MEDIAN_CV = """middles AS (
  SELECT a.unique_id, f.fold, CASE WHEN max(a.y) <= 250 THEN median(a.y) END AS mid
  FROM ranked a JOIN fold_list f ON a.r > f.newest + 12 AND a.r <= f.newest + 60
  GROUP BY a.unique_id, f.fold),
all_cv AS (
  SELECT model, unique_id, y, y_hat FROM cv
  UNION ALL
  SELECT 'Median', d.unique_id, d.y, m.mid
  FROM folds d JOIN middles m ON m.unique_id = d.unique_id AND m.fold = d.fold)"""


@query(
    with_(*SUPPLIER_CV, MEDIAN_CV, scores("fraction", "all_cv"), SUMMARY)
    + f"SELECT model, metric, {r6('mean', 'mean')}, {r6('std', 'std')}, n_series FROM summary"
)
def backtest_leaderboard(spark, folder):
    """A run with fitted models and a user function; the fitted ones have no SQL twin."""
    models = [*BASELINES, NLinear(), DLinear(), LocalForecaster("Median", middle)]
    run = run_backtest(supplier_panel(spark, folder), models, run_id="run_1", **SUPPLIER_SHAPE)
    board = run.summary.where(~F.col("model").isin("NLinear", "DLinear"))
    return board.select("model", "metric", "mean", "std", "n_series")
