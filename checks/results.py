"""Queries on scores, leaderboards, selection, stored results, traces and whole jobs."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from checks.models import (
    BASELINES,
    CV_COLUMNS,
    EVENT_CV,
    EVENT_FUTURE,
    FUTURE,
    SUPPLIER_CV,
    event_cv,
    event_predictions,
    supplier_cv,
)
from checks.registry import query, r6
from checks.sql import EVENTS, RANKED, SUMMARY, baseline_cv, folds, scores, with_
from rollcast.functions import row_mean
from rollcast.operators import runs, selection, traces
from rollcast.operators import score as scoring
from rollcast.operators.forecast import Naive, WindowAverage, cross_validate
from rollcast.plans.predict import predict_job as run_predict_job
from rollcast.plans.summarize import summarize as run_summarize
from rollcast.sources import results
from rollcast.sources.panels import events_panel
from rollcast.sources.scratch import shared_folder, store

NAMES = ["Naive", "WindowAverage"]
METRIC_COLUMNS = "SELECT model, unique_id, n_scored, metric, " + r6("value", "value") + " FROM metrics"


def event_metrics(spark, folder):
    return scoring.score(event_cv(spark, folder))


def event_summary(spark, folder):
    return scoring.leaderboard(event_metrics(spark, folder))


EVENT_METRICS = (*EVENT_CV, scores())
EVENT_SUMMARY = (*EVENT_METRICS, SUMMARY)


@query(with_(*SUPPLIER_CV, scores()) + METRIC_COLUMNS)
def score(spark, folder):
    return scoring.score(supplier_cv(spark, folder))


@query(with_(*EVENT_CV, scores("fraction")) + METRIC_COLUMNS)
def score_fraction(spark, folder):
    return scoring.score(event_cv(spark, folder), mape="fraction")


# The target becomes 0 below 10, and the forecast is missing where the target is above 90.
EDGE_CV = """edges AS (
  SELECT model, unique_id, CASE WHEN y < 10 THEN 0.0 ELSE y END AS y,
         CASE WHEN y <= 90 THEN y_hat END AS y_hat FROM cv)"""


@query(with_(*EVENT_CV, EDGE_CV, scores("fraction", "edges")) + METRIC_COLUMNS)
def score_with_gaps(spark, folder):
    """Zero targets have no fraction; missing forecasts (here NaN) are skipped."""
    y = F.col("y")
    edges = event_cv(spark, folder).select(
        "model", "unique_id", F.when(y < 10, 0.0).otherwise(y).alias("y"),
        F.when(y <= 90, F.col("y_hat")).otherwise(F.lit(float("nan"))).alias("y_hat"),
    )
    return scoring.score(edges, mape="fraction")


@query(
    with_(*SUPPLIER_CV, scores(), SUMMARY)
    + f"SELECT model, metric, {r6('mean', 'mean')}, {r6('std', 'std')}, n_series FROM summary"
)
def leaderboard(spark, folder):
    return scoring.leaderboard(scoring.score(supplier_cv(spark, folder)))


def summary_columns(pairs) -> str:
    return ", ".join(
        r6(f"max(CASE WHEN {condition} THEN {part} END)", f'"{name}"') for name, condition, part in pairs
    )


WIDE = summary_columns(
    (f"{m.upper()}_{part}", f"metric = '{m}'", part)
    for m in ("mae", "mse", "rmse", "mape") for part in ("mean", "std")
)
MEANS = summary_columns((m, f"metric = '{m}'", "mean") for m in ("mae", "mape", "mse", "rmse"))
BY_METRIC = summary_columns(
    (f"{m}_{part}", f"model = '{m}'", part) for m in NAMES for part in ("mean", "std")
)


@query(with_(*EVENT_SUMMARY) + f"SELECT model, {WIDE} FROM summary GROUP BY model")
def leaderboard_wide(spark, folder):
    return scoring.leaderboard_wide(event_summary(spark, folder))


@query(with_(*EVENT_SUMMARY) + f"SELECT model, {MEANS} FROM summary GROUP BY model")
def leaderboard_means(spark, folder):
    return scoring.leaderboard_means(event_summary(spark, folder))


@query(with_(*EVENT_SUMMARY) + f"SELECT metric, {BY_METRIC} FROM summary GROUP BY metric")
def leaderboard_by_metric(spark, folder):
    return scoring.leaderboard_by_metric(event_summary(spark, folder), NAMES)


@query(with_(*EVENT_SUMMARY) + f"SELECT model, {MEANS} FROM summary GROUP BY model")
def reshape_summary(spark, folder):
    by_metric = scoring.leaderboard_by_metric(event_summary(spark, folder), NAMES)
    return scoring.reshape_summary(by_metric)


@query(with_(*EVENT_SUMMARY) + f"SELECT model, {r6('mean', 'mae')} FROM summary WHERE metric = 'mae'")
def model_ranking(spark, folder):
    by_metric = scoring.leaderboard_by_metric(event_summary(spark, folder), NAMES)
    return scoring.model_ranking(by_metric)


WIDE_METRICS = ", ".join(r6(f"max(CASE WHEN model = '{m}' THEN value END)", f'"{m}"') for m in NAMES)


@query(
    with_(*SUPPLIER_CV, scores())
    + f"SELECT unique_id, metric, {WIDE_METRICS} FROM metrics GROUP BY unique_id, metric"
)
def metrics_wide(spark, folder):
    return scoring.metrics_wide(scoring.score(supplier_cv(spark, folder)), NAMES)


@query(with_(*EVENT_METRICS) + "SELECT unique_id, metric, model, " + r6("value", "value") + " FROM metrics")
def wide_to_long(spark, folder):
    wide = scoring.metrics_wide(event_metrics(spark, folder), NAMES)
    return scoring.wide_to_long(wide, ["unique_id", "metric"])


WIDE_PREDICTIONS = ", ".join(r6(f"max(CASE WHEN model = '{m}' THEN y_hat END)", f'"{m}"') for m in NAMES)


@query(
    with_(
        EVENTS, RANKED, FUTURE.format(lags=24, horizon=6, freq="5 minutes"),
        FUTURE.format(lags=64, horizon=6, freq="5 minutes")
        .replace("future AS", "longer AS").replace("FROM future", "FROM longer")
        .replace("predictions AS", "long_predictions AS"),
    )
    + f"SELECT unique_id, ds, {WIDE_PREDICTIONS} FROM ("
    "SELECT * FROM predictions WHERE model = 'Naive' UNION ALL "
    "SELECT * FROM long_predictions WHERE model = 'WindowAverage') p GROUP BY unique_id, ds"
)
def predictions_wide(spark, folder):
    """The average needs 64 rows, which some series lack: its column has gaps."""
    naive = event_predictions(spark, folder, [Naive()])
    average = event_predictions(spark, folder, [WindowAverage()], 64)
    return scoring.predictions_wide(naive.unionByName(average), NAMES)


@query(
    with_(*EVENT_METRICS)
    + "SELECT unique_id, " + r6("avg(value)", "mean_mae")
    + " FROM metrics WHERE metric = 'mae' GROUP BY unique_id ORDER BY avg(value), unique_id LIMIT 10"
)
def best_series(spark, folder):
    return selection.best_series(event_metrics(spark, folder), 10)


@query(
    with_(*SUPPLIER_CV, scores())
    + "SELECT unique_id, metric, " + r6("avg(value)", "mean") + " FROM metrics GROUP BY unique_id, metric"
)
def row_mean_over_models(spark, folder):
    wide = scoring.metrics_wide(scoring.score(supplier_cv(spark, folder)), NAMES)
    return wide.select("unique_id", "metric", row_mean(*map(F.col, NAMES)).alias("mean"))


@query(
    with_(*EVENT_METRICS)
    + "SELECT unique_id FROM (SELECT DISTINCT unique_id FROM metrics WHERE metric = 'mae') "
    "ORDER BY md5('7:' || unique_id), unique_id LIMIT 5"
)
def sample_series(spark, folder):
    return selection.sample_series(event_metrics(spark, folder), seed=7, n=5)


@query(
    with_(*EVENT_SUMMARY)
    + f"SELECT model, {r6('mean', 'mean')} FROM summary WHERE metric = 'rmse' ORDER BY mean, model LIMIT 1"
)
def best_models(spark, folder):
    return selection.best_models(event_summary(spark, folder), 1, "rmse")


SELECTED = """scored AS (SELECT DISTINCT unique_id FROM metrics),
pairs AS (
  SELECT DISTINCT p.unique_id, p.model, m.value AS mae, s.unique_id IS NOT NULL AS filtered
  FROM predictions p
  LEFT JOIN scored s ON s.unique_id = p.unique_id
  LEFT JOIN metrics m ON m.unique_id = p.unique_id AND m.model = p.model AND m.metric = 'mae'),
chosen AS (
  SELECT unique_id, model, mae, row_number() OVER (PARTITION BY unique_id ORDER BY mae, model) AS rank
  FROM pairs WHERE filtered AND mae < 40
  UNION ALL
  SELECT unique_id, model, NULL, NULL FROM pairs WHERE NOT filtered)"""


@query(
    with_(
        *EVENT_FUTURE, folds(6, 3, input_size=48), baseline_cv(6, 48), scores(), SELECTED
    )
    + f"SELECT unique_id, model, {r6('mae', 'mae')}, rank FROM chosen WHERE rank IS NULL OR rank <= 1"
)
def select_models(spark, folder):
    """Series too short for folds with 48 inputs have no scores and are not filtered."""
    cv = cross_validate(events_panel(spark, folder), BASELINES, horizon=6, input_size=48, n_windows=3)
    predictions = event_predictions(spark, folder)
    return selection.select_models(predictions, scoring.score(cv), max_mae=40.0, top_n=1)


PREDICTION_COLUMNS = "SELECT model, unique_id, ds, " + r6("y_hat", "y_hat") + " FROM predictions"


@query(
    with_(*EVENT_FUTURE, *EVENT_CV[2:], scores(), SUMMARY)
    + PREDICTION_COLUMNS
    + " WHERE model IN (SELECT model FROM summary WHERE metric = 'mae' ORDER BY mean, model LIMIT 1)"
)
def usable_models(spark, folder):
    best = selection.best_models(event_summary(spark, folder), 1)
    return selection.usable_models(event_predictions(spark, folder), best)


@query(with_(*EVENT_FUTURE) + PREDICTION_COLUMNS)
def usable_models_fallback(spark, folder):
    """None of the best models has forecasts: all models stay."""
    best = selection.best_models(event_summary(spark, folder), 2).withColumn(
        "model", F.concat("model", F.lit("_other"))
    )
    return selection.usable_models(event_predictions(spark, folder), best)


@query(
    with_(EVENTS, RANKED)
    + "SELECT m.model, s.unique_id FROM (SELECT DISTINCT unique_id, n FROM ranked) s, "
    "(VALUES ('Naive'), ('WindowAverage'), ('Other')) m(model) WHERE n < 64 OR m.model = 'Other'"
)
def missing_pairs(spark, folder):
    """Series too short for the shape have no forecasts, and one model was never run."""
    panel = events_panel(spark, folder)
    cv = cross_validate(panel, BASELINES, horizon=2, input_size=60, n_windows=2)
    return selection.missing_pairs(panel, [*NAMES, "Other"], cv)


@query(with_(*EVENT_FUTURE) + PREDICTION_COLUMNS)
def drop_empty_models(spark, folder):
    rows = event_predictions(spark, folder)
    empty = rows.where("model = 'Naive'").select(
        F.lit("Empty").alias("model"), "unique_id", "ds",
        F.when(F.col("y_hat") > 50, F.lit(float("nan"))).alias("y_hat"),
    )
    return selection.drop_empty_models(rows.unionByName(empty))


RUNS = """results AS (
  SELECT 'run_b' AS run_id, model, unique_id, ds, y, y_hat FROM cv
  UNION ALL
  SELECT 'run_a', model, unique_id, ds, y, y_hat FROM cv WHERE model = 'Naive' AND fold = 1)"""


def stored_runs(spark, folder):
    """Two runs in one stored table, partitioned by run and model."""
    cv = event_cv(spark, folder)
    first = cv.where("model = 'Naive'").join(
        cv.groupBy("unique_id").agg(F.min("cutoff").alias("cutoff")), ["unique_id", "cutoff"]
    )
    path = shared_folder(spark)
    results.write_cv_results(first.withColumn("run_id", F.lit("run_a")), path)
    results.write_cv_results(cv.withColumn("run_id", F.lit("run_b")), path)
    return spark.read.parquet(path)


@query(
    with_(*EVENT_CV, RUNS)
    + "SELECT run_id, count(DISTINCT model) AS n_models, count(DISTINCT unique_id) AS n_series, "
    "count(*) AS n_rows, min(ds) AS ds_min, max(ds) AS ds_max FROM results GROUP BY run_id"
)
def run_overview(spark, folder):
    return runs.run_overview(stored_runs(spark, folder))


@query(
    with_(*EVENT_CV, RUNS)
    + f"SELECT run_id, model, unique_id, ds, {r6('y', 'y')}, {r6('y_hat', 'y_hat')} FROM results "
    "WHERE run_id = (SELECT max(run_id) FROM results)"
)
def latest_run_results(spark, folder):
    return runs.latest_run_results(stored_runs(spark, folder)).drop("cutoff")


@query(
    with_(*EVENT_CV)
    + "SELECT model, count(DISTINCT unique_id) AS n_series, count(*) AS n_rows FROM cv GROUP BY model"
)
def trained_models(spark, folder):
    return runs.trained_models(event_cv(spark, folder))


def exported_cv(spark, folder):
    """One CSV per model; the variant keeps the base model's column name."""
    path = shared_folder(spark)
    cv = store(event_cv(spark, folder))
    results.export_by_model(cv, path, results.CV_PREFIX, NAMES)
    variant = cv.where("model = 'Naive'").withColumnRenamed("y_hat", "Naive").drop("model")
    variant.write.option("timestampNTZFormat", results.TIME_FORMAT).csv(
        f"{path}/cv_results_Naive_exog.csv", header=True
    )
    return path


@query(
    with_(*EVENT_CV) + CV_COLUMNS + " UNION ALL "
    + CV_COLUMNS.replace("SELECT model", "SELECT 'Naive_exog'") + " WHERE model = 'Naive'"
)
def import_cv_results(spark, folder):
    return results.import_cv_results(spark, exported_cv(spark, folder)).frame


@query(with_(*EVENT_FUTURE) + PREDICTION_COLUMNS)
def import_predictions(spark, folder):
    path = shared_folder(spark)
    results.export_by_model(event_predictions(spark, folder), path, results.PREDICTION_PREFIX, NAMES)
    return results.import_predictions(spark, path).frame


@query(with_(*EVENT_METRICS) + "SELECT unique_id, metric, model, " + r6("value", "value") + " FROM metrics")
def read_metrics(spark, folder):
    path = shared_folder(spark)
    results.write_metrics(event_metrics(spark, folder), f"{path}/long", f"{path}/wide")
    return results.read_metrics(spark, f"{path}/wide")


@query(with_(*EVENT_SUMMARY) + f"SELECT model, metric, {r6('mean', 'mean')}, {r6('std', 'std')} FROM summary")
def read_summary(spark, folder):
    path = shared_folder(spark)
    results.write_summary(event_summary(spark, folder), path, "by_metric")
    return results.read_summary(spark, path)


@query(
    with_(*EVENT_SUMMARY)
    + f"SELECT model, metric, {r6('mean', 'mean')}, CAST(NULL AS DOUBLE) AS std FROM summary"
)
def read_summary_for_display(spark, folder):
    """The reshaped scores, one row per model, as one CSV file, read back."""
    path = shared_folder(spark)
    results.write_summary(event_summary(spark, folder), path, "means")
    return results.read_summary(spark, path)


@query(
    "SELECT 'cv_results_Bad.csv' AS file, 'missing columns: y' AS reason "
    "UNION ALL SELECT 'cv_results_Other.csv', 'missing columns: Other'"
)
def import_skips(spark, folder):
    """Files without a required column or a value column are reported, the others read."""
    path = exported_cv(spark, folder)
    rows = spark.read.csv(f"{path}/cv_results_Naive.csv", header=True)
    rows.drop("y").write.csv(f"{path}/cv_results_Bad.csv", header=True)
    rows.write.csv(f"{path}/cv_results_Other.csv", header=True)
    skipped = results.import_cv_results(spark, path).skipped
    found = [(file.rsplit("/", 1)[1], reason) for file, reason in skipped.items()]
    return spark.createDataFrame(found, "file string, reason string")


@query("SELECT 'mae' AS metric, CAST(5 AS BIGINT) AS n UNION ALL SELECT 'absent', 0")
def best_series_of_absent_metric(spark, folder):
    """A metric without rows gives no series, and no error."""
    metrics = event_metrics(spark, folder)
    counts = [
        selection.best_series(metrics, 5, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")
        for name in ("mae", "absent")
    ]
    return counts[0].unionByName(counts[1])


ACTUAL = (
    "SELECT unique_id, ds, 'Actual' AS trace, {y}, strftime(ds, '%Y-%m-%d %H:%M:%S') || "
    "CASE WHEN microsecond(ds) % 1000000 <> 0 THEN '.' || strftime(ds, '%f') ELSE '' END AS tick "
    "FROM {source} WHERE {where}"
)
FORECAST = "SELECT unique_id, ds, {trace} AS trace, {y}, NULL AS tick FROM {source} WHERE {where}"


@query(
    with_(*EVENT_CV)
    + ACTUAL.format(y=r6("y", "value"), source="panel", where="unique_id IN (SELECT DISTINCT unique_id FROM cv ORDER BY unique_id LIMIT 3)")
    + " UNION ALL "
    + FORECAST.format(trace="'Predicted'", y=r6("y_hat", "value"), source="cv",
        where="model = 'Naive' AND unique_id IN (SELECT DISTINCT unique_id FROM cv ORDER BY unique_id LIMIT 3)")
)
def prediction_traces(spark, folder):
    return traces.prediction_traces(events_panel(spark, folder), event_cv(spark, folder), "Naive")


ONE_SERIES = "unique_id = (SELECT max(unique_id) FROM panel)"


@query(
    with_(*EVENT_FUTURE, *EVENT_CV[2:], scores())
    + ACTUAL.format(y=r6("y", "value"), source="panel", where=ONE_SERIES)
    + " UNION ALL "
    + FORECAST.format(trace="model", y=r6("y_hat", "value"), source="predictions", where=ONE_SERIES
        + " AND model = (SELECT model FROM metrics WHERE metric = 'mae' AND " + ONE_SERIES + " ORDER BY value, model LIMIT 1)")
)
def comparison_traces(spark, folder):
    panel = events_panel(spark, folder)
    one = panel.select(F.max("unique_id")).first()[0]
    return traces.comparison_traces(
        panel, event_predictions(spark, folder), one, metrics=event_metrics(spark, folder), top_n=1,
        models=NAMES,
    )


DASHBOARD = """shown AS (
  SELECT unique_id, row_number() OVER (ORDER BY unique_id) AS panel_no
  FROM (SELECT DISTINCT unique_id FROM panel ORDER BY unique_id LIMIT 5) ids)"""


@query(
    with_(*EVENT_FUTURE, DASHBOARD)
    + "SELECT t.*, s.panel_no, CAST(CASE trace WHEN 'Naive' THEN 0 WHEN 'WindowAverage' THEN 1 END AS BIGINT) AS model_no FROM ("
    + ACTUAL.format(y=r6("y", "value"), source="panel", where="true") + " UNION ALL "
    + FORECAST.format(trace="model", y=r6("y_hat", "value"), source="predictions", where="true")
    + ") t JOIN shown s ON s.unique_id = t.unique_id"
)
def dashboard_traces(spark, folder):
    return traces.dashboard_traces(events_panel(spark, folder), event_predictions(spark, folder))


@query(
    with_(*EVENT_SUMMARY)
    + f"SELECT model, {MEANS} FROM summary GROUP BY model UNION ALL "
    f"SELECT 'Naive_exog', {MEANS} FROM summary WHERE model = 'Naive'"
)
def summarize(spark, folder):
    return run_summarize(spark, exported_cv(spark, folder)).board


PREDICT_JOB = """best AS (
  SELECT unique_id FROM metrics WHERE metric = 'mae' GROUP BY unique_id
  ORDER BY avg(value), unique_id LIMIT 1),
own AS (SELECT * FROM ranked WHERE unique_id = (SELECT unique_id FROM best)),
seen AS (SELECT *, row_number() OVER (ORDER BY ds DESC) AS s FROM own WHERE n < 48 OR n - 6 < 24 OR r > 6),
ahead AS (
  SELECT max(ds) AS cutoff, max(CASE WHEN s = 1 THEN y END) AS last_y, avg(y) AS mean_y
  FROM seen WHERE s <= 24),
forecasts AS (
  SELECT unique_id, 'Naive' AS model, cutoff + i * INTERVAL '5 minutes' AS ds, last_y AS y_hat
  FROM best, ahead, range(1, 7) steps(i)
  UNION ALL
  SELECT unique_id, 'WindowAverage', cutoff + i * INTERVAL '5 minutes', mean_y
  FROM best, ahead, range(1, 7) steps(i))"""


@query(
    with_(*EVENT_METRICS, PREDICT_JOB)
    + ACTUAL.format(y=r6("y", "value"), source="own", where="n < 48 OR r <= 48") + " UNION ALL "
    + FORECAST.format(trace="model", y=r6("y_hat", "value"), source="forecasts", where="true")
)
def predict_job(spark, folder):
    """Best series by MAE, best models by leaderboard, hold-out, forecasts, chart table."""
    metrics = store(event_metrics(spark, folder))
    job = run_predict_job(
        events_panel(spark, folder), BASELINES, metrics=metrics, summary=scoring.leaderboard(metrics),
        pick="best", horizon=6, input_size=24, freq=timedelta(minutes=5),
    )
    return job.traces


def stored_states(spark, folder):
    """One stored score state per third of the forecasts, as if of three months."""
    cv = store(event_cv(spark, folder))
    third = F.pmod(F.xxhash64("unique_id", "ds"), F.lit(3))
    return [store(scoring.score_state(cv.where(third == i))) for i in range(3)]


@query(with_(*EVENT_CV, scores()) + METRIC_COLUMNS)
def score_of_merged_states(spark, folder):
    """Scores of all forecasts from states of their parts; forecasts are not read again."""
    return scoring.state_metrics(scoring.merge_states(*stored_states(spark, folder)))


@query(
    with_(*EVENT_CV, scores(), SUMMARY)
    + f"SELECT model, metric, {r6('mean', 'mean')}, {r6('std', 'std')}, n_series FROM summary"
)
def leaderboard_of_merged_states(spark, folder):
    """The leaderboard of all series from those of two sets of series."""
    metrics = store(scoring.score(event_cv(spark, folder)))
    states = [store(scoring.board_state(metrics.where(F.col("unique_id") % 4 == 0))),
              store(scoring.board_state(metrics.where(F.col("unique_id") % 4 > 0)))]
    return scoring.board_of_state(scoring.merge_boards(*states))
