"""Back-test several models on one panel and keep the results as tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcast.operators.forecast import (
    LocalForecaster,
    SeriesForecaster,
    Spec,
    cv_group,
    fit_status,
    forecast_rows,
    unusable,
    used_exogenous,
)
from rollcast.operators.linear import (
    LinearSpec,
    params_frame,
    solve,
    window_factor,
)
from rollcast.operators.panel import profile_series
from rollcast.operators.score import leaderboard, score
from rollcast.operators.selection import missing_pairs
from rollcast.operators.series import ID, TS, Y, measure_series
from rollcast.operators.windows import (
    DEFAULT_HORIZON,
    DEFAULT_INPUT_SIZE,
    DEFAULT_WINDOWS,
    tested_rows,
)
from rollcast.sources.generations import current, new_generation, publish, read_current, remove_older
from rollcast.sources.results import write_cv_results, write_metrics, write_table
from rollcast.sources.scratch import remove_partitions, shared_folder, store

# Fixed value: the form of a run id.
RUN_ID_FORMAT = "run_%Y%m%d_%H%M%S"

FAILURE_SCHEMA = "run_id string, model string, stage string, error string"
SETTINGS_SCHEMA = (
    "run_id string, horizon int, input_size int, n_windows int, step int, test_size int, mape string, "
    "models array<string>"
)

TABLES = ("runs", "summary", "failures", "model_params", "fit_status", "metrics", "cv_results", "predictions")


@dataclass(frozen=True)
class Backtest:
    """Result tables of one run, read from ``folder``."""

    run_id: str
    generation: str
    folder: str
    cv_results: DataFrame
    metrics: DataFrame
    summary: DataFrame
    status: DataFrame
    params: DataFrame | None
    failures: DataFrame
    settings: DataFrame
    predictions: DataFrame | None = None


def new_run_id() -> str:
    return datetime.now().strftime(RUN_ID_FORMAT)


def backtest(
    panel: DataFrame, models: Sequence[Spec], *, run_id: str | None = None, folder: str | None = None,
    horizon: int = DEFAULT_HORIZON, input_size: int = DEFAULT_INPUT_SIZE,
    n_windows: int | None = DEFAULT_WINDOWS, step: int | None = None, test_size: int | None = None,
    mape: str = "fraction",
) -> Backtest:
    """Cross-validate every model, score it, and go on when one fails.

    The panel is stored and measured once for all models.  Linear models share one
    fitting pass, and all built-in models one forecasting pass; each user function
    runs as a job of its own, so that it cannot stop the others, and rows of a model that
    fails are removed.  Failures, leaderboard and settings are stored with the results.

    A repeated run replaces all that is stored under its id, at once, when it is complete:
    its tables are written as a new generation and published by one row.  If it is stopped,
    or no model succeeds, the run before it stays as it was.
    """
    spark = panel.sparkSession
    run_id = run_id or new_run_id()
    folder = folder or shared_folder(spark)
    names = [m.name for m in models]
    if len(set(names)) != len(names):
        raise ValueError(f"model names must differ: {names}")
    hold_out = tested_rows(horizon, step or horizon, n_windows, test_size)
    generation = new_generation()
    marked = lambda frame: frame.withColumns({"run_id": F.lit(run_id), "generation": F.lit(generation)})
    reasons = unusable(panel, models, horizon=horizon, input_size=input_size)
    failures = [(run_id, name, "prepare", reason) for name, reason in reasons.items()]
    models = [m for m in models if m.name not in reasons]
    stored = store(panel.select(ID, TS, Y, *used_exogenous(models)))
    layout = measure_series(stored)

    def failed(group: Sequence[Spec], stage: str, error: Exception) -> None:
        failures.extend((run_id, m.name, stage, f"{type(error).__name__}: {error}") for m in group)

    specs = [m for m in models if isinstance(m, LinearSpec)]
    fitted = []
    if specs:
        exogenous = used_exogenous(specs)
        size = {"input_size": input_size, "horizon": horizon, "exogenous": exogenous}
        try:
            factor = window_factor(stored, hold_out=hold_out, layout=layout, **size)
        except Exception as error:  # noqa: BLE001 - recorded, the other models go on
            failed(specs, "fit", error)
        else:
            for spec in specs:
                try:
                    fitted.append(solve(spec, factor, **size))
                except Exception as error:  # noqa: BLE001
                    failed([spec], "fit", error)

    user_made = LocalForecaster | SeriesForecaster
    local = [m for m in models if isinstance(m, user_made)]
    built_in = [m for m in models if not isinstance(m, user_made | LinearSpec)] + fitted
    finished = []
    for group in [built_in] * bool(built_in) + [[m] for m in local]:
        try:
            found = cv_group(
                stored, group, horizon=horizon, input_size=input_size, n_windows=n_windows, step=step,
                test_size=test_size, layout=layout,
            )
            runs = store(found)
            cv_results = marked(forecast_rows(runs))
            write_cv_results(cv_results, f"{folder}/cv_results")
            metrics = marked(score(cv_results.drop("generation"), mape=mape))
            write_metrics(metrics, f"{folder}/metrics")
            short = missing_pairs(profile_series(stored), [m.name for m in group], runs).select(
                "model", ID, F.lit("skipped").alias("status"),
                F.lit(f"fewer than {input_size + hold_out} rows").alias("error"),
            )
            write_table(marked(fit_status(runs).unionByName(short)), f"{folder}/fit_status")
            finished += [m.name for m in group]
        except Exception as error:  # noqa: BLE001
            failed(group, "cross-validation", error)
            for name in TABLES:
                keys = {"run_id": [run_id], "generation": [generation], "model": [m.name for m in group]}
                remove_partitions(spark, f"{folder}/{name}", keys)

    if not finished:
        raise RuntimeError(f"no model succeeded: {failures}")
    write_table(marked(spark.createDataFrame(failures, FAILURE_SCHEMA)), f"{folder}/failures", small=True)
    fitted = [m for m in fitted if m.name in finished]
    if fitted:
        write_table(marked(params_frame(spark, fitted, run_id)), f"{folder}/model_params", small=True)
    at = (run_id, generation)
    write_table(marked(leaderboard(read_current(spark, folder, "metrics", at))), f"{folder}/summary", small=True)
    settings = (run_id, horizon, input_size, n_windows, step, test_size, mape, finished)
    write_table(marked(spark.createDataFrame([settings], SETTINGS_SCHEMA)), f"{folder}/runs", small=True)
    # From here on this is what readers see; what it replaces may go.
    publish(spark, folder, run_id, generation)
    remove_older(spark, folder, TABLES, run_id, generation)
    return open_run(spark, folder, run_id)


def open_run(spark: SparkSession, folder: str, run_id: str | None = None) -> Backtest:
    """The stored tables of a published run; without an id, of the greatest one."""
    at = current(spark, folder, run_id)
    if at is None:
        raise ValueError(f"no published run {run_id or ''} in {folder}")
    tables = {name: read_current(spark, folder, name, at) for name in TABLES}
    params = tables["model_params"]
    failures = tables["failures"]
    if failures is None:
        failures = spark.createDataFrame([], FAILURE_SCHEMA)
    return Backtest(
        run_id=at[0],
        generation=at[1],
        folder=folder,
        cv_results=tables["cv_results"],
        metrics=tables["metrics"],
        summary=tables["summary"],
        status=tables["fit_status"],
        params=None if params is None or params.isEmpty() else params,
        failures=failures,
        settings=tables["runs"],
        predictions=tables["predictions"],
    )
