"""From stored scores to forecasts and chart data of chosen models and series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcast.operators.forecast import Forecaster, Naive, WindowAverage, run_inference
from rollcast.operators.linear import models_from_params
from rollcast.operators.selection import (
    DEFAULT_TOP_MODELS,
    best_models,
    pick_best_series,
    sample_series,
)
from rollcast.operators.series import ID
from rollcast.operators.traces import comparison_traces
from rollcast.operators.windows import (
    DEFAULT_FREQ,
    DEFAULT_HORIZON,
    DEFAULT_INPUT_SIZE,
    DEFAULT_PLOT_POINTS,
    inference_frame,
)
from rollcast.plans.backtest import Backtest, open_run
from rollcast.sources.results import write_predictions
from rollcast.sources.scratch import store


@dataclass(frozen=True)
class Prediction:
    """``unique_id`` is None and ``traces`` missing when all series were forecast."""

    models: list[str]
    unique_id: object
    predictions: DataFrame
    traces: DataFrame | None


def choose_models(
    available: Sequence[Forecaster], summary: DataFrame | None, wanted: Sequence[str] | None,
    top_n: int = DEFAULT_TOP_MODELS,
) -> list[Forecaster]:
    """The requested models; else the best ones that are available; else all."""
    by_name = {m.name: m for m in available}
    if wanted is not None:
        absent = [name for name in wanted if name not in by_name]
        if absent:
            raise ValueError(f"not available: {', '.join(absent)}")
        return [by_name[name] for name in wanted]
    best = [] if summary is None else [r["model"] for r in best_models(summary, top_n).collect()]
    return [by_name[name] for name in best if name in by_name] or list(available)


def predict_job(
    panel: DataFrame, available: Sequence[Forecaster], *, metrics: DataFrame | None = None,
    summary: DataFrame | None = None, models: Sequence[str] | None = None,
    unique_id: object = None, pick: str | None = None, seed: int = 0,
    horizon: int = DEFAULT_HORIZON, input_size: int = DEFAULT_INPUT_SIZE,
    plot_points: int = DEFAULT_PLOT_POINTS, freq: timedelta = DEFAULT_FREQ,
    max_mae: float | None = None, top_n: int | None = None,
) -> Prediction:
    """Forecast one series (given, ``pick='best'`` or ``pick='random'``) or all.

    For one series the last ``horizon`` rows are held out, so that its forecasts
    cover rows that are known; ``traces`` puts both side by side.
    """
    chosen = choose_models(available, summary, models)
    if unique_id is None and pick is not None:
        if metrics is None:
            raise ValueError("picking a series needs metrics")
        if pick == "best":
            unique_id = pick_best_series(metrics)
        elif pick == "random":
            unique_id = sample_series(metrics, seed).first()[ID]
        else:
            raise ValueError(f"pick must be best or random, not {pick}")
    sizes = {"horizon": horizon, "input_size": input_size}
    if unique_id is None:
        forecasts = run_inference(panel, chosen, freq=freq, **sizes)
        return Prediction([m.name for m in chosen], None, forecasts, None)

    tagged = inference_frame(panel.where(F.col(ID) == unique_id), plot_points=plot_points, **sizes)
    # The charted rows and the forecasts are small and read several times below.
    shown = store(tagged.where("for_plot").drop("for_inference", "for_plot"))
    if shown.isEmpty():
        raise ValueError(f"no rows for series {unique_id}")
    seen = tagged.where("for_inference").drop("for_inference", "for_plot")
    forecasts = store(run_inference(seen, chosen, freq=freq, **sizes))
    traces = comparison_traces(
        shown, forecasts, unique_id, metrics=metrics, max_mae=max_mae, top_n=top_n
    )
    return Prediction([m.name for m in chosen], unique_id, forecasts, traces)


# Models without parameters, by their usual names.
PLAIN = {model.name: model for model in (Naive(), WindowAverage())}


def stored_models(run: Backtest, others: Sequence[Forecaster] = ()) -> list[Forecaster]:
    """The models of a stored run that can forecast: fitted ones from their coefficients.

    ``others`` are user functions, which no table can hold; those of the run's models
    that are neither fitted, plain nor given are left out.
    """
    known = dict(PLAIN)
    if run.params is not None:
        known |= {m.name: m for m in models_from_params(run.params)}
    known |= {m.name: m for m in others}
    names = run.settings.first()["models"]
    return [known[name] for name in names if name in known]


def predict_stored(
    panel: DataFrame, folder: str, *, run_id: str | None = None, others: Sequence[Forecaster] = (), **options
) -> Prediction:
    """Forecast from what a folder of stored runs holds, and store the forecasts there.

    The run (by default the greatest published one) gives the models, their scores, and the
    shape they were tested with; options as in ``predict_job``.  Forecasts go to the run's
    table ``predictions``, replacing those of the same models.
    """
    spark = panel.sparkSession
    run = open_run(spark, folder, run_id)
    settings = run.settings.first()
    shape = {"horizon": settings["horizon"], "input_size": settings["input_size"]}
    job = predict_job(
        panel, stored_models(run, others), metrics=run.metrics, summary=run.summary, **{**shape, **options}
    )
    of_run = {"run_id": F.lit(run.run_id), "generation": F.lit(run.generation)}
    write_predictions(job.predictions.withColumns(of_run), f"{folder}/predictions")
    stored = open_run(spark, folder, run.run_id).predictions
    return replace(job, predictions=stored.where(F.col("model").isin(job.models)))
