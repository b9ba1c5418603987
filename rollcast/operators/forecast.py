"""Forecasters and the operators that run them over folds or into the future."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import timedelta
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcast.operators.linear import LinearModel, LinearSpec, fit_linear
from rollcast.operators.series import ID, KEYS, TS, Y, SeriesLayout, measure_series, with_rank_from_end
from rollcast.operators.windows import (
    DEFAULT_FREQ,
    DEFAULT_HORIZON,
    DEFAULT_INPUT_SIZE,
    DEFAULT_WINDOWS,
    cv_origins,
    fold_count,
    forecast_origins,
    tested_rows,
)


@dataclass(frozen=True)
class Naive:
    """Repeat the last value."""

    name: str = "Naive"
    exogenous: tuple[str, ...] = ()

    def forecast(self, horizon: int) -> Column:
        return F.array_repeat(F.element_at("lags", -1), horizon)


@dataclass(frozen=True)
class WindowAverage:
    """Repeat the mean of the input window."""

    name: str = "WindowAverage"
    exogenous: tuple[str, ...] = ()

    def forecast(self, horizon: int) -> Column:
        total = F.aggregate("lags", F.lit(0.0), lambda acc, x: acc + x)
        return F.array_repeat(total / F.size("lags"), horizon)


@dataclass(frozen=True)
class LocalForecaster:
    """A user function ``(lags, horizon) -> horizon values``, applied to each input window.

    It sees one window of one series at a time (a local model, never a whole
    series).  A window on which it fails gives NULL forecasts and an error text,
    and the other windows go on.
    """

    name: str
    function: Callable[[np.ndarray, int], Sequence[float]]
    exogenous: tuple[str, ...] = ()

    def forecast_or_error(self, horizon: int) -> Column:
        function = self.function

        @F.pandas_udf("y_hat array<double>, error string")
        def run(lags: pd.Series) -> pd.DataFrame:
            values, errors = [], []
            for window in lags:
                try:
                    result = np.asarray(function(np.asarray(window, dtype=float), horizon), dtype=float)
                    if result.shape != (horizon,):
                        raise ValueError(f"expected {horizon} values, got shape {result.shape}")
                    values.append(result.tolist())
                    errors.append(None)
                except Exception as error:  # noqa: BLE001 - any failure of user code is recorded
                    values.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            return pd.DataFrame({"y_hat": values, "error": errors})

        return run("lags")


@dataclass(frozen=True)
class SeriesForecaster:
    """A user model that is fitted to each series by itself: once, on the rows before all folds.

    ``fit(history)`` gets a series' rows as a pandas frame (``ds, y`` and the exogenous
    columns, oldest first) and returns a state.  ``forecast(state, past, times)`` returns a
    value for each of ``times``, given the rows up to a fold's cutoff.

    A task holds one series at a time, and of it the last ``max_rows`` rows: a longer one
    is fitted on these and reported as ``bounded``.  A failing fit fails all folds of its
    series, a failing forecast its fold; other series go on.
    """

    name: str
    fit: Callable[[pd.DataFrame], object]
    forecast: Callable[[object, pd.DataFrame, Sequence], Sequence[float]]
    max_rows: int = 10_000
    exogenous: tuple[str, ...] = ()


Forecaster = Naive | WindowAverage | LinearModel | LocalForecaster | SeriesForecaster
Spec = Forecaster | LinearSpec


def used_exogenous(models: Sequence[Spec]) -> list[str]:
    """Exogenous columns that at least one model reads."""
    return sorted({name for model in models for name in model.exogenous})


def fit_all(
    panel: DataFrame, models: Sequence[Spec], *, horizon: int, input_size: int, hold_out: int = 0,
    layout: SeriesLayout | None = None,
) -> list[Forecaster]:
    """Replace the linear specs by fitted models; the other forecasters need no fit."""
    specs = [m for m in models if isinstance(m, LinearSpec)]
    fitted = {}
    if specs:
        fitted = {
            m.name: m
            for m in fit_linear(
                panel, specs, input_size=input_size, horizon=horizon, hold_out=hold_out, layout=layout
            )
        }
    return [fitted.get(m.name, m) if isinstance(m, LinearSpec) else m for m in models]


def run_models(origins: DataFrame, models: Sequence[Forecaster], horizon: int) -> DataFrame:
    """Apply all models to all origins in one pass.

    One row per model and origin: ``model, unique_id, [fold,] cutoff, steps,
    y_hat array<double>, error, note``.  ``error`` is NULL where the model worked.
    """
    results = []
    for model in models:
        if isinstance(model, LocalForecaster):
            outcome = model.forecast_or_error(horizon)
            y_hat, error = outcome["y_hat"], outcome["error"]
        else:
            y_hat, error = model.forecast(horizon), F.lit(None).cast("string")
        results.append(F.struct(F.lit(model.name).alias("model"), y_hat.alias("y_hat"), error.alias("error")))
    kept = [c for c in (ID, "fold", "cutoff", "steps") if c in origins.columns]
    spread = origins.select(*kept, F.explode(F.array(*results)).alias("r"))
    return spread.select("r.model", *kept, "r.y_hat", "r.error", F.lit(None).cast("string").alias("note"))


def _outcome(model: SeriesForecaster, state: object, past: pd.DataFrame, times: Sequence) -> tuple[list | None, str | None]:
    """Forecasts of one fold, or why there are none."""
    try:
        values = np.asarray(model.forecast(state, past, times), dtype=float)
        if values.shape != (len(times),):
            raise ValueError(f"expected {len(times)} values, got shape {values.shape}")
        return values.tolist(), None
    except Exception as error:  # noqa: BLE001 - any failure of user code is recorded
        return None, f"{type(error).__name__}: {error}"


def _fitted(model: SeriesForecaster, history: pd.DataFrame) -> tuple[object, str | None]:
    try:
        return model.fit(history), None
    except Exception as error:  # noqa: BLE001
        return None, f"{type(error).__name__}: {error}"


def _tails(panel: DataFrame, model: SeriesForecaster, layout: SeriesLayout | None) -> DataFrame:
    """The rows a task needs of each series, and one more that tells that there are more."""
    return with_rank_from_end(panel.select(ID, TS, Y, *model.exogenous), layout, last=model.max_rows + 1)


def _run_schema(panel: DataFrame, fold: bool) -> T.StructType:
    steps = T.ArrayType(T.StructType([panel.schema[TS], T.StructField(Y, T.DoubleType())]))
    fields = [T.StructField("model", T.StringType()), T.StructField(ID, panel.schema[ID].dataType)]
    fields += [T.StructField("fold", T.IntegerType())] if fold else []
    return T.StructType(fields + [
        T.StructField("cutoff", panel.schema[TS].dataType), T.StructField("steps", steps),
        T.StructField("y_hat", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType()),
        T.StructField("note", T.StringType()),
    ])


def series_runs(
    panel: DataFrame, model: SeriesForecaster, *, horizon: int, input_size: int,
    n_windows: int | None = DEFAULT_WINDOWS, step: int | None = None, test_size: int | None = None,
    layout: SeriesLayout | None = None,
) -> DataFrame:
    """Fit a model to each series and forecast all its folds; shaped like ``run_models``.

    Series without ``input_size`` rows before the folds are left out, as in ``cv_origins``.
    """
    step = step or horizon
    folds = fold_count(horizon, step, n_windows, test_size)
    tested = tested_rows(horizon, step, folds)
    if model.max_rows < input_size + tested:
        raise ValueError(f"{model.name}: max_rows must be {input_size + tested} or more")
    schema = _run_schema(panel, fold=True)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank_from_end", ascending=False, ignore_index=True)
        note = None
        if len(rows) > model.max_rows:
            rows = rows.iloc[len(rows) - model.max_rows :].reset_index(drop=True)
            note = f"fitted on the last {model.max_rows} rows"
        uid, first, out = rows[ID].iloc[0], len(rows) - tested, []
        rows = rows.drop(columns=[ID, "rank_from_end"])
        if first < input_size:
            return pd.DataFrame(out, columns=schema.names)
        state, failed = _fitted(model, rows.iloc[:first])
        for fold in range(folds):
            start = first + fold * step
            ahead = rows.iloc[start : start + horizon]
            steps = [{TS: t, Y: None if pd.isna(y) else float(y)} for t, y in zip(ahead[TS], ahead[Y])]
            values, error = (None, failed) if failed else _outcome(model, state, rows.iloc[:start], list(ahead[TS]))
            out.append((model.name, uid, fold + 1, rows[TS].iloc[start - 1], steps, values, error, note))
        return pd.DataFrame(out, columns=schema.names)

    return _tails(panel, model, layout).groupBy(ID).applyInPandas(run, schema)


def series_inference(
    panel: DataFrame, model: SeriesForecaster, *, horizon: int, input_size: int, freq: timedelta = DEFAULT_FREQ,
    layout: SeriesLayout | None = None,
) -> DataFrame:
    """Fit a model to each series and forecast after its last row; shaped like ``run_models``."""
    schema = _run_schema(panel, fold=False)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank_from_end", ascending=False, ignore_index=True)
        note = f"fitted on the last {model.max_rows} rows" if len(rows) > model.max_rows else None
        rows = rows.iloc[-model.max_rows :].reset_index(drop=True)
        uid = rows[ID].iloc[0]
        rows = rows.drop(columns=[ID, "rank_from_end"])
        if len(rows) < input_size:
            return pd.DataFrame([], columns=schema.names)
        cutoff = rows[TS].iloc[-1]
        times = [cutoff + i * freq for i in range(1, horizon + 1)]
        state, failed = _fitted(model, rows)
        values, error = (None, failed) if failed else _outcome(model, state, rows, times)
        steps = [{TS: t, Y: None} for t in times]
        return pd.DataFrame([(model.name, uid, cutoff, steps, values, error, note)], columns=schema.names)

    return _tails(panel, model, layout).groupBy(ID).applyInPandas(run, schema)


def forecast_rows(runs: DataFrame) -> DataFrame:
    """One row per forecast step; a failed origin keeps its rows with NULL forecasts."""
    step = F.posexplode("steps").alias("pos", "step")
    return runs.select("model", ID, "cutoff", "y_hat", step).select(
        "model", ID, F.col("step")[TS].alias(TS), "cutoff", F.col("step")[Y].alias(Y),
        F.get("y_hat", F.col("pos")).alias("y_hat"),
    )


def cross_validate(
    panel: DataFrame, models: Sequence[Spec], *, horizon: int = DEFAULT_HORIZON,
    input_size: int = DEFAULT_INPUT_SIZE, n_windows: int | None = DEFAULT_WINDOWS,
    step: int | None = None, test_size: int | None = None, layout: SeriesLayout | None = None,
) -> DataFrame:
    """Rolling-origin forecasts: ``model, unique_id, ds, cutoff, y, y_hat``.

    Models are fitted once, on the rows before all folds; the input window rolls
    forward with each fold.
    """
    layout = layout or measure_series(panel)
    runs = cv_runs(
        panel, models, horizon=horizon, input_size=input_size, n_windows=n_windows, step=step,
        test_size=test_size, layout=layout,
    )
    return forecast_rows(runs)


def cv_runs(
    panel: DataFrame, models: Sequence[Spec], *, horizon: int, input_size: int,
    n_windows: int | None, step: int | None, test_size: int | None, layout: SeriesLayout,
) -> DataFrame:
    """``cross_validate`` before its rows are spread out: one row per model, series and fold."""
    hold_out = tested_rows(horizon, step or horizon, n_windows, test_size)
    fitted = fit_all(
        panel, models, horizon=horizon, input_size=input_size, hold_out=hold_out, layout=layout
    )
    shape = {"horizon": horizon, "input_size": input_size, "n_windows": n_windows, "step": step, "test_size": test_size}
    return cv_group(panel, fitted, layout=layout, **shape)


def cv_group(panel: DataFrame, models: Sequence[Forecaster], *, horizon: int, **shape) -> DataFrame:
    """Forecasts of fitted models: one pass for all that see windows, one for each that sees series."""
    windowed = [m for m in models if not isinstance(m, SeriesForecaster)]
    runs = [series_runs(panel, m, horizon=horizon, **shape) for m in models if isinstance(m, SeriesForecaster)]
    if windowed:
        origins = cv_origins(panel, horizon=horizon, exogenous=used_exogenous(windowed), **shape)
        runs.append(run_models(origins, windowed, horizon))
    return reduce(DataFrame.unionByName, runs)


def unusable(
    panel: DataFrame, models: Sequence[Spec], *, horizon: int, input_size: int
) -> dict[str, str]:
    """Why models cannot run on this panel with this shape, by model name."""
    reasons = {}
    for model in models:
        absent = [c for c in model.exogenous if c not in panel.columns]
        if absent:
            reasons[model.name] = f"missing columns: {', '.join(absent)}"
        elif isinstance(model, LinearModel) and model.horizon != horizon:
            reasons[model.name] = f"fitted for {model.horizon} steps, not {horizon}"
        elif isinstance(model, LinearModel) and model.input_size != input_size:
            reasons[model.name] = f"fitted for {model.input_size} input rows, not {input_size}"
    return reasons


def inference_runs(
    panel: DataFrame, models: Sequence[Forecaster], *, horizon: int = DEFAULT_HORIZON,
    input_size: int = DEFAULT_INPUT_SIZE, freq: timedelta = DEFAULT_FREQ,
    layout: SeriesLayout | None = None,
) -> tuple[DataFrame, dict[str, str]]:
    """One row per usable model and series, and the reasons of the models left out."""
    reasons = unusable(panel, models, horizon=horizon, input_size=input_size)
    usable = [m for m in models if m.name not in reasons]
    if not usable:
        raise ValueError(f"no usable model: {reasons}")
    shape = {"horizon": horizon, "input_size": input_size, "freq": freq, "layout": layout}
    windowed = [m for m in usable if not isinstance(m, SeriesForecaster)]
    runs = [series_inference(panel, m, **shape) for m in usable if isinstance(m, SeriesForecaster)]
    if windowed:
        origins = forecast_origins(panel, exogenous=used_exogenous(windowed), **shape)
        runs.append(run_models(origins, windowed, horizon))
    return reduce(DataFrame.unionByName, runs), reasons


def run_inference(panel: DataFrame, models: Sequence[Forecaster], **options) -> DataFrame:
    """Forecasts of several fitted models after the last row of every series.

    Columns: ``model, unique_id, ds, y_hat``; options as in ``inference_runs``.  A model
    that cannot run is left out (``inference_status`` tells why) unless none can.
    """
    runs, _ = inference_runs(panel, models, **options)
    return forecast_rows(runs).select("model", ID, TS, "y_hat")


def inference_status(runs: DataFrame, reasons: dict[str, str]) -> DataFrame:
    """Per model: on how many series it worked and failed, and an error text."""
    worked = runs.groupBy("model").agg(
        F.count_if(F.col("error").isNull()).alias("n_ok"),
        F.count_if(F.col("error").isNotNull()).alias("n_failed"),
        F.min("error").alias("error"),
    )
    left_out = [(name, 0, 0, reason) for name, reason in reasons.items()]
    schema = "model string, n_ok bigint, n_failed bigint, error string"
    return worked.unionByName(runs.sparkSession.createDataFrame(left_out, schema))


def predict(panel: DataFrame, model: Forecaster, **options) -> DataFrame:
    """Forecasts of one fitted model; options as in ``run_inference``."""
    return run_inference(panel, [model], **options)


def attach_actuals(forecasts: DataFrame, panel: DataFrame) -> DataFrame:
    """Add the observed ``y`` to forecasts; rows without an observation drop out.

    The first and last time of the forecasts go to the panel's scan as soon as they are
    known, so history before them is not shuffled (nor read, where the format can filter
    by the type of ``ds``).  That looks at the forecasts again: they should be a stored frame.
    """
    first = forecasts.agg(F.min(TS)).scalar()
    # Not a maximum: Spark would merge two aggregates into one, which it does not push down.
    last = forecasts.select(TS).orderBy(F.col(TS).desc_nulls_last()).limit(1).scalar()
    ahead = F.col(TS).between(first, last)
    return forecasts.drop(Y).join(panel.where(ahead).select(ID, TS, Y), list(KEYS), "inner")


def fit_status(runs: DataFrame) -> DataFrame:
    """Outcome per model and series: ``status`` ok, bounded or failed, and the first error text.

    ``bounded`` series had more rows than their model takes; the text tells how many it took.
    """
    failed, bounded = F.max("error").isNotNull(), F.max("note").isNotNull()
    first = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("cutoff")))
    return runs.groupBy("model", ID).agg(
        F.when(failed, "failed").when(bounded, "bounded").otherwise("ok").alias("status"),
        F.coalesce(first, F.max("note")).alias("error"),
    )


def fit_summary(status: DataFrame) -> DataFrame:
    """Counts per model and status."""
    return status.groupBy("model", "status").agg(F.count(F.lit(1)).alias("n_series"))
