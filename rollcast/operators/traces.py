"""Long tables a chart can be drawn from: one row per point of a trace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcast.operators.selection import drop_empty_models, select_models
from rollcast.operators.series import ID, TS, Y

# Trace names and default numbers of panels.
ACTUAL, PREDICTED = "Actual", "Predicted"
DEFAULT_SERIES = 3
DEFAULT_PANELS = 5


def _tick(ds: Column) -> Column:
    """Label of a time point: seconds, and six digits of a fraction if there is one."""
    text = ds.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text)


def _actual(panel: DataFrame) -> DataFrame:
    tick = _tick(F.col(TS))
    return panel.select(
        ID, TS, F.lit(ACTUAL).alias("trace"), F.col(Y).alias("value"), tick.alias("tick")
    )


def _forecast(predictions: DataFrame, trace: Column) -> DataFrame:
    """Forecast points; tick labels come from the actual rows only."""
    return predictions.select(
        ID, TS, trace.alias("trace"), F.col("y_hat").alias("value"),
        F.lit(None).cast("string").alias("tick"),
    )


def _of_series(frame: DataFrame, ids: DataFrame) -> DataFrame:
    return frame.join(ids, ID, "left_semi")


def prediction_traces(
    panel: DataFrame, cv_results: DataFrame, model: str, max_series: int = DEFAULT_SERIES
) -> DataFrame:
    """Actual and predicted points of the first series that one model forecast."""
    mine = cv_results.where(F.col("model") == model)
    ids = mine.select(ID).distinct().orderBy(ID).limit(max_series)  # at most max_series rows
    return _actual(_of_series(panel, ids)).unionByName(
        _forecast(_of_series(mine, ids), F.lit(PREDICTED))
    )


def comparison_traces(
    panel: DataFrame, predictions: DataFrame, unique_id: object, *,
    models: Sequence[str] | None = None, metrics: DataFrame | None = None,
    max_mae: float | None = None, top_n: int | None = None,
) -> DataFrame:
    """One series with the forecasts of several models, one trace per model.

    With ``metrics``, models that ``select_models`` refuses are removed, then those
    without any present forecast.  Empty when no model is left or the series has
    no rows.
    """
    actual = panel.where(F.col(ID) == unique_id)
    chosen = predictions if models is None else predictions.where(F.col("model").isin(list(models)))
    own = chosen.where(F.col(ID) == unique_id)
    chosen = drop_empty_models(chosen).where(F.col(ID) == unique_id)
    if metrics is not None:
        scores = metrics.where(F.col(ID) == unique_id)
        kept = select_models(own, scores, max_mae=max_mae, top_n=top_n)
        chosen = chosen.join(kept.select(ID, "model"), [ID, "model"], "left_semi")
    has_rows = actual.select(F.count(F.lit(1)).alias("n")).scalar() > 0
    has_models = chosen.select(F.count(F.lit(1)).alias("n")).scalar() > 0
    return _actual(actual.where(has_models)).unionByName(
        _forecast(chosen.where(has_rows), F.col("model"))
    )


def dashboard_traces(
    panel: DataFrame, predictions: DataFrame, *, ids: Sequence[object] | None = None,
    max_series: int = DEFAULT_PANELS,
) -> DataFrame:
    """Several series with all models, with chart positions.

    ``panel_no`` numbers the series from 1 and ``model_no`` the models from 0
    (NULL for the actual trace).
    """
    if ids is None:
        first = panel.select(ID).distinct().orderBy(ID).limit(max_series)
        chosen = first.withColumn("panel_no", F.row_number().over(Window.orderBy(ID)))  # of max_series rows
    else:
        fields = [panel.schema[ID], T.StructField("panel_no", T.IntegerType())]
        numbered = [(i, n) for n, i in enumerate(dict.fromkeys(ids), 1)]
        chosen = panel.sparkSession.createDataFrame(numbered, T.StructType(fields))
    # One row per model: their numbers are ranks by name.
    models = predictions.select(F.col("model").alias("trace")).where("trace IS NOT NULL").distinct()
    numbers = models.withColumn("model_no", F.row_number().over(Window.orderBy("trace")) - 1)
    actual = _actual(panel).withColumn("model_no", F.lit(None).cast("int"))
    shown = _forecast(predictions, F.col("model")).join(numbers.where(F.col("trace") != ACTUAL), "trace", "left")
    return actual.unionByName(shown).join(chosen, ID).select(ID, TS, "trace", "value", "tick", "panel_no", "model_no")
