"""Scores per series, leaderboards, and moving between long and wide layouts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcast.functions import fraction_error, missing_to_null, percent_error
from rollcast.operators.series import ID, Y

METRICS = ("mae", "mse", "rmse", "mape")
MAX_MODELS = 1000


def model_names(frame: DataFrame, column: str = "model") -> list[str]:
    """Sorted distinct names, for building a view with one column per name."""
    found = [r[0] for r in frame.select(column).distinct().limit(MAX_MODELS + 1).collect()]
    if len(found) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} values of {column}: keep the long layout")
    return sorted(name for name in found if name is not None)


def score(forecasts: DataFrame, *, mape: str = "percent") -> DataFrame:
    """MAE, MSE, RMSE and MAPE of every model on every series, in one aggregation.

    Columns: ``[run_id,] model, unique_id, n_scored, metric, value``.  Missing
    forecasts (NULL or NaN) are skipped and not counted in ``n_scored``.  MAPE is in
    ``percent`` (0/0 is NaN, e/0 infinite) or a ``fraction`` (zero targets skipped).
    """
    return state_metrics(score_state(forecasts, mape=mape))


# What a score state counts and sums, beside its keys.
STATE = ("n_scored", "sum_abs", "sum_square", "n_share", "sum_share")


def score_state(forecasts: DataFrame, *, mape: str = "percent") -> DataFrame:
    """Counts and sums of the errors of every model on every series.

    States of parts of the forecasts (folds, months, runs) add up with ``merge_states``;
    ``state_metrics`` turns a state into the scores of all its forecasts.  So stored states
    replace another scan of the forecasts.  ``mape`` is as in ``score`` and must be the
    same for all parts.
    """
    errors = {"percent": percent_error, "fraction": fraction_error}
    if mape not in errors:
        raise ValueError(f"mape must be one of {sorted(errors)}")
    y, err = F.col(Y), F.col("err")
    keys = [c for c in ("run_id", "model", ID) if c in forecasts.columns]
    share = F.when(err.isNotNull(), errors[mape](y, err))
    return (
        forecasts.withColumn("err", y - missing_to_null(F.col("y_hat")))
        .groupBy(*keys)
        .agg(
            F.count("err").alias("n_scored"),
            F.sum(F.abs(err)).alias("sum_abs"),
            F.sum(err * err).alias("sum_square"),
            F.count(share).alias("n_share"),
            F.sum(share).alias("sum_share"),
        )
    )


def merge_states(*states: DataFrame, by: Sequence[str] = ("model", ID)) -> DataFrame:
    """One state of several; ``by`` names the keys to keep (leaving out ``run_id`` merges runs)."""
    every = reduce(DataFrame.unionByName, [s.select(*by, *STATE) for s in states])
    return every.groupBy(*by).agg(*[F.sum(name).alias(name) for name in STATE])


def state_metrics(state: DataFrame) -> DataFrame:
    """The scores of a state, shaped like those of ``score``."""
    keys = [c for c in state.columns if c not in STATE]
    mean = lambda total, n: F.try_divide(F.col(total), F.col(n))
    scored = state.select(
        *keys, "n_scored", mean("sum_abs", "n_scored").alias("mae"), mean("sum_square", "n_scored").alias("mse"),
        F.sqrt(mean("sum_square", "n_scored")).alias("rmse"), mean("sum_share", "n_share").alias("mape"),
    )
    return wide_to_long(scored, [*keys, "n_scored"], METRICS, name="metric")


def wide_to_long(
    wide: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, *,
    name: str = "model", value: str = "value",
) -> DataFrame:
    """One row per key and value column; by default all numeric columns beside the keys."""
    if columns is None:
        columns = [
            f.name for f in wide.schema.fields
            if f.name not in keys and isinstance(f.dataType, T.NumericType)
        ]
    if not columns:
        raise ValueError("no value columns")
    # Exploding an array keeps the partitioning of the frame, which unpivot does not.
    cells = [
        F.struct(F.lit(c).alias(name), F.col(f"`{c}`").cast("double").alias(value)) for c in columns
    ]
    return wide.select(*keys, F.inline(F.array(*cells)))


def metrics_wide(metrics: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """One column per model and one row per ``(unique_id, metric)``; gaps are NULL.

    A single aggregation instead of a chain of full outer joins.
    """
    return metrics.groupBy(ID, "metric").agg(*_column_per_model(metrics, models, "value"))


def predictions_wide(predictions: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """One column per model and one row per ``(unique_id, ds)``; gaps are NULL."""
    return predictions.groupBy(ID, "ds").agg(*_column_per_model(predictions, models, "y_hat"))


def _column_per_model(frame: DataFrame, models: Sequence[str] | None, value: str) -> list[Column]:
    """One conditional aggregate per model; a pivot would aggregate and shuffle twice."""
    names = list(models) if models is not None else model_names(frame)
    return [F.max(F.when(F.col("model") == name, F.col(value))).alias(name) for name in names]


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Mean and sample standard deviation over series: ``model, metric, mean, std, n_series``."""
    keys = [c for c in ("run_id", "model", "metric") if c in metrics.columns]
    return metrics.groupBy(*keys).agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.count("value").alias("n_series"),
    )


def board_state(metrics: DataFrame) -> DataFrame:
    """What a leaderboard needs of a set of series: ``model, metric, n, mean, m2``.

    ``m2`` is the sum of squared distances from the mean.  States of disjoint sets of series
    merge to that of all.
    """
    keys = [c for c in ("run_id", "model", "metric") if c in metrics.columns]
    return metrics.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2")
    )


def merge_boards(*states: DataFrame, by: Sequence[str] = ("model", "metric")) -> DataFrame:
    """The state of all series of several states.

    Means and distances are combined pairwise, so a mean far above the spread costs no
    digits.  A group has as many rows as states are merged.
    """
    known = F.col("n") > 0
    parts = F.struct(
        F.col("n").cast("double").alias("n"), F.when(known, F.col("mean")).otherwise(0.0).alias("mean"),
        F.when(known, F.col("m2")).otherwise(0.0).alias("m2"),
    )
    every = reduce(DataFrame.unionByName, [s.select(*by, parts.alias("part")) for s in states])

    def joined(a: Column, b: Column) -> Column:
        n, step = a["n"] + b["n"], b["mean"] - a["mean"]
        share = F.try_divide(b["n"], n)
        # Without rows on one side, the other is taken as it is.
        between = F.when(F.isnan(step), a["mean"] + b["mean"]).otherwise(a["mean"] + step * share)  # both infinite
        mean = F.when(a["n"] == 0, b["mean"]).when(b["n"] == 0, a["mean"]).otherwise(between)
        m2 = F.when(a["n"] == 0, b["m2"]).when(b["n"] == 0, a["m2"]).otherwise(a["m2"] + b["m2"] + step * step * a["n"] * share)
        return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))

    nothing = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    merged = every.groupBy(*by).agg(F.aggregate(F.collect_list("part"), nothing, joined).alias("s"))
    scored = F.col("s.n") > 0
    return merged.select(
        *by, F.col("s.n").cast("bigint").alias("n"), F.when(scored, F.col("s.mean")).alias("mean"),
        F.when(scored, F.col("s.m2")).alias("m2"),
    )


def board_of_state(state: DataFrame) -> DataFrame:
    """The leaderboard of a state, shaped like that of ``leaderboard``."""
    keys = [c for c in state.columns if c not in ("n", "mean", "m2")]
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return state.select(*keys, "mean", std.alias("std"), F.col("n").alias("n_series"))


def _only(metric: str, column: str) -> Column:
    return F.max(F.when(F.col("metric") == metric, F.col(column)))


def leaderboard_wide(summary: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per model with ``MAE_mean, MAE_std, ...``, best MAE first."""
    columns = [
        _only(metric, part).alias(f"{metric.upper()}_{part}")
        for metric in metrics
        for part in ("mean", "std")
    ]
    return _best_first(summary.groupBy("model").agg(*columns), "MAE_mean")


def leaderboard_means(summary: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per model with the mean of each metric (columns sorted), best MAE first."""
    columns = [_only(metric, "mean").alias(metric) for metric in sorted(metrics)]
    return _best_first(summary.groupBy("model").agg(*columns), "mae")


def leaderboard_by_metric(summary: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """One row per metric with ``<model>_mean`` and ``<model>_std`` columns."""
    names = list(models) if models is not None else model_names(summary)
    columns = [
        F.max(F.when(F.col("model") == name, F.col(part))).alias(f"{name}_{part}")
        for name in names
        for part in ("mean", "std")
    ]
    return summary.groupBy("metric").agg(*columns)


def reshape_summary(by_metric: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """From one row per metric to one row per model; standard deviations are dropped."""
    means = [c for c in by_metric.columns if c.endswith("_mean")]
    long = wide_to_long(by_metric, ["metric"], means).withColumn(
        "model", F.regexp_replace("model", "_mean$", "")
    )
    columns = [_only(metric, "value").alias(metric) for metric in metrics]
    return _best_first(long.groupBy("model").agg(*columns), "mae")


def model_ranking(by_metric: DataFrame, metric: str = "mae") -> DataFrame:
    """``model, <metric>`` from one row per metric, best first."""
    means = [c for c in by_metric.columns if c.endswith("_mean")]
    rows = wide_to_long(by_metric.where(F.col("metric") == metric), ["metric"], means, value=metric)
    named = rows.select(F.regexp_replace("model", "_mean$", "").alias("model"), metric)
    return _best_first(named, metric)


def _best_first(board: DataFrame, column: str) -> DataFrame:
    """Sort by a score where the board has it; ties by model name."""
    if column not in board.columns:
        return board
    return board.orderBy(F.col(column).asc_nulls_first(), "model")
