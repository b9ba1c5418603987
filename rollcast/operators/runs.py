"""Questions about stored result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcast.operators.series import ID, TS


def run_overview(results: DataFrame) -> DataFrame:
    """Models, series, rows and time range of every run, greatest run id first."""
    pairs = results.groupBy("run_id", "model", ID).agg(
        F.count(F.lit(1)).alias("rows"), F.min(TS).alias("first"), F.max(TS).alias("last")
    )
    return (
        pairs.groupBy("run_id")
        .agg(
            # A set of names: one distinct count more would double the rows.
            F.size(F.collect_set("model")).cast("bigint").alias("n_models"),
            F.countDistinct(ID).alias("n_series"),
            F.sum("rows").alias("n_rows"),
            F.min("first").alias("ds_min"),
            F.max("last").alias("ds_max"),
        )
        .orderBy(F.desc("run_id"))
    )


def latest_run_results(results: DataFrame) -> DataFrame:
    """Rows of the greatest run id (by name) that has results."""
    latest = results.select(F.max("run_id").alias("run_id")).scalar()
    return results.where(F.col("run_id") == latest)


def trained_models(results: DataFrame) -> DataFrame:
    """Models that have results, with their number of series and rows."""
    pairs = results.groupBy("model", ID).agg(F.count(F.lit(1)).alias("rows"))
    return (
        pairs.groupBy("model")
        .agg(F.count(F.lit(1)).alias("n_series"), F.sum("rows").alias("n_rows"))
        .orderBy("model")
    )


def run_list(settings: DataFrame, status: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """Every run with its shape and state, greatest run id first.

    ``horizon, input_size, n_models`` as set, ``has_models`` (coefficients are stored), and the
    numbers of pairs of model and series by outcome.
    """
    outcome = lambda name: F.count_if(F.col("status") == name).alias(f"n_{name}")
    states = status.groupBy("run_id").agg(outcome("ok"), outcome("bounded"), outcome("failed"), outcome("skipped"))
    runs = settings.select("run_id", "horizon", "input_size", F.size("models").cast("bigint").alias("n_models"))
    found = runs.join(states, "run_id", "left")
    if params is None:
        found = found.withColumn("has_models", F.lit(False))
    else:
        fitted = params.select("run_id").distinct().withColumn("has_models", F.lit(True))
        found = found.join(fitted, "run_id", "left").withColumn("has_models", F.coalesce("has_models", F.lit(False)))
    return found.orderBy(F.desc("run_id"))
