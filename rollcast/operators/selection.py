"""Choosing series and models from scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcast.functions import present
from rollcast.operators.series import ID

DEFAULT_TOP_MODELS = 6


def best_series(metrics: DataFrame, n: int = 1, metric: str = "mae") -> DataFrame:
    """Series with the lowest mean score over all models: ``unique_id, mean_<metric>``.

    Ties are broken by id.
    """
    mean = f"mean_{metric}"
    return (
        metrics.where(F.col("metric") == metric)
        .groupBy(ID)
        .agg(F.avg("value").alias(mean))
        .where(F.col(mean).isNotNull())
        .orderBy(mean, ID)
        .limit(n)
    )


def pick_best_series(metrics: DataFrame, metric: str = "mae") -> object:
    """Id of the best series; raises when the metric has no rows."""
    found = best_series(metrics, 1, metric).first()
    if found is None:
        raise ValueError(f"no {metric} scores")
    return found[ID]


def sample_series(metrics: DataFrame, seed: int = 0, n: int = 1, metric: str = "mae") -> DataFrame:
    """A draw of scored series that depends on the seed only, not on the partitioning.

    The series with the least MD5 of ``<seed>:<id>``, so that any engine can repeat it.
    """
    return (
        metrics.where(F.col("metric") == metric)
        .select(ID)
        .distinct()
        .orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(ID).cast("string"))), ID)
        .limit(n)
    )


def best_models(
    summary: DataFrame, top_n: int = DEFAULT_TOP_MODELS, metric: str = "mae"
) -> DataFrame:
    """The ``top_n`` models with the lowest mean of a metric: ``model, mean``.

    Models without a score are left out; an unknown metric gives no rows.
    """
    scored = summary.where((F.col("metric") == metric) & present(F.col("mean")))
    return scored.select("model", "mean").orderBy("mean", "model").limit(top_n)


def select_models(
    predictions: DataFrame, metrics: DataFrame, *, max_mae: float | None = None,
    top_n: int | None = None,
) -> DataFrame:
    """Models to show for every series: ``unique_id, model, mae, rank``.

    With a filter set, a model needs a finite MAE on that series, strictly below
    ``max_mae``, and a place among the ``top_n``.  A series without any MAE row is
    not filtered; its models have NULL ``mae`` and ``rank``.
    """
    if max_mae is None and top_n is None:
        none = F.lit(None)
        pairs = predictions.select(ID, "model").distinct()
        return pairs.select(ID, "model", none.cast("double").alias("mae"), none.cast("int").alias("rank"))
    predicted = predictions.select(
        ID, "model", F.lit(None).cast("double").alias("mae"), F.lit(True).alias("predicted")
    )
    scored = metrics.where(F.col("metric") == "mae").select(
        ID, "model", F.col("value").alias("mae"), F.lit(False).alias("predicted")
    )
    mae = F.col("mae")
    usable = F.col("predicted") & present(mae) & (mae < F.lit(float("inf")))
    if max_mae is not None:
        usable = usable & (mae < max_mae)
    series = Window.partitionBy(ID)  # one row per model after the aggregation
    pairs = (
        predicted.unionByName(scored)
        .groupBy(ID, "model")
        .agg(
            F.max("mae").alias("mae"),
            F.max("predicted").alias("predicted"),
            (F.min("predicted") == F.lit(False)).alias("has_scores"),
        )
        .withColumn("filtered", F.max("has_scores").over(series))
        .withColumn("usable", F.when(F.col("filtered"), F.coalesce(usable, F.lit(False))).otherwise(F.col("predicted")))
        .where("usable")
    )
    by_mae = F.row_number().over(series.orderBy("mae", "model"))
    ranked = pairs.withColumn("rank", F.when(F.col("filtered"), by_mae))
    if top_n is not None:
        ranked = ranked.where(F.col("rank").isNull() | (F.col("rank") <= top_n))
    return ranked.select(ID, "model", "mae", "rank")


def usable_models(predictions: DataFrame, best: DataFrame) -> DataFrame:
    """Predictions of the best models that have any; of all models when none has.

    ``best`` has one row per model, as ``best_models`` returns it.  Nothing runs before the
    result is used.
    """
    wanted = best.select("model").distinct().withColumn("__chosen", F.lit(True))
    marked = predictions.join(wanted, "model", "left")
    any_chosen = marked.select(F.max("__chosen").alias("any_chosen")).scalar()
    return marked.where(F.col("__chosen") | any_chosen.isNull()).select(*predictions.columns)


def missing_pairs(series: DataFrame, models: Sequence[str], results: DataFrame) -> DataFrame:
    """Expected ``(model, unique_id)`` pairs without any result row.

    Each series gathers the set of its models, combined before the shuffle; only what is
    missing in the set is spread out to rows.
    """
    expected = series.select(ID, F.lit(None).cast("string").alias("model"), F.lit(True).alias("expected"))
    found = results.select(ID, "model", F.lit(False).alias("expected"))
    sets = expected.unionByName(found).groupBy(ID).agg(
        F.max("expected").alias("expected"), F.collect_set("model").alias("found")
    )
    names = F.array(*[F.lit(m) for m in models]).cast("array<string>")
    missing = F.explode(F.array_except(names, "found")).alias("model")
    return sets.where("expected").select(missing, ID)


def drop_empty_models(predictions: DataFrame) -> DataFrame:
    """Predictions of the models that have at least one present forecast."""
    used = predictions.where(present(F.col("y_hat"))).select("model").distinct()
    return predictions.join(used, "model", "left_semi").select(*predictions.columns)
