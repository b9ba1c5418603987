"""Score stored cross-validation files again."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from rollcast.operators.score import leaderboard, leaderboard_means, metrics_wide, model_names, score
from rollcast.sources.results import import_cv_results, read_table, write_metrics, write_summary


class Summary(NamedTuple):
    metrics: DataFrame
    wide: DataFrame
    board: DataFrame
    skipped: dict[str, str]


def summarize(spark: SparkSession, folder: str, id_type: str = "bigint", out: str | None = None) -> Summary:
    """Metrics (MAPE in percent), their wide view and the leaderboard of a folder of CSV files.

    With ``out``, they are stored there: ``metrics`` (Parquet), and ``metrics.csv`` and
    ``metrics_summary.csv`` in the layouts that the readers know.
    """
    rows, skipped = import_cv_results(spark, folder, id_type)
    metrics = score(rows, mape="percent")
    if out:
        write_metrics(metrics, f"{out}/metrics", f"{out}/metrics.csv")
        metrics = read_table(spark, f"{out}/metrics", metrics.schema)
    summary = leaderboard(metrics)
    if out:
        write_summary(summary, f"{out}/metrics_summary.csv", "means")
    return Summary(metrics, metrics_wide(metrics, model_names(metrics)), leaderboard_means(summary), skipped)
