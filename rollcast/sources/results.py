"""Result tables: import of per-model CSV files, reading and writing stored results."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple
from urllib.parse import unquote, urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcast.functions import missing_to_null, strict_cast, strict_timestamp
from rollcast.operators.linear import (
    PARAM_SCHEMA,
    LinearModel,
    models_from_params,
    params_frame,
)
from rollcast.operators.score import (
    leaderboard_by_metric,
    leaderboard_means,
    leaderboard_wide,
    metrics_wide,
    model_names,
    wide_to_long,
)
from rollcast.operators.series import ID, TS, Y
from rollcast.sources.generations import PARTITIONS
from rollcast.sources.scratch import shared_folder, store

# File name prefixes and the suffix of exogenous model variants.
CV_PREFIX = "cv_results_"
PREDICTION_PREFIX = "predictions_"
EXOGENOUS_SUFFIX = "_exog"

# CSV time format that keeps microseconds (Spark's default stops at milliseconds).
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"

CV_COLUMNS = f"model string, {ID} %s, {TS} timestamp_ntz, cutoff timestamp_ntz, {Y} double, y_hat double"
PREDICTION_COLUMNS = f"model string, {ID} %s, {TS} timestamp_ntz, y_hat double"


class Imported(NamedTuple):
    """Rows read, and the files left out with the reason."""

    frame: DataFrame
    skipped: dict[str, str]


# One cell of a header line: quoted, or up to the next comma.
_CELL = r'("(?:[^"]|"")*"|[^,]*)(?:,|$)'


def _cells(line: Column) -> Column:
    """Names in a header line."""
    found = F.regexp_extract_all(line, F.lit(_CELL), F.lit(1))
    quoted = lambda c: c.startswith('"') & (F.length(c) > 1)
    plain = lambda c: F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(found, lambda c: F.when(quoted(c), plain(c)).otherwise(c))


def _place_of(names: Column, name: Column) -> Column:
    """Where a name stands, from 0; NULL if it is not there."""
    at = F.array_position(names, name)
    return F.when(at > 0, at - 1).cast("int")


def _headers(lines: DataFrame, folder: str, prefix: str, required: Sequence[str]) -> DataFrame:
    """A row per file: its model, and where its columns are.

    The header is the first line of the first block, which one task reads in order.
    """
    order = F.monotonically_increasing_id()
    first = (
        lines.where(F.col("block") == 0).withColumn("at", order)
        .groupBy("file").agg(F.min_by("value", "at").alias("header"))
        .withColumn("names", _cells(F.regexp_replace("header", "^\\ufeff|\\r$", "")))
    )
    # A model's file, or a folder of parts.
    decoded = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    model = F.regexp_extract(decoded, f"/{prefix}([^/]*)[.]csv(/[^/]*)?$", 1)
    path = F.concat(F.lit(f"{folder}/{prefix}"), "model", F.lit(".csv"))
    # A variant's file may carry the name of the base model as its value column.
    base = F.regexp_replace("model", f"{EXOGENOUS_SUFFIX}$", "")
    value = F.coalesce(_place_of(F.col("names"), F.col("model")), _place_of(F.col("names"), base))
    absent = F.array_except(F.array(*[F.lit(c) for c in required]), "names")
    wanting = F.when(F.size("absent") > 0, F.array_join("absent", ", ")).when(F.isnull("at_value"), F.col("model"))
    places = [_place_of(F.col("names"), F.lit(c)).alias(f"at_{c}") for c in (ID, TS, "cutoff", Y)]
    return (
        first.withColumn("model", model).withColumn("path", path)
        .select("file", "path", "model", "header", F.size("names").alias("width"), *places,
                value.alias("at_value"), absent.alias("absent"))
        .withColumn("reason", F.concat(F.lit("missing columns: "), wanting))
    )


def _import(
    spark: SparkSession, folder: str, prefix: str, required: Sequence[str], columns: str, id_type: str
) -> Imported:
    """All files in one scan.

    Each file has its own value column.  A first pass finds every file's header; the table
    of headers, one row per file, is stored and joined to the lines, and cells are picked
    by position.  The plan does not grow with the number of files.  A line that repeats
    its file's header is no row.
    """
    folder = folder.rstrip("/")
    pattern, wanted = f"{folder}/{prefix}*.csv", [part.split()[0] for part in columns.split(", ")]
    try:
        text = spark.read.text(pattern)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return Imported(spark.createDataFrame([], columns % id_type), {})
        raise
    lines = text.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    headers = store(_headers(lines, folder, prefix, required))
    skipped = {r["path"]: r["reason"] for r in headers.where("reason IS NOT NULL").select("path", "reason").collect()}
    # Files without a line have no header.  Spark's listing on the driver has all names anyway.
    with_lines = {urlparse(r["file"]).path for r in headers.select("file").collect()}
    for file in text.inputFiles():
        name = unquote(file.rsplit("/", 1)[1])
        if urlparse(file).path not in with_lines and name.startswith(prefix):
            skipped[f"{folder}/{name}"] = "empty file"
    usable = headers.where("reason IS NULL")
    width = usable.agg(F.max("width")).first()[0]
    if width is None:
        return Imported(spark.createDataFrame([], columns % id_type), skipped)

    rows = lines.join(usable.withColumnRenamed("file", "header_file"), F.col("file") == F.col("header_file"))
    rows = rows.where((F.col("value") != F.col("header")) & (F.trim("value") != ""))
    names = [f"c{i}" for i in range(width)]
    parsed = F.from_csv("value", ", ".join(f"{n} string" for n in names))
    rows = rows.withColumn("cells", F.array(*[parsed.getField(n) for n in names]))
    cell = lambda name: F.get("cells", F.col(f"at_{name}"))  # noqa: E731 - NULL without the column
    known = {
        "model": F.col("model"),
        ID: strict_cast(cell(ID), id_type),
        TS: strict_timestamp(cell(TS)),
        "cutoff": strict_timestamp(cell("cutoff")),
        Y: cell(Y).try_cast("double"),
        "y_hat": missing_to_null(cell("value").try_cast("double")),
    }
    return Imported(rows.select(*[known[name].alias(name) for name in wanted]), skipped)


def import_cv_results(spark: SparkSession, folder: str, id_type: str = "bigint") -> Imported:
    """Cross-validation rows from ``cv_results_<model>.csv`` files, in the long layout.

    Files without ``unique_id, ds, y`` or a value column are skipped and reported.
    """
    return _import(spark, folder, CV_PREFIX, [ID, TS, Y], CV_COLUMNS, id_type)


def import_predictions(spark: SparkSession, folder: str, id_type: str = "bigint") -> Imported:
    """Forecasts from ``predictions_<model>.csv`` files, in the long layout."""
    return _import(spark, folder, PREDICTION_PREFIX, [ID, TS], PREDICTION_COLUMNS, id_type)


def read_metrics(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Long metrics from a wide CSV with one column per model."""
    wide = spark.read.csv(path, header=True)
    models = [c for c in wide.columns if c not in (ID, "metric")]
    typed = wide.select(
        strict_cast(F.col(ID), id_type).alias(ID), "metric",
        *[F.col(f"`{m}`").try_cast("double").alias(m) for m in models],
    )
    return wide_to_long(typed, [ID, "metric"], models).where(F.col("value").isNotNull())


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """A leaderboard CSV in any of the three layouts as ``model, metric, mean, std``.

    A missing file gives no rows.
    """
    try:
        board = spark.read.csv(path, header=True)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], "model string, metric string, mean double, std double")
        raise
    columns = board.columns
    if "metric" in columns:
        models = [c.removesuffix("_mean") for c in columns if c.endswith("_mean")]
        pairs = [
            F.struct(
                F.lit(m).alias("model"), "metric",
                _number(columns, f"{m}_mean").alias("mean"), _number(columns, f"{m}_std").alias("std"),
            )
            for m in models
        ]
    else:
        metrics = sorted({c.removesuffix("_mean").removesuffix("_std").lower() for c in columns if c != "model"})
        pairs = [
            F.struct(
                "model", F.lit(m).alias("metric"),
                F.coalesce(_number(columns, f"{m.upper()}_mean"), _number(columns, m)).alias("mean"),
                _number(columns, f"{m.upper()}_std").alias("std"),
            )
            for m in metrics
        ]
    return board.select(F.inline(F.array(*pairs)))


def _number(columns: Sequence[str], name: str):
    return F.col(f"`{name}`").try_cast("double") if name in columns else F.lit(None).cast("double")


def write_table(frame: DataFrame, path: str, *, small: bool = False) -> None:
    """Parquet by run, generation and model; writing a model again replaces its rows, nothing else.

    The rebalance hint gives files of a sensible size and splits a model that
    holds most of the rows; ``small`` tables (a few rows per model) do without its shuffle.
    """
    keys = [k for k in PARTITIONS if k in frame.columns]
    shaped = frame.coalesce(1) if small else frame.hint("rebalance", *keys)
    (
        shaped.write.partitionBy(*keys)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stored result table.  With the schema given, a run named ``7`` stays text."""
    return spark.read.schema(schema).parquet(path)


def write_cv_results(cv_results: DataFrame, path: str) -> None:
    """Cross-validation rows, partitioned by run and model."""
    write_table(cv_results, path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Forecast rows, partitioned by run and model."""
    write_table(predictions, path)


def export_by_model(
    frame: DataFrame, folder: str, prefix: str, models: Sequence[str] | None = None
) -> None:
    """One CSV per model, ``<prefix><model>.csv``, its forecasts in a column named like the model.

    The frame is computed once, into a table by model; each CSV then reads its own part.
    """
    spark = frame.sparkSession
    kept = [c for c in (ID, TS, "cutoff", Y) if c in frame.columns]
    by_model = shared_folder(spark)
    write_table(frame.select("model", *kept, "y_hat"), by_model)
    stored = spark.read.schema(frame.select(*kept, "y_hat", "model").schema).parquet(by_model)
    for model in models if models is not None else model_names(stored):
        rows = stored.where(F.col("model") == model)
        writer = rows.select(*kept, F.col("y_hat").alias(model)).write.mode("overwrite")
        writer.option("timestampNTZFormat", TIME_FORMAT).csv(
            f"{folder}/{prefix}{model}.csv", header=True
        )


def write_metrics(metrics: DataFrame, path: str, wide_csv: str | None = None) -> None:
    """Long metrics as Parquet; optionally also the wide CSV with a column per model."""
    write_table(metrics, path)
    if wide_csv:
        metrics_wide(metrics).write.mode("overwrite").csv(wide_csv, header=True)


def write_summary(summary: DataFrame, path: str, layout: str = "wide") -> None:
    """A leaderboard as one CSV file: ``wide``, ``means``, ``by_metric`` or ``long``.

    It has one row per model (or metric), so a single file is right.
    """
    views = {
        "wide": leaderboard_wide,
        "means": leaderboard_means,
        "by_metric": leaderboard_by_metric,
        "long": lambda s: s.orderBy("metric", "mean", "model"),
    }
    views[layout](summary).coalesce(1).write.mode("overwrite").csv(path, header=True)


def save_params(spark: SparkSession, models: Sequence[LinearModel], path: str, run_id: str) -> None:
    """Fitted linear models as a coefficient table."""
    write_table(params_frame(spark, models, run_id), path, small=True)


def load_params(spark: SparkSession, path: str, run_id: str) -> list[LinearModel]:
    """Fitted linear models of one run."""
    params = read_table(spark, path, PARAM_SCHEMA)
    return models_from_params(params.where(F.col("run_id") == run_id))
