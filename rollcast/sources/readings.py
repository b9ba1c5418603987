"""Raw readings from CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rollcast.operators.panel import (
    EVENT_COLUMN,
    EXOGENOUS_COLUMNS,
    SERIES_COLUMN,
    TIME_COLUMN,
    VALUE_COLUMN,
)


def read_readings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw readings, every column as text (no inference pass, no guessed types).

    All files of ``path`` must have the same header.
    """
    return spark.read.csv(path, header=True, enforceSchema=False)


def readings_schema(exogenous: tuple[str, ...] = tuple(EXOGENOUS_COLUMNS)) -> T.StructType:
    """Text schema of the raw file, for sources that cannot look at a header first."""
    names = [EVENT_COLUMN, TIME_COLUMN, VALUE_COLUMN, *exogenous, SERIES_COLUMN]
    return T.StructType([T.StructField(name, T.StringType()) for name in names])
