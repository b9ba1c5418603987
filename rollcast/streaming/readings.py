"""The same preparation on a stream of reading files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollcast.operators.panel import EXOGENOUS_COLUMNS, prepare_readings
from rollcast.sources.readings import readings_schema


def stream_readings(
    spark: SparkSession, folder: str, *, exogenous: tuple[str, ...] = tuple(EXOGENOUS_COLUMNS), **options
) -> DataFrame:
    """Panel rows from CSV files as they arrive; options as in ``prepare_readings``.

    ``exogenous`` names the optional source columns the files have, in file order
    (a stream cannot look at a header first).  The work is per row, without state.
    """
    raw = (
        spark.readStream.schema(readings_schema(exogenous))
        .option("header", True)
        .option("enforceSchema", False)
        .csv(folder)
    )
    return prepare_readings(raw, **options)
