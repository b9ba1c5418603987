"""Name -> Spark query and name -> SQL, kept side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *, rounded: bool = True):
    """Register a query under its function name, with its SQL twin if there is one."""

    def register(function: Query) -> Query:
        name = function.__name__
        QUERIES[name] = (lambda spark, folder: tidy(function(spark, folder))) if rounded else function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def tidy(frame: DataFrame) -> DataFrame:
    """Doubles to six decimals, counts and ranks to bigint: both engines agree on these."""
    columns = []
    for field in frame.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            column = F.round(column + F.lit(1e-9), 6)
        elif isinstance(field.dataType, T.IntegerType):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return frame.select(*columns)


def r6(expression: str, name: str | None = None) -> str:
    """The SQL form of the rounding in ``tidy``."""
    return f"round({expression} + 1e-9, 6)" + (f" AS {name}" if name else "")
