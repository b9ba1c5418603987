"""Column expressions shared by the operators; all of them stay on the JVM."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal number. Spark's own cast is wider: it also reads '5d' and 'NaN'.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _cast_or_raise(col: Column, converted: Column, what: str) -> Column:
    text = F.concat(F.lit(f"not a {what}: "), col.cast("string"))
    return F.when(col.isNull(), F.lit(None)).otherwise(F.coalesce(converted, F.raise_error(text)))


def strict_cast(col: Column, dtype: str) -> Column:
    """Cast that keeps NULL and raises on malformed values, whatever the ANSI setting."""
    if dtype == "double":
        text = col.cast("string")
        converted = F.when(text.rlike(NUMBER), text.try_cast("double"))
        return _cast_or_raise(col, converted, dtype)
    return _cast_or_raise(col, col.try_cast(dtype), dtype)


def strict_timestamp(col: Column) -> Column:
    """ISO text without a zone to ``timestamp_ntz``; raises on malformed text."""
    return strict_cast(col, "timestamp_ntz")


def clean_numeric(col: Column) -> Column:
    """Lenient number: thousands commas removed, anything unreadable becomes 0.0."""
    text = F.replace(col.cast("string"), F.lit(","), F.lit(""))
    return F.coalesce(F.when(text.rlike(NUMBER), text.try_cast("double")), F.lit(0.0))


def present(col: Column) -> Column:
    """Neither NULL nor NaN."""
    return col.isNotNull() & ~F.isnan(col)


def missing_to_null(col: Column) -> Column:
    """NaN becomes NULL, so that one rule for missing forecasts holds everywhere."""
    return F.when(~F.isnan(col), col)


def percent_error(y: Column, err: Column) -> Column:
    """|err| / |y| * 100 with float division: 0/0 is NaN, e/0 is infinity."""
    at_zero = F.when(err == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return F.when(y == 0, at_zero).otherwise(F.try_divide(F.abs(err), F.abs(y)) * 100)


def fraction_error(y: Column, err: Column) -> Column:
    """|err| / |y|; a zero target has no fraction and is skipped (NULL)."""
    return F.try_divide(F.abs(err), F.abs(y))


def row_mean(*cols: Column) -> Column:
    """Mean over several columns of one row, ignoring NULLs; NULL when all are."""
    kept = F.filter(F.array(*cols), lambda x: x.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(kept) > 0, total / F.size(kept))


def moving_average_matrix(size: int, kernel: int) -> np.ndarray:
    """Matrix of a centred moving average over ``size`` points, ends replicated."""
    half = (kernel - 1) // 2
    matrix = np.zeros((size, size))
    for row in range(size):
        for offset in range(-half, kernel - half):
            matrix[row, min(max(row + offset, 0), size - 1)] += 1.0 / kernel
    return matrix
