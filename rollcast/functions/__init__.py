from rollcast.functions.columns import (
    clean_numeric,
    fraction_error,
    missing_to_null,
    moving_average_matrix,
    percent_error,
    present,
    row_mean,
    strict_cast,
    strict_timestamp,
)

__all__ = [
    "clean_numeric",
    "fraction_error",
    "missing_to_null",
    "moving_average_matrix",
    "percent_error",
    "present",
    "row_mean",
    "strict_cast",
    "strict_timestamp",
]
