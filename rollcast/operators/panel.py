"""From raw readings to a clean panel, and simple questions about a panel."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcast.functions import clean_numeric, strict_cast, strict_timestamp
from rollcast.operators.series import ID, TS, Y

# Size of a sketch: two to this power registers, for an error of about 0.8 percent.
SKETCH_LG_K = 14

# Column names and the event label of the raw readings file, and
# the panel names of the optional exogenous columns.
EVENT_COLUMN = "Event Type"
TIME_COLUMN = "Timestamp (YYYY-MM-DDThh:mm:ss)"
VALUE_COLUMN = "Glucose Value (mg/dL)"
SERIES_COLUMN = "sequence_id"
READING_EVENT = "EGV"
EXOGENOUS_COLUMNS = {
    "Fast-Acting Insulin Value (u)": "fast_insulin",
    "Long-Acting Insulin Value (u)": "long_insulin",
    "Carb Value (grams)": "carbs",
    "flow_amount": "flow_amount",
}


def missing_exogenous(raw: DataFrame, exogenous: Mapping[str, str] = EXOGENOUS_COLUMNS) -> list[str]:
    """Optional source columns this raw frame does not have."""
    return [name for name in exogenous if name not in raw.columns]


def prepare_readings(
    raw: DataFrame, *, event_type: str | None = READING_EVENT, include_exogenous: bool = False,
    exogenous: Mapping[str, str] = EXOGENOUS_COLUMNS, id_type: str = "bigint",
) -> DataFrame:
    """Panel ``(unique_id, ds, y[, exogenous])`` from raw text readings.

    Rows of other event types go first, with everything they carry.  Key and
    target casts raise on malformed text; exogenous ones fall back to 0.0, and
    columns the source lacks are left out (see ``missing_exogenous``).  Rows
    without a target are dropped.  Row-wise only: it also runs on a stream.
    """
    readings = raw if event_type is None else raw.where(F.col(EVENT_COLUMN) == event_type)
    columns = [
        strict_cast(F.col(SERIES_COLUMN), id_type).alias(ID),
        strict_timestamp(F.col(TIME_COLUMN)).alias(TS),
        strict_cast(F.col(VALUE_COLUMN), "double").alias(Y),
    ]
    if include_exogenous:
        columns += [
            clean_numeric(F.col(f"`{source}`")).alias(name)
            for source, name in exogenous.items()
            if source in raw.columns
        ]
    return readings.select(*columns).dropna(subset=[Y])


def profile_panel(panel: DataFrame) -> DataFrame:
    """One row: number of rows and series, first and last timestamp."""
    per_series = profile_series(panel)
    return per_series.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).alias("n_series"),
        F.min("ds_min").alias("ds_min"),
        F.max("ds_max").alias("ds_max"),
    )


def profile_series(panel: DataFrame) -> DataFrame:
    """Rows, first and last timestamp of every series."""
    return panel.groupBy(ID).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(TS).alias("ds_min"),
        F.max(TS).alias("ds_max"),
    )


def distinct_sketches(rows: DataFrame, by: Sequence[str] = (), column: str = ID, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """HyperLogLog sketches of a column's values, one per group: ``<by>, sketch``.

    A sketch has a fixed size whatever it counts, can be stored, and is mergeable, so the
    number of series over many runs or days needs no second look at their rows.
    """
    return rows.groupBy(*by).agg(F.hll_sketch_agg(F.col(column).cast("string"), F.lit(lg_k)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketch of all values of the groups that fall together when only ``by`` is kept."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated_distinct(sketches: DataFrame, name: str = "n_distinct") -> DataFrame:
    """Replace the sketch by its estimate; its standard error is about ``1.04 / sqrt(2 ** lg_k)``."""
    kept = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*kept, F.hll_sketch_estimate("sketch").alias(name))


def select_series(panel: DataFrame, ids: object | Iterable[object]) -> DataFrame:
    """Rows of one series, or of a list of series."""
    wanted = list(ids) if isinstance(ids, (list, tuple, set)) else [ids]
    return panel.where(F.col(ID).isin(wanted))


def first_series(panel: DataFrame, n: int) -> DataFrame:
    """Rows of the first ``n`` series in id order (a table has no order of appearance)."""
    wanted = panel.select(ID).distinct().orderBy(ID).limit(n)
    return panel.join(wanted, ID, "left_semi")


