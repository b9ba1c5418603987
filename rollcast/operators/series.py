"""Row positions inside a series, also when one series holds a third of all rows.

Every positional operator (tails, hold-out, folds, lag windows) needs the rank of a row
inside its series.  ``Window.partitionBy('unique_id')`` alone would send a whole series to
one task, so series with more than ``piece_rows`` rows are cut along time.

``measure_series`` makes one pass over the panel: it counts rows by series and time bucket
(combined before the shuffle) and stores the counts.  Everything else is derived from that
small table: running sums from the latest bucket back give the number of later rows, and
neighbouring buckets form pieces of ``piece_rows`` rows.  A task ranks one piece and adds
the number of later rows, so ranks are exact wherever the cuts are.  The cut table stays a
table: rows meet it by an equality join on series and bucket, which Spark broadcasts if it
is small and splits if it is skewed.  Nothing of it reaches the driver but a few totals.

Buckets are as wide as ``piece_rows / 16`` rows at the expected ``spacing``; a bucket of a
large series that is fuller than a quarter of a piece is counted again in 64 narrower ones,
and so on down to a microsecond.  So a piece has at most ``piece_rows + piece_rows / 4``
rows whatever the table's size.  Only rows of one series at one very timestamp are never
parted.

Defined: a NULL id is a series like others; NULL times are older than all others.  Rows of
equal time are ordered by target.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcast.sources.scratch import store

ID, TS, Y = "unique_id", "ds", "y"
KEYS = (ID, TS)

PIECE_ROWS = 1_000_000
SPACING = timedelta(minutes=5)

# Buckets per piece at the expected spacing, and the share of a piece a bucket may have.
BUCKETS_PER_PIECE, FULLEST = 16, 4
# A fuller bucket is parted into two to the power of so many.
NARROWER = 6

# An order among rows of equal time and target, if a frame has it.
TIE = "__tie"

_PIECE, _LOCAL, _AFTER, _OWN = "__piece", "__local", "__after", "__own"
_MICROSECOND = timedelta(microseconds=1)


@dataclass(frozen=True)
class SeriesLayout:
    """How many rows the series have, and where they are in time.

    ``largest`` is the row count of the longest series, or an upper bound of it.
    ``buckets`` has a row per series and time bucket: ``shift`` (its width is two to that
    power, in microseconds), ``number``, ``start``, ``n``, ``after`` (rows in later
    buckets) and ``total`` (rows of the series).  It is None where a bound made counting
    unnecessary.
    """

    rows: int
    largest: int
    piece_rows: int
    buckets: DataFrame | None = None
    shifts: tuple[int, ...] = ()

    def is_cut(self, piece_rows: int | None = None) -> bool:
        return self.buckets is not None and self.largest > (piece_rows or self.piece_rows)


def micros(panel: DataFrame) -> Column:
    """Time as a number that grows with it; timestamps without zone are not shifted."""
    stamp, kind = F.col(TS), panel.schema[TS].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(stamp)
    if isinstance(kind, T.IntegralType):
        return stamp.cast("bigint")
    days = F.unix_date(stamp.cast("date")).cast("bigint") * 86_400_000_000
    if isinstance(kind, T.DateType):
        return days
    seconds = F.hour(stamp) * 3600 + F.minute(stamp) * 60
    return days + seconds.cast("bigint") * 1_000_000 + (F.date_part(F.lit("SECOND"), stamp) * 1_000_000).cast("bigint")


def same(left: Column, right: Column) -> Column:
    """Equal, NULL included."""
    return left.eqNullSafe(right)


def _counted(panel: DataFrame, shift: int) -> DataFrame:
    bucket = F.shiftright(micros(panel), shift)
    return panel.groupBy(ID, bucket.alias("number")).agg(F.count(F.lit(1)).alias("n"))


def _renamed(frame: DataFrame) -> DataFrame:
    return frame.withColumnRenamed(ID, "__id")


def measure_series(
    panel: DataFrame, *, piece_rows: int = PIECE_ROWS, spacing: timedelta = SPACING
) -> SeriesLayout:
    """Count the rows of all series by time bucket, in one pass.

    ``spacing`` is the usual distance of a series' rows.  It decides only how much work
    the counting is: a wrong one gives more buckets, or another pass over full ones.
    """
    if piece_rows < 1:
        raise ValueError("piece_rows must be positive")
    shift = max(1, spacing // _MICROSECOND * piece_rows // BUCKETS_PER_PIECE).bit_length() - 1
    counted = store(_counted(panel, shift))
    totals = counted.groupBy(ID).agg(F.sum("n").alias("total"))
    found = totals.agg(F.sum("total").alias("rows"), F.max("total").alias("largest")).first()
    rows, largest = found["rows"] or 0, found["largest"] or 0

    levels, most = [(shift, counted)], max(1, piece_rows // FULLEST)
    while largest > piece_rows and levels[-1][0] > 0:
        shift, counted = levels[-1]
        large = _renamed(totals.where(F.col("total") > piece_rows)).select("__id")
        full = counted.where((F.col("n") > most) & F.col("number").isNotNull())
        full = full.join(large, same(F.col(ID), F.col("__id")), "left_semi")
        full = store(_renamed(full).select("__id", F.col("number").alias("__number")))
        if full.isEmpty():
            break
        in_full = same(F.col(ID), F.col("__id")) & (F.shiftright(micros(panel), shift) == F.col("__number"))
        narrower = max(0, shift - NARROWER)
        finer = store(_counted(panel.select(*KEYS).join(full, in_full, "left_semi"), narrower))
        coarse = counted.join(full, same(F.col(ID), F.col("__id")) & (F.col("number") == F.col("__number")), "left_anti")
        levels[-1:] = [(shift, coarse), (narrower, finer)]

    every = reduce(DataFrame.unionByName, [
        frame.select(ID, F.lit(at).alias("shift"), "number", F.shiftleft("number", at).alias("start"), "n")
        for at, frame in levels
    ])
    series = Window.partitionBy(ID)
    later = series.orderBy(F.col("start").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    buckets = every.select(
        "*", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("after"), F.sum("n").over(series).alias("total")
    )
    if largest > piece_rows:
        buckets = store(buckets)
    return SeriesLayout(rows, largest, piece_rows, buckets, tuple(at for at, _ in levels))


def grid_layout(
    first: datetime, last: datetime, freq: timedelta, *, piece_rows: int = PIECE_ROWS
) -> SeriesLayout | None:
    """Layout of a panel with one row at most per series and ``freq``, without counting.

    Such a series has no more rows than there are grid points from ``first`` to
    ``last``.  None when that does not prove the series small enough.
    """
    points = (last - first) // freq + 1
    return SeriesLayout(0, points, piece_rows) if points <= piece_rows else None


def cut_table(layout: SeriesLayout, piece_rows: int, overlap: int = 0) -> DataFrame:
    """Which piece each bucket of a large series belongs to.

    One row per bucket and piece: ``shift``, ``number``, the piece, its own rows and the
    rows in later pieces.  With an ``overlap``, buckets that may hold one of the ``overlap``
    latest rows of a piece belong to the next later piece, too.
    """
    series = Window.partitionBy(ID)
    slots = (
        layout.buckets.where(F.col("total") > piece_rows)
        .withColumn("slot", F.floor(F.col("after") / piece_rows))
        .withColumn(_PIECE, F.dense_rank().over(series.orderBy("slot")) - 1)
    )
    piece = Window.partitionBy(ID, _PIECE)
    placed = slots.select(
        ID, "shift", "number", "after", _PIECE, F.min("after").over(piece).alias(_AFTER), F.sum("n").over(piece).alias(_OWN)
    )
    if not overlap:
        return placed.drop("after")
    pieces = _renamed(placed.select(ID, F.col(_PIECE).alias("__at"), F.col(_AFTER).alias("__first"), F.col(_OWN).alias("__rows")).distinct())
    reaches = (F.col(_PIECE) > 0) & (F.col("after") - F.col(_AFTER) < overlap)
    runs = F.when(reaches, F.array(F.col(_PIECE), F.col(_PIECE) - 1)).otherwise(F.array(_PIECE))
    copied = placed.select(ID, "shift", "number", F.explode(runs).alias(_PIECE))
    joined = copied.join(pieces, same(F.col(ID), F.col("__id")) & (F.col(_PIECE) == F.col("__at")))
    return joined.select(ID, "shift", "number", _PIECE, F.col("__first").alias(_AFTER), F.col("__rows").alias(_OWN))


def _place(panel: DataFrame, layout: SeriesLayout, piece_rows: int, overlap: int = 0) -> DataFrame:
    """Add the piece a row lies in, and what is known of it: ``__own``, ``__after``.

    Rows of series that are not cut get NULLs; a row in the overlap of two pieces is
    returned for both.  A bucket has one width, so a row meets it in one of the joins.
    """
    # Stored, so that Spark knows its size and broadcasts it if small.
    cuts = store(cut_table(layout, piece_rows, overlap))
    names, placed = (_PIECE, _AFTER, _OWN), panel
    for shift in layout.shifts:
        level = _renamed(cuts.where(F.col("shift") == shift)).select(
            "__id", F.col("number").alias("__number"), *[F.col(n).alias(f"{n}_{shift}") for n in names]
        )
        match = same(F.col(ID), F.col("__id")) & same(F.shiftright(micros(panel), shift), F.col("__number"))
        placed = placed.join(level, match, "left").drop("__id", "__number")
    return placed.select(
        *panel.columns, *[F.coalesce(*[F.col(f"{n}_{shift}") for shift in layout.shifts]).alias(n) for n in names]
    )


def time_order(panel: DataFrame, descending: bool) -> list[Column]:
    """Time order; equal timestamps (a malformed panel) are ordered by the target."""
    names = [TS, *[n for n in (Y, TIE) if n in panel.columns]]
    return [F.col(n).desc() if descending else F.col(n).asc() for n in names]


def group_limit(panel: DataFrame) -> int:
    """Up to how many first rows Spark limits groups before a shuffle."""
    return int(panel.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))


def with_rank_from_end(
    panel: DataFrame, layout: SeriesLayout | None = None, *, last: int | None = None
) -> DataFrame:
    """Add ``rank_from_end`` (1 = last row of its series).

    ``last`` keeps only the final ``last`` rows.  As far as Spark limits groups itself, each
    map task keeps that many rows of a series, and nothing is counted.  Beyond that the
    bucket counts tell since when a series has its ``last`` rows, and older rows are
    dropped before any sort.
    """
    columns = [F.col(c) for c in panel.columns]
    order = time_order(panel, True)
    if last is not None and last <= group_limit(panel):
        rank = F.row_number().over(Window.partitionBy(ID).orderBy(*order))
        ranked = panel.select(*columns, rank.alias(_LOCAL)).where(F.col(_LOCAL) <= last)
        return ranked.select(*columns, F.col(_LOCAL).cast("bigint").alias("rank_from_end"))

    layout = layout or measure_series(panel)
    cut = panel if last is None else _late_rows(panel, layout, last)
    # Tails that fit one piece need no pieces.
    if layout.is_cut() and (last is None or last > layout.piece_rows):
        cut = _place(cut, layout, layout.piece_rows)
        window = Window.partitionBy(ID, _PIECE)
        rank = F.row_number().over(window.orderBy(*order)) + F.coalesce(F.col(_AFTER), F.lit(0))
    else:
        rank = F.row_number().over(Window.partitionBy(ID).orderBy(*order))
    ranked = cut.select(*columns, rank.cast("bigint").alias("rank_from_end"))
    return ranked if last is None else ranked.where(F.col("rank_from_end") <= last)


def _late_rows(panel: DataFrame, layout: SeriesLayout, last: int) -> DataFrame:
    """Drop the rows of buckets that start after ``last`` rows or more, counted from the end."""
    if layout.buckets is None or layout.largest <= last:
        return panel
    needed = layout.buckets.where((F.col("after") < last) & (F.col("total") > last))
    # A needed bucket without a time is the oldest: nothing can be dropped then.
    since = needed.groupBy(ID).agg(F.min("start").alias("__since"), F.bool_or(F.isnull("start")).alias("all"))
    starts = store(_renamed(since.where("NOT all")).select("__id", "__since"))
    late = F.col("__since").isNull() | (micros(panel) >= F.col("__since"))
    return panel.join(starts, same(F.col(ID), F.col("__id")), "left").where(late).drop("__id", "__since")


def training_runs(
    panel: DataFrame, width: int, layout: SeriesLayout | None = None, *, hold_out: int = 0,
    carry: Sequence[str] = (),
) -> tuple[DataFrame, list[str]]:
    """Rows before the last ``hold_out`` rows, grouped into runs for sliding windows.

    Returns the frame and its grouping keys.  Inside a run, ordered by
    ``rank_from_end``, every ``width`` neighbouring rows form one window, and each
    window of a series lies in exactly one run.  A small series is one run.  Of a
    large one each piece is a run, together with the last ``width - 1`` rows of the
    piece before it, which are copied.  ``first_of_run`` marks run starts.
    """
    layout = layout or measure_series(panel)
    rows = panel.select(ID, TS, Y, *carry)
    # Pieces long enough that the rows before one all lie in its neighbour.
    size = max(layout.piece_rows, 2 * width)
    if not layout.is_cut(size):
        rank = F.row_number().over(Window.partitionBy(ID).orderBy(*time_order(rows, True)))
        ranked = rows.withColumn("rank_from_end", rank.cast("bigint")).where(F.col("rank_from_end") > hold_out)
        return ranked.withColumn("first_of_run", F.col("rank_from_end") == hold_out + 1), [ID]

    # The copied rows are older, so counting on from the run's own rows ranks them too.
    window = Window.partitionBy(ID, _PIECE).orderBy(*time_order(rows, True))
    later = F.coalesce(F.col(_AFTER), F.lit(0))
    own = F.col(_OWN)
    ranked = (
        _place(rows, layout, size, width - 1)
        .withColumn(_LOCAL, F.row_number().over(window))
        .where(own.isNull() | (F.col(_LOCAL) <= own + (width - 1)))
        .withColumn("rank_from_end", F.col(_LOCAL) + later)
        .where(F.col("rank_from_end") > hold_out)
        .withColumn(
            "first_of_run", F.col("rank_from_end") == F.greatest(later, F.lit(hold_out)) + 1
        )
        .drop(_LOCAL, _AFTER, _OWN)
        .withColumnRenamed(_PIECE, "run")
    )
    return ranked, [ID, "run"]
