"""Queries on sources, panels and positional windows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from checks.registry import query, r6
from checks.sql import EVENTS, ORDERS, RANKED, SUPPLIERS, folds, with_
from rollcast.functions import clean_numeric
from rollcast.operators import panel as panels
from rollcast.operators import windows
from rollcast.operators.series import cut_table, measure_series, with_rank_from_end
from rollcast.sources.panels import event_readings, events_panel, orders_panel, supplier_layout, supplier_panel, table
from rollcast.sources.readings import read_readings as read_csv_readings
from rollcast.sources.scratch import shared_folder, store

READINGS = """SELECT user_id AS unique_id, ts AS ds, {y},
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS carbs FROM events"""


@query(READINGS.format(y=r6("value", "y")) + " WHERE event_type = 'view'")
def prepare_readings(spark, folder):
    return panels.prepare_readings(event_readings(spark, folder), event_type="view", include_exogenous=True)


@query("SELECT user_id AS unique_id, ts AS ds, " + r6("value", "y") + " FROM events WHERE event_type = 'error'")
def prepare_readings_without_exogenous(spark, folder):
    return panels.prepare_readings(event_readings(spark, folder), event_type="error")


@query(READINGS.format(y=r6("value", "y")) + " WHERE event_type = 'click'")
def read_readings(spark, folder):
    path = shared_folder(spark)
    event_readings(spark, folder).write.csv(path, header=True)
    return panels.prepare_readings(read_csv_readings(spark, path), event_type="click", include_exogenous=True)


@query(
    "SELECT event_id, "
    + r6("CASE WHEN event_type = 'error' THEN 0.0 ELSE 1000 + value END", "cleaned")
    + " FROM events"
)
def clean_numbers(spark, folder):
    """Thousands commas are removed; text that only starts like a number counts as 0."""
    text = F.when(F.col("event_type") == "error", F.concat(F.col("value").cast("string"), F.lit("d")))
    text = text.otherwise(F.format_number(1000 + F.col("value"), 2))
    return table(spark, folder, "events").select("event_id", clean_numeric(text).alias("cleaned"))


@query(
    with_(SUPPLIERS)
    + "SELECT count(*) AS n_rows, count(DISTINCT unique_id) AS n_series, min(ds) AS ds_min, max(ds) AS ds_max FROM panel"
)
def profile_panel(spark, folder):
    return panels.profile_panel(supplier_panel(spark, folder))


@query(
    with_(SUPPLIERS)
    + "SELECT unique_id, count(*) AS n_rows, min(ds) AS ds_min, max(ds) AS ds_max FROM panel GROUP BY unique_id"
)
def profile_series(spark, folder):
    return panels.profile_series(supplier_panel(spark, folder))


@query(
    """WITH kinds AS (SELECT extract(year FROM l_shipdate) AS year, l_orderkey FROM lineitem)
SELECT 'year' AS grain, year, count(DISTINCT l_orderkey) AS n_exact, true AS close FROM kinds GROUP BY year
UNION ALL SELECT 'all', NULL, count(DISTINCT l_orderkey), true FROM kinds"""
)
def distinct_by_merged_sketches(spark, folder):
    """Orders per year by stored sketches, and over all years by their union, against exact counts."""
    rows = table(spark, folder, "lineitem").select(F.year("l_shipdate").cast("bigint").alias("year"), "l_orderkey")
    sketches = store(panels.distinct_sketches(rows, ["year"], "l_orderkey"))
    exact = rows.groupBy("year").agg(F.countDistinct("l_orderkey").alias("n_exact"))
    exact_all = rows.agg(F.countDistinct("l_orderkey").alias("n_exact"))
    by_year = panels.estimated_distinct(sketches).join(exact, "year").select(F.lit("year").alias("grain"), "year", "n_distinct", "n_exact")
    whole = panels.estimated_distinct(panels.merge_sketches(sketches)).select("*", exact_all.scalar().alias("n_exact")).select(
        F.lit("all").alias("grain"), F.lit(None).cast("bigint").alias("year"), "n_distinct", "n_exact"
    )
    # Four standard errors.
    close = F.abs(F.col("n_distinct") - F.col("n_exact")) <= 4 * 1.04 / 2 ** (panels.SKETCH_LG_K / 2) * F.col("n_exact")
    return by_year.unionByName(whole).select("grain", "year", "n_exact", close.alias("close"))


@query(with_(ORDERS) + "SELECT unique_id, ds, " + r6("y", "y") + " FROM panel WHERE unique_id = '1-URGENT'")
def select_series(spark, folder):
    return panels.select_series(orders_panel(spark, folder), "1-URGENT")


@query(
    with_(EVENTS)
    + "SELECT unique_id, ds, " + r6("y", "y") + ", carbs FROM panel WHERE unique_id IN "
    "(SELECT DISTINCT unique_id FROM panel ORDER BY unique_id LIMIT 5)"
)
def first_series(spark, folder):
    return panels.first_series(events_panel(spark, folder), 5)


LAST = with_(ORDERS, RANKED) + "SELECT unique_id, ds, " + r6("y", "y") + " FROM ranked WHERE r <= 48"


def small_pieces(panel):
    """A layout that cuts every series into pieces of about 64 rows, as it would a huge one."""
    return measure_series(panel, piece_rows=64, spacing=timedelta(days=1))


@query(LAST)
def last_n(spark, folder):
    return windows.last_n(orders_panel(spark, folder), 48)


@query(LAST)
def last_n_of_cut_series(spark, folder):
    panel = orders_panel(spark, folder)
    return windows.last_n(panel, 48, small_pieces(panel))


@query(LAST.replace("r <= 48", "r <= 1000"))
def last_n_as_far_as_groups_are_limited(spark, folder):
    return windows.last_n(orders_panel(spark, folder), 1000)


@query(LAST.replace("r <= 48", "r <= 1001"))
def last_n_beyond_the_group_limit(spark, folder):
    """Older rows are dropped by time, from bucket counts, before the tail is sorted."""
    panel = orders_panel(spark, folder)
    return windows.last_n(panel, 1001, measure_series(panel, piece_rows=512, spacing=timedelta(days=1)))


@query(LAST.replace("r <= 48", "r <= 1500"))
def last_n_of_more_than_a_piece(spark, folder):
    panel = orders_panel(spark, folder)
    return windows.last_n(panel, 1500, small_pieces(panel))


@query(
    with_(ORDERS)
    + "SELECT unique_id, count(*) AS n_rows, true AS bounded FROM panel GROUP BY unique_id"
)
def series_pieces(spark, folder):
    """Pieces of cut series cover all rows, and none has over 64 rows and a quarter."""
    pieces = cut_table(small_pieces(orders_panel(spark, folder)), 64)
    pieces = pieces.select("unique_id", "__piece", "__own").distinct()
    return pieces.groupBy("unique_id").agg(F.sum("__own").alias("n_rows"), (F.max("__own") <= 80).alias("bounded"))


# A panel with NULL ids and times, and series of very different length.
SPOTTY = """panel AS (
  SELECT CASE WHEN user_id % 3 > 0 THEN user_id % 10 END AS unique_id,
         CASE WHEN event_id % 11 > 0 THEN ts END AS ds, value AS y
  FROM events)"""

SPOTTY_RANKED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC NULLS LAST, y DESC NULLS LAST) AS r
  FROM panel)"""


def spotty_panel(spark, folder):
    user, event = F.col("user_id"), F.col("event_id")
    return table(spark, folder, "events").select(
        F.when(user % 3 > 0, user % 10).alias("unique_id"), F.when(event % 11 > 0, F.col("ts")).alias("ds"),
        F.col("value").alias("y"),
    )


@query(with_(SPOTTY, SPOTTY_RANKED) + "SELECT unique_id, ds, " + r6("y", "y") + ", r AS rank_from_end FROM ranked")
def ranks_with_null_ids_and_times(spark, folder):
    panel = spotty_panel(spark, folder)
    return with_rank_from_end(panel, measure_series(panel, piece_rows=64))


@query(
    with_(SPOTTY, SPOTTY_RANKED)
    + "SELECT unique_id, ds, " + r6("y", "y")
    + ", CASE WHEN r > 25 THEN 'inference' ELSE 'holdout' END AS role FROM ranked"
)
def holdout_with_null_ids_and_times(spark, folder):
    return windows.holdout_split(spotty_panel(spark, folder), 25)


HOLDOUT = (
    with_(ORDERS, RANKED)
    + "SELECT unique_id, ds, " + r6("y", "y")
    + ", CASE WHEN r > 12 THEN 'inference' ELSE 'holdout' END AS role FROM ranked"
)


@query(HOLDOUT)
def holdout_split(spark, folder):
    return windows.holdout_split(orders_panel(spark, folder), 12)


@query(HOLDOUT)
def holdout_split_of_cut_series(spark, folder):
    panel = orders_panel(spark, folder)
    return windows.holdout_split(panel, 12, small_pieces(panel))


INFERENCE = """SELECT * FROM (
  SELECT unique_id, ds, {y}, n < 48 OR n - 12 < 40 OR r > 12 AS for_inference, n < 48 OR r <= 48 AS for_plot
  FROM ranked) tagged WHERE for_inference OR for_plot""".format(y=r6("y", "y"))


@query(with_(EVENTS, RANKED) + INFERENCE)
def inference_frame(spark, folder):
    panel = events_panel(spark, folder).drop("carbs")
    return windows.inference_frame(panel, horizon=12, input_size=40, plot_points=48)


@query(with_(EVENTS, RANKED) + INFERENCE.replace("48", "60").replace("12", "3").replace("40", "62"))
def inference_frame_of_short_series(spark, folder):
    """Many series have fewer than 60 rows, or fewer than 62 after the hold-out."""
    panel = events_panel(spark, folder).drop("carbs")
    return windows.inference_frame(panel, horizon=3, input_size=62, plot_points=60)


FOLD_COLUMNS = "SELECT unique_id, fold, cutoff, step, ds, " + r6("y", "y") + " FROM folds"


@query(with_(SUPPLIERS, RANKED, folds(12, 3, input_size=48)) + FOLD_COLUMNS)
def cv_folds(spark, folder):
    return windows.cv_folds(
        supplier_panel(spark, folder), horizon=12, n_windows=3, input_size=48,
        layout=supplier_layout(spark, folder),
    )


@query(with_(EVENTS, RANKED, folds(6, 4, 2)) + FOLD_COLUMNS)
def cv_folds_overlapping(spark, folder):
    return windows.cv_folds(events_panel(spark, folder), horizon=6, n_windows=4, step=2)


@query(with_(EVENTS, RANKED, folds(6, 5, 3, input_size=24)) + FOLD_COLUMNS)
def cv_folds_by_test_size(spark, folder):
    panel = events_panel(spark, folder)
    return windows.cv_folds(panel, horizon=6, test_size=18, step=3, n_windows=None, input_size=24)


@query(with_(ORDERS, RANKED, folds(12, 3, input_size=48)) + FOLD_COLUMNS)
def cv_folds_of_cut_series(spark, folder):
    panel = orders_panel(spark, folder)
    return windows.cv_folds(
        panel, horizon=12, n_windows=3, input_size=48, layout=small_pieces(panel)
    )


DAILY = SUPPLIERS.replace("l_suppkey AS unique_id", "'all' AS unique_id").replace("GROUP BY l_suppkey, ", "GROUP BY ")


@query(with_(DAILY, RANKED, folds(12, 3, input_size=1200)) + FOLD_COLUMNS)
def cv_folds_with_long_inputs(spark, folder):
    """More rows before the folds than Spark limits groups to: the quantity shipped per day, as one series."""
    days = supplier_panel(spark, folder).groupBy("ds").agg(F.sum("y").alias("y"))
    panel = days.select(F.lit("all").alias("unique_id"), "ds", "y")
    return windows.cv_folds(
        panel, horizon=12, n_windows=3, input_size=1200,
        layout=measure_series(panel, piece_rows=512, spacing=timedelta(days=1)),
    )


@query(
    with_(EVENTS, RANKED)
    + """SELECT a.unique_id, a.ds, CASE WHEN b.r >= a.r THEN 24 - (b.r - a.r) ELSE 24 + a.r - b.r END AS position, """
    + r6("b.y", "y") + """
FROM ranked a JOIN ranked b ON b.unique_id = a.unique_id AND b.r <= a.r + 23 AND b.r >= a.r - 6
WHERE a.r > 6 AND a.r + 23 <= a.n"""
)
def lag_windows_every_element(spark, folder):
    """All lags and targets of all windows, one row each."""
    panel = events_panel(spark, folder)
    found = windows.lag_windows(panel, input_size=24, horizon=6, layout=small_pieces(panel))
    both = F.posexplode(F.concat("lags", "targets")).alias("at", "y")
    return found.select("unique_id", "ds", both).select("unique_id", "ds", (F.col("at") + 1).alias("position"), "y")


def lag_sql(panel: str, lags: int, horizon: int, hold_out: int = 0) -> str:
    window = "(PARTITION BY unique_id ORDER BY ds ROWS BETWEEN {} AND {})"
    past = window.format(f"{lags - 1} PRECEDING", "CURRENT ROW")
    future = window.format("1 FOLLOWING", f"{horizon} FOLLOWING")
    return with_(panel, RANKED) + f"""SELECT unique_id, ds, {r6('first_lag', 'first_lag')},
  {r6('last_lag', 'last_lag')}, {r6('sum_lags', 'sum_lags')}, {r6('first_target', 'first_target')},
  {r6('last_target', 'last_target')}, {r6('sum_targets', 'sum_targets')}
FROM (SELECT unique_id, ds, r, n,
    first_value(y) OVER {past} AS first_lag, y AS last_lag, sum(y) OVER {past} AS sum_lags,
    first_value(y) OVER {future} AS first_target, last_value(y) OVER {future} AS last_target,
    sum(y) OVER {future} AS sum_targets
  FROM ranked) w
WHERE r - {horizon} > {hold_out} AND r + {lags - 1} <= n"""


def lag_columns(frame):
    total = lambda name: F.aggregate(name, F.lit(0.0), lambda acc, x: acc + x)
    return frame.select(
        "unique_id", "ds",
        F.element_at("lags", 1).alias("first_lag"), F.element_at("lags", -1).alias("last_lag"),
        total("lags").alias("sum_lags"),
        F.element_at("targets", 1).alias("first_target"), F.element_at("targets", -1).alias("last_target"),
        total("targets").alias("sum_targets"),
    )


@query(lag_sql(SUPPLIERS, 48, 12))
def lag_windows(spark, folder):
    panel, layout = supplier_panel(spark, folder), supplier_layout(spark, folder)
    return lag_columns(windows.lag_windows(panel, input_size=48, horizon=12, layout=layout))


@query(lag_sql(EVENTS, 24, 6, 18))
def lag_windows_before_holdout(spark, folder):
    panel = events_panel(spark, folder)
    return lag_columns(windows.lag_windows(panel, input_size=24, horizon=6, hold_out=18))


@query(lag_sql(ORDERS, 48, 12))
def lag_windows_of_cut_series(spark, folder):
    panel = orders_panel(spark, folder)
    return lag_columns(
        windows.lag_windows(panel, input_size=48, horizon=12, layout=small_pieces(panel))
    )


@query(
    with_(EVENTS, "ends AS (SELECT unique_id, max(ds) AS cutoff FROM panel GROUP BY unique_id)")
    + "SELECT unique_id, cutoff, i AS step, cutoff + i * INTERVAL '5 minutes' AS ds "
    "FROM ends, range(1, 13) steps(i)"
)
def future_frame(spark, folder):
    return windows.future_frame(events_panel(spark, folder), 12, timedelta(minutes=5))
