"""Building blocks of the SQL twins: common table expressions as text."""

from __future__ import annotations

EVENTS = """panel AS (
  SELECT user_id AS unique_id, ts AS ds, value AS y,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS carbs
  FROM events)"""

ORDERS = """panel AS (
  SELECT o_orderpriority AS unique_id, o_orderdate AS ds, sum(o_totalprice) AS y
  FROM orders GROUP BY o_orderpriority, o_orderdate)"""

SUPPLIERS = """panel AS (
  SELECT l_suppkey AS unique_id, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ds,
         sum(l_quantity) AS y
  FROM lineitem GROUP BY l_suppkey, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP))"""

RANKED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS r,
         count(*) OVER (PARTITION BY unique_id) AS n
  FROM panel)"""


def folds(horizon: int, windows: int, step: int | None = None, input_size: int = 1) -> str:
    """CTEs ``fold_list(fold, newest)`` and ``folds``; fold 1 is the oldest.

    ``newest`` is the rank just after the fold's last row, so that the fold covers the
    ranks ``newest + 1 .. newest + horizon`` and the cutoff row is the next one.
    """
    step = step or horizon
    needed = input_size + horizon + step * (windows - 1)
    values = ", ".join(f"({k}, {step * (windows - k)})" for k in range(1, windows + 1))
    return f"""fold_list(fold, newest) AS (VALUES {values}),
folds AS (
  SELECT a.unique_id, CAST(f.fold AS BIGINT) AS fold, f.newest, c.ds AS cutoff, f.newest + {horizon} + 1 - a.r AS step,
         a.ds, a.y
  FROM ranked a
  JOIN fold_list f ON a.r > f.newest AND a.r <= f.newest + {horizon}
  JOIN ranked c ON c.unique_id = a.unique_id AND c.r = f.newest + {horizon} + 1
  WHERE a.n >= {needed})"""


def baseline_cv(horizon: int, input_size: int) -> str:
    """CTE ``cv`` with the forecasts of Naive and WindowAverage for ``folds``."""
    return f"""inputs AS (
  SELECT a.unique_id, f.fold, avg(a.y) AS mean_y,
         max(CASE WHEN a.r = f.newest + {horizon} + 1 THEN a.y END) AS last_y
  FROM ranked a
  JOIN fold_list f ON a.r > f.newest + {horizon} AND a.r <= f.newest + {horizon} + {input_size}
  GROUP BY a.unique_id, f.fold),
cv AS (
  SELECT 'Naive' AS model, d.unique_id, d.fold, d.ds, d.cutoff, d.y, i.last_y AS y_hat
  FROM folds d JOIN inputs i ON i.unique_id = d.unique_id AND i.fold = d.fold
  UNION ALL
  SELECT 'WindowAverage', d.unique_id, d.fold, d.ds, d.cutoff, d.y, i.mean_y
  FROM folds d JOIN inputs i ON i.unique_id = d.unique_id AND i.fold = d.fold)"""


def scores(mape: str = "percent", source: str = "cv") -> str:
    """CTE ``metrics`` in the long layout."""
    ape = {
        "percent": "CASE WHEN y = 0 THEN CASE WHEN y_hat = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END "
        "ELSE abs(y - y_hat) / abs(y) * 100 END",
        "fraction": "CASE WHEN y <> 0 THEN abs(y - y_hat) / abs(y) END",
    }[mape]
    parts = {
        "mae": "avg(abs(y - y_hat))",
        "mse": "avg((y - y_hat) * (y - y_hat))",
        "rmse": "sqrt(avg((y - y_hat) * (y - y_hat)))",
        "mape": f"avg({ape})",
    }
    selects = "\n  UNION ALL\n".join(
        f"  SELECT model, unique_id, count(y - y_hat) AS n_scored, '{name}' AS metric, {value} AS value "
        f"FROM {source} GROUP BY model, unique_id"
        for name, value in parts.items()
    )
    return f"metrics AS (\n{selects})"


SUMMARY = """summary AS (
  SELECT model, metric, avg(value) AS mean, stddev_samp(value) AS std, count(value) AS n_series
  FROM metrics GROUP BY model, metric)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def training(horizon: int, input_size: int, hold_out: int) -> str:
    """CTE ``training``: last lag ``x1``, the one before ``x2`` (if used), and each target."""
    second = (
        f"JOIN ranked b ON b.unique_id = a.unique_id AND b.r = a.r + 1" if input_size > 1 else ""
    )
    x2 = "b.y AS x2, " if input_size > 1 else ""
    return f"""training AS (
  SELECT a.unique_id, a.y AS x1, a.carbs AS e1, {x2}a.r - t.r AS step, t.y AS target
  FROM ranked a {second}
  JOIN ranked t ON t.unique_id = a.unique_id AND t.r < a.r AND t.r >= a.r - {horizon}
  WHERE a.r - {horizon} > {hold_out})"""
