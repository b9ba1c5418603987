"""Linear forecasters fitted by least squares, pooled over all series.

One pass over the panel reduces all training windows to a triangular factor: every task
keeps the factor of its own windows (QR of blocks of rows under the factor so far), and
factors are merged in a tree of small groups.  A factor's size depends on the window only.
Every linear model is solved from the same one, so fitting several models costs one scan;
and as cross-products are never formed, conditions are not squared.  A fitted model is an
affine map of the raw lags, kept as a coefficient table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcast.functions import moving_average_matrix
from rollcast.operators.series import Y, SeriesLayout, measure_series, time_order, training_runs

PARAM_SCHEMA = (
    "run_id string, model string, horizon_step int, input_size int, exogenous array<string>, "
    "intercept double, coefficients array<double>"
)


# A standard deviation below this share of the root mean square is rounding.
ROUNDING = 1e-12
# Factors that one task merges at a time.
MERGED = 32

FACTOR = "part int, used long, skipped long, shift array<double>, factor array<double>"


class NotFitted(RuntimeError):
    """No training window, or an unusable solution."""


@dataclass(frozen=True)
class LinearModel:
    """Fitted forecaster: ``y_hat[step] = intercept[step] + coefficients[step] . lags``.

    The lags of the target come first, then one block per exogenous column.
    """

    name: str
    input_size: int
    intercept: np.ndarray
    coefficients: np.ndarray
    exogenous: tuple[str, ...] = ()

    @property
    def horizon(self) -> int:
        return len(self.intercept)

    def forecast(self, horizon: int) -> Column:
        if horizon != self.horizon:
            raise ValueError(f"{self.name} was fitted for {self.horizon} steps, not {horizon}")
        # One constant that Spark folds to a typed array: the plan does not grow with the shape.
        table = [{"b": b, "w": w} for b, w in zip(self.intercept.tolist(), self.coefficients.tolist())]
        steps = F.from_json(F.lit(json.dumps(table)), "array<struct<b: double, w: array<double>>>")
        inputs = F.concat(F.col("lags"), *[F.col(f"{name}_lags") for name in self.exogenous])
        values = inputs if self.exogenous else F.col("lags")
        products = lambda s: F.zip_with(s["w"], values, lambda w, x: w * x)
        return F.transform(
            steps,
            lambda s: F.aggregate(products(s), s["b"], lambda total, v: total + v),
        )


@dataclass(frozen=True)
class LinearSpec:
    """A linear forecaster to fit.

    Subclasses say which features it uses, as a matrix over the base vector
    ``[last, lag_1 - last, ..., lag_(L-1) - last, exogenous lags...]``, and whether
    the target is measured from the last value.
    """

    name: str
    ridge: float = 0.0
    exogenous: tuple[str, ...] = ()
    relative: bool = field(default=True, init=False)

    def features(self, input_size: int) -> np.ndarray:
        raise NotImplementedError


@dataclass(frozen=True)
class NLinear(LinearSpec):
    """Subtract the last value, map the lags linearly to the horizon, add it back."""

    name: str = "NLinear"

    def features(self, input_size: int) -> np.ndarray:
        # The last lag minus itself is always zero, so it is no feature.
        return np.eye(input_size)[1:]


@dataclass(frozen=True)
class DLinear(LinearSpec):
    """Moving-average trend and remainder, a linear map for each, summed.

    Trend and remainder are both linear in the lags, hence collinear: the ridge
    term decides how the weight is shared.
    """

    name: str = "DLinear"
    ridge: float = 1e-3
    kernel: int = 25
    relative: bool = field(default=False, init=False)

    def decomposition(self, input_size: int) -> np.ndarray:
        trend = moving_average_matrix(input_size, self.kernel)
        return np.vstack([trend, np.eye(input_size) - trend])

    def features(self, input_size: int) -> np.ndarray:
        return self.decomposition(input_size) @ _raw_from_base(input_size)


@dataclass(frozen=True)
class LinearExog(LinearSpec):
    """``NLinear`` with the lags of exogenous columns as further features."""

    name: str = "Linear_exog"
    ridge: float = 1e-3

    def features(self, input_size: int) -> np.ndarray:
        return np.eye(input_size * (1 + len(self.exogenous)))[1:]


def _raw_from_base(input_size: int) -> np.ndarray:
    """Lags ``[lag_1..lag_L]`` from ``[last, lag_1 - last, ..., lag_(L-1) - last]``."""
    matrix = np.zeros((input_size, input_size))
    matrix[:, 0] = 1.0
    matrix[:-1, 1:] = np.eye(input_size - 1)
    return matrix


@dataclass(frozen=True)
class WindowFactor:
    """Triangular factor of the training windows' vectors, of which ``shift`` was subtracted.

    There is one shift per column of the panel.  ``skipped`` windows had a NULL or
    non-finite value.
    """

    factor: np.ndarray
    shift: tuple[float, ...]
    used: int = 0
    skipped: int = 0


def _shifted_columns(columns: int, input_size: int) -> list[list[int]]:
    """Places in the vector that move with each column: the last target, all exogenous lags."""
    return [[1], *[list(range(1 + input_size * i, 1 + input_size * (i + 1))) for i in range(1, columns)]]


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The square triangular factor of some rows."""
    size = rows.shape[1]
    found = np.linalg.qr(rows, mode="r")
    return np.vstack([found, np.zeros((size - len(found), size))])


def merge_factors(parts: Sequence[WindowFactor], input_size: int) -> WindowFactor:
    """The factor of all windows of the parts.

    A factor follows another shift exactly: the constant column, of which only the first
    entry is not zero, is added to the columns that move.
    """
    some = [p for p in parts if p.used]
    skipped = sum(p.skipped for p in parts)
    if not some:
        return WindowFactor(parts[0].factor if parts else np.zeros((0, 0)), parts[0].shift if parts else (), 0, skipped)
    shift, moved = some[0].shift, []
    for part in some:
        factor = part.factor.copy()
        for places, old, new in zip(_shifted_columns(len(shift), input_size), part.shift, shift):
            factor[:, places] += (old - new) * factor[:, :1]
        moved.append(factor)
    triangle = moved[0] if len(moved) == 1 else _triangle(np.vstack(moved))
    return WindowFactor(triangle, shift, sum(p.used for p in some), skipped)


def _factor_windows(
    batches: Iterator[pd.DataFrame], columns: list[str], input_size: int, horizon: int
) -> WindowFactor:
    """Factor of all windows in one partition of runs (newest row first)."""
    width = input_size + horizon
    size = 1 + input_size * len(columns) + horizon
    factor, used, skipped, shift = np.zeros((0, size)), 0, 0, None
    rest = np.empty((0, len(columns)))
    rest_first = np.empty(0, dtype=bool)
    for batch in batches:
        values = np.vstack([rest, batch[columns].to_numpy(dtype=float)])
        first = np.concatenate([rest_first, batch["first_of_run"].to_numpy(dtype=bool)])
        if len(values) >= width:
            # A window may start a run but must not contain the start of another.
            inside = np.lib.stride_tricks.sliding_window_view(first, width)[:, 1:]
            windows = np.lib.stride_tricks.sliding_window_view(values, width, axis=0)
            windows = windows[~inside.any(axis=1)][:, :, ::-1]
            finite = np.isfinite(windows).all(axis=(1, 2))
            skipped += int((~finite).sum())
            windows = windows[finite]
            if len(windows):
                # Values near the first window's: a level far above the spread costs no digits.
                shift = windows[0, :, 0].copy() if shift is None else shift
                windows = windows - shift[None, :, None]
                target = windows[:, 0, :]
                last = target[:, input_size - 1 : input_size]
                vector = np.hstack(
                    [
                        np.ones_like(last),
                        last,
                        target[:, : input_size - 1] - last,
                        windows[:, 1:, :input_size].reshape(len(windows), -1),
                        target[:, input_size:] - last,
                    ]
                )
                factor, used = _triangle(np.vstack([factor, vector])), used + len(vector)
        keep = min(width - 1, len(values))
        rest, rest_first = values[len(values) - keep :], first[len(first) - keep :]
    return WindowFactor(factor, tuple(np.zeros(len(columns)) if shift is None else shift), used, skipped)


def _as_row(part: int, found: WindowFactor) -> pd.DataFrame:
    return pd.DataFrame({
        "part": [part], "used": [found.used], "skipped": [found.skipped], "shift": [list(found.shift)],
        "factor": [found.factor.ravel()],
    })


def _from_rows(rows: pd.DataFrame, size: int) -> list[WindowFactor]:
    return [
        WindowFactor(np.array(r.factor, dtype=float).reshape(-1, size), tuple(r.shift), int(r.used), int(r.skipped))
        for r in rows.sort_values("part").itertuples()
    ]


def window_factor(
    panel: DataFrame, *, input_size: int, horizon: int, exogenous: Sequence[str] = (),
    hold_out: int = 0, layout: SeriesLayout | None = None,
) -> WindowFactor:
    """Triangular factor of all training windows of a panel, in one scan.

    The vector is ``[1, last, lag differences, exogenous lags, target differences]``.
    Factors are merged in groups of ``MERGED`` until so few are left; these reach the
    driver.  Their size depends on ``input_size``, ``horizon`` and the number of exogenous
    columns, not on the data.
    """
    columns = [Y, *exogenous]
    layout = layout or measure_series(panel)
    runs, keys = training_runs(panel, input_size + horizon, layout, hold_out=hold_out, carry=exogenous)
    ordered = runs.sortWithinPartitions(*keys, *time_order(panel, True)).select("first_of_run", *columns)
    size = 1 + input_size * (1 + len(exogenous)) + horizon

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield _as_row(TaskContext.get().partitionId(), _factor_windows(batches, columns, input_size, horizon))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return _as_row(int(rows["part"].min()) // MERGED, merge_factors(_from_rows(rows, size), input_size))

    found = ordered.mapInPandas(scan, FACTOR)
    parts = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > MERGED:
        found = found.groupBy(F.floor(F.col("part") / MERGED).alias("group")).applyInPandas(merge, FACTOR)
        parts = -(-parts // MERGED)
    return merge_factors(_from_rows(found.toPandas(), size), input_size)


def solve(
    spec: LinearSpec, found: WindowFactor, *, input_size: int, horizon: int,
    exogenous: Sequence[str] = (),
) -> LinearModel:
    """Ridge solution of one model; the intercept is not penalised.

    The ridge acts on features of unit variance, so the unit of the data does not
    matter.  ``found`` may cover more exogenous columns than the model uses.
    """
    windows = found.used
    if windows < 1:
        raise NotFitted(f"{spec.name}: no training window ({found.skipped} with missing values)")
    size = found.factor.shape[1]
    used = list(range(1, 1 + input_size))
    for name in spec.exogenous:
        at = 1 + input_size * (1 + list(exogenous).index(name))
        used += range(at, at + input_size)
    targets = list(range(size - horizon, size))

    features = np.zeros((0, size))
    base = spec.features(input_size)
    if len(base):
        features = np.zeros((len(base), size))
        features[:, used] = base
    target = np.zeros((horizon, size))
    target[range(horizon), targets] = 1.0
    if not spec.relative:
        target[:, 1] = 1.0

    shift = np.zeros(size)
    for places, value in zip(_shifted_columns(len(found.shift), input_size), found.shift):
        shift[places] = value
    # The first row belongs to the constant: it holds the means, and without it the
    # factor is that of the centred vectors.
    mean = found.factor[0] / found.factor[0, 0]
    centred = found.factor[1:].copy() / np.sqrt(windows)
    centred[:, 0] = 0.0
    x, y = centred @ features.T, centred @ target.T
    deviation = np.sqrt((x**2).sum(axis=0))
    varies = deviation > ROUNDING * np.sqrt(deviation**2 + (features @ mean) ** 2)
    scale = np.where(varies, deviation, 1.0)
    unit_x = np.where(varies, x, 0.0) / scale
    penalty = np.sqrt(spec.ridge) * np.eye(len(features))
    stacked = np.vstack([unit_x, penalty]), np.vstack([y, np.zeros((len(features), horizon))])
    unit = np.linalg.lstsq(*stacked, rcond=None)[0]
    weights = (unit / scale[:, None]).T
    intercept = target @ (mean + shift) - weights @ (features @ (mean + shift))

    on_base = weights @ base if len(base) else np.zeros((horizon, len(used)))
    coefficients = on_base.copy()
    coefficients[:, : input_size - 1] = on_base[:, 1:input_size]
    coefficients[:, input_size - 1] = on_base[:, 0] - on_base[:, 1:input_size].sum(axis=1)
    if spec.relative:
        coefficients[:, input_size - 1] += 1.0
    if not (np.isfinite(coefficients).all() and np.isfinite(intercept).all()):
        raise NotFitted(f"{spec.name}: the solution is not finite")
    return LinearModel(spec.name, input_size, intercept, coefficients, tuple(spec.exogenous))


def fit_linear(
    panel: DataFrame, specs: Sequence[LinearSpec], *, input_size: int, horizon: int,
    hold_out: int = 0, layout: SeriesLayout | None = None,
) -> list[LinearModel]:
    """Fit all linear models in one scan, on rows before the last ``hold_out``."""
    exogenous = sorted({name for spec in specs for name in spec.exogenous})
    found = window_factor(
        panel, input_size=input_size, horizon=horizon, exogenous=exogenous, hold_out=hold_out,
        layout=layout,
    )
    return [
        solve(spec, found, input_size=input_size, horizon=horizon, exogenous=exogenous)
        for spec in specs
    ]


def params_frame(spark: SparkSession, models: Sequence[LinearModel], run_id: str) -> DataFrame:
    """Fitted models as a table, one row per model and horizon step."""
    rows = [
        (run_id, m.name, step + 1, m.input_size, list(m.exogenous), float(m.intercept[step]),
         [float(w) for w in m.coefficients[step]])
        for m in models
        for step in range(m.horizon)
    ]
    return spark.createDataFrame(rows, PARAM_SCHEMA)


def models_from_params(params: DataFrame) -> list[LinearModel]:
    """Fitted models back from their table (one run; a few rows per model)."""
    by_model: dict[str, list] = {}
    for row in params.orderBy("model", "horizon_step").collect():
        by_model.setdefault(row["model"], []).append(row)
    return [
        LinearModel(
            name, rows[0]["input_size"], np.array([r["intercept"] for r in rows]),
            np.array([r["coefficients"] for r in rows]), tuple(rows[0]["exogenous"]),
        )
        for name, rows in by_model.items()
    ]
