import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollcast.functions import moving_average_matrix
from rollcast.operators import forecast
from rollcast.operators.forecast import (
    LocalForecaster,
    Naive,
    WindowAverage,
    cross_validate,
    cv_runs,
    fit_all,
    fit_status,
    fit_summary,
    run_inference,
)
from rollcast.operators.linear import (
    DLinear,
    LinearExog,
    LinearModel,
    NLinear,
    NotFitted,
    WindowFactor,
    _factor_windows,
    fit_linear,
    merge_factors,
    window_factor,
)
from rollcast.operators.series import measure_series
from rollcast.sources.results import load_params, save_params
from conftest import at, make_panel, rows

L, H = 8, 3


@pytest.fixture(scope="module")
def data():
    draw = np.random.default_rng(5)
    return {
        uid: 100 + np.cumsum(draw.normal(size=n)) + 5 * np.sin(np.arange(n) / 3)
        for uid, n in ((1, 60), (2, 200), (3, 25), (4, 11), (5, 10))
    }


@pytest.fixture(scope="module")
def panel(spark, data):
    return make_panel(spark, data)


@pytest.fixture(scope="module")
def exog_panel(spark, data):
    draw = np.random.default_rng(6)
    rows_ = [
        (uid, at(i), float(y), float(draw.integers(0, 5)), float(draw.normal()))
        for uid, ys in data.items() for i, y in enumerate(ys)
    ]
    return spark.createDataFrame(rows_, "unique_id bigint, ds timestamp_ntz, y double, carbs double, dose double")


def windows_of(columns: dict, hold_out=0):
    """All windows of all series by plain slicing: lags and targets per column."""
    xs, ys = [], []
    for series in columns.values():
        series = np.atleast_2d(series)
        n = series.shape[1] - hold_out
        for start in range(n - L - H + 1):
            xs.append(series[:, start : start + L])
            ys.append(series[0, start + L : start + L + H])
    return np.array(xs), np.array(ys)


def ridge_solution(x, y, ridge):
    """Centred ridge by stacking penalty rows, in units of each feature, under the design matrix."""
    n = len(x)
    mean_x, mean_y = x.mean(axis=0), y.mean(axis=0)
    stacked = np.vstack([x - mean_x, np.sqrt(ridge * n) * np.diag(x.std(axis=0))])
    target = np.vstack([y - mean_y, np.zeros((x.shape[1], y.shape[1]))])
    weights = np.linalg.lstsq(stacked, target, rcond=None)[0]
    return lambda z: mean_y + (z - mean_x) @ weights


def applied(model: LinearModel, inputs):
    return model.intercept + inputs @ model.coefficients.T


def test_nlinear_equals_direct_least_squares(panel, data):
    [model] = fit_linear(panel, [NLinear()], input_size=L, horizon=H, hold_out=6)
    x, y = windows_of(data, 6)
    x, last = x[:, 0, :], x[:, 0, -1:]
    direct = ridge_solution(x[:, :-1] - last, y - last, 0.0)
    np.testing.assert_allclose(applied(model, x), direct(x[:, :-1] - last) + last, rtol=1e-7)


def test_dlinear_equals_ridge_on_trend_and_remainder(panel, data):
    spec = DLinear(kernel=5, ridge=0.01)
    [model] = fit_linear(panel, [spec], input_size=L, horizon=H)
    x, y = windows_of(data)
    x = x[:, 0, :]
    # Trend by explicit padding, independent of the matrix used by the model.
    padded = np.pad(x, ((0, 0), (2, 2)), mode="edge")
    trend = np.stack([padded[:, i : i + 5].mean(axis=1) for i in range(L)], axis=1)
    z = np.hstack([trend, x - trend])
    np.testing.assert_allclose(applied(model, x), ridge_solution(z, y, 0.01)(z), rtol=1e-6)


def test_linear_with_exogenous_columns(exog_panel):
    spec = LinearExog(exogenous=("carbs",), ridge=0.02)
    other = LinearExog(name="both", exogenous=("dose", "carbs"), ridge=0.02)
    models = fit_linear(exog_panel, [spec, other, NLinear()], input_size=L, horizon=H)
    pdf = exog_panel.toPandas().sort_values(["unique_id", "ds"])
    for model, names in zip(models, (["carbs"], ["dose", "carbs"], [])):
        columns = {u: g[["y", *names]].to_numpy().T for u, g in pdf.groupby("unique_id")}
        x, y = windows_of(columns)
        last = x[:, 0, -1:]
        z = np.hstack([x[:, 0, :-1] - last, *[x[:, 1 + i, :] for i in range(len(names))]])
        direct = ridge_solution(z, y - last, 0.02 if names else 0.0)
        inputs = np.hstack([x[:, i, :] for i in range(1 + len(names))])
        np.testing.assert_allclose(applied(model, inputs), direct(z) + last, rtol=1e-6)


def products(found: WindowFactor) -> np.ndarray:
    """Cross-products of the windows' vectors, without a shift (one column)."""
    factor = found.factor.copy()
    factor[:, 1] += found.shift[0] * factor[:, 0]
    return factor.T @ factor


def test_fit_of_cut_series_is_the_same(panel):
    size = {"input_size": L, "horizon": H, "hold_out": 3}
    whole = window_factor(panel, layout=measure_series(panel), **size)
    cut = window_factor(panel, layout=measure_series(panel, piece_rows=16), **size)
    assert whole.used == cut.used == sum(max(0, n - 3 - L - H + 1) for n in (60, 200, 25, 11, 10))
    np.testing.assert_allclose(products(cut), products(whole), rtol=1e-10, atol=1e-6)


def test_fit_does_not_depend_on_unit_or_level(spark, panel, exog_panel, data):
    models = [NLinear(), DLinear(kernel=5), LinearExog(exogenous=("carbs",))]
    size = {"input_size": L, "horizon": H}
    x = windows_of(data)[0][:, 0, :]
    carbs = np.tile([0.0, 3.0], L // 2) * np.ones((len(x), 1))
    base = fit_linear(exog_panel, models, **size)
    for factor, level in ((1e-3, 0.0), (1.0, 1e9), (1e4, -1e8)):
        changed = exog_panel.withColumn("y", exog_panel["y"] * factor + level)
        for old, new in zip(base, fit_linear(changed, models, **size)):
            extra = carbs if old.exogenous else np.empty((len(x), 0))
            again = (applied(new, np.hstack([x * factor + level, extra])) - level) / factor
            np.testing.assert_allclose(again, applied(old, np.hstack([x, extra])), rtol=1e-4)


def test_skipped_windows_are_counted(spark):
    ys = [float(i % 5) for i in range(30)]
    ys[12] = float("nan")
    found = window_factor(make_panel(spark, {1: ys}), input_size=3, horizon=2)
    assert (found.used, found.skipped) == (21, 5)


def test_test_rows_do_not_reach_the_fit(spark, data, panel):
    changed = make_panel(spark, {u: np.where(np.arange(len(y)) >= len(y) - 9, 1e6, y) for u, y in data.items()})
    size = {"input_size": L, "horizon": H, "hold_out": 9}
    np.testing.assert_allclose(
        products(window_factor(panel, **size)), products(window_factor(changed, **size)), rtol=1e-12, atol=1e-6
    )


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.integers(1, 12), min_size=1, max_size=6),
    st.lists(st.integers(1, 7), min_size=1, max_size=12),
    st.integers(1, 4),
    st.integers(1, 3),
)
def test_factors_do_not_depend_on_batches(lengths, cuts, input_size, horizon):
    import pandas as pd

    y = np.arange(sum(lengths), dtype=float) ** 2 % 17
    first = np.zeros(len(y), dtype=bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    frame = pd.DataFrame({"first_of_run": first, "y": y})
    expected = np.zeros((1 + input_size + horizon,) * 2)
    at_row = 0
    for n in lengths:
        run = y[at_row : at_row + n][::-1]
        at_row += n
        for s in range(n - input_size - horizon + 1):
            lags, targets = run[s : s + input_size], run[s + input_size : s + input_size + horizon]
            v = np.concatenate([[1, lags[-1]], lags[:-1] - lags[-1], targets - lags[-1]])
            expected += np.outer(v, v)
    batches, start, turn = [], 0, 0
    while start < len(frame):
        size = cuts[turn % len(cuts)]
        batches.append(frame.iloc[start : start + size])
        start, turn = start + size, turn + 1
    found = _factor_windows(iter(batches), ["y"], input_size, horizon)
    if found.used:
        np.testing.assert_allclose(products(found), expected, rtol=1e-9, atol=1e-6)
    assert found.used == expected[0, 0]


def test_merged_factors_are_those_of_all_rows():
    """Parts with levels far apart, an empty one, and one with fewer rows than columns."""
    import pandas as pd

    draw = np.random.default_rng(2)
    parts, vectors = [], []
    for level, n in ((0.0, 30), (1e6, 50), (0.0, 0), (-300.0, 7)):
        frame = pd.DataFrame({"y": level + draw.normal(size=n), "x": 5 + draw.normal(size=n), "first_of_run": np.arange(n) == 0})
        parts.append(_factor_windows(iter([frame] if n else []), ["y", "x"], 3, 2))
        values = frame[["y", "x"]].to_numpy()[::-1]
        for s in range(n - 4):
            y, x = values[s : s + 5, 0], values[s : s + 3, 1]
            vectors.append([1, y[2], y[0] - y[2], y[1] - y[2], *x, y[3] - y[2], y[4] - y[2]])
    found, vectors = merge_factors(parts, 3), np.array(vectors)
    vectors[:, 1] -= found.shift[0]
    vectors[:, 4:7] -= found.shift[1]
    assert found.used == len(vectors)
    np.testing.assert_allclose(found.factor.T @ found.factor, vectors.T @ vectors, rtol=1e-9, atol=1e-3)


def test_factors_are_merged_in_groups(spark, panel):
    """More partitions than one task merges: a tree of groups gives the same fit."""
    size = {"input_size": L, "horizon": H}
    expected = window_factor(panel, **size)
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "70")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = window_factor(panel, **size)
    finally:
        spark.conf.set(name, before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.used == expected.used
    np.testing.assert_allclose(products(found), products(expected), rtol=1e-10, atol=1e-6)


def test_near_collinear_windows(spark):
    """A trend with tiny noise: cross-products would lose the noise, factors keep it."""
    draw = np.random.default_rng(8)
    data = {u: np.arange(300.0) * (u + 1) + 1e-6 * draw.normal(size=300) for u in range(4)}
    [model] = fit_linear(make_panel(spark, data), [NLinear()], input_size=L, horizon=H)
    x, y = windows_of(data)
    x = x[:, 0, :]
    last = x[:, -1:]
    direct = ridge_solution(x[:, :-1] - last, y - last, 0.0)(x[:, :-1] - last) + last
    found = applied(model, x)
    # The residuals, of the size of the noise, agree to a thousandth of it.
    np.testing.assert_allclose(found - y, direct - y, atol=2e-9)


def test_plan_does_not_grow_with_the_shape(spark):
    def nodes(size, horizon):
        model = LinearModel("M", size, np.zeros(horizon), np.ones((horizon, size)))
        frame = run_inference(make_panel(spark, {1: range(80)}), [model], horizon=horizon, input_size=size)
        return frame, frame._jdf.queryExecution().optimizedPlan().toString()

    (_, small), (frame, large) = nodes(2, 1), nodes(48, 12)
    assert small.count("named_struct") == large.count("named_struct") and small.count("(") == large.count("(")
    assert "from_json" not in large  # folded to a constant
    assert {r["y_hat"] for r in frame.collect()} == {float(sum(range(32, 80)))}


def test_moving_average():
    matrix = moving_average_matrix(4, 3)
    np.testing.assert_allclose(matrix @ np.array([3.0, 6.0, 9.0, 0.0]), [4.0, 6.0, 5.0, 3.0])


def test_cross_validation_of_a_linear_trend(spark):
    panel = make_panel(spark, {1: np.arange(60.0), 2: 500 - 2 * np.arange(60.0)})
    cv = cross_validate(panel, [NLinear()], horizon=3, input_size=4, n_windows=2)
    assert all(abs(r["y"] - r["y_hat"]) < 1e-6 for r in cv.collect())
    assert cv.columns == ["model", "unique_id", "ds", "cutoff", "y", "y_hat"]


def test_baselines(spark):
    panel = make_panel(spark, {1: [1, 2, 3, 4, 5, 6]})
    cv = cross_validate(panel, [Naive(), WindowAverage()], horizon=2, input_size=2, n_windows=2)
    assert rows(cv, "model", "ds", "cutoff", "y", "y_hat") == [
        ("Naive", at(2), at(1), 3.0, 2.0), ("Naive", at(3), at(1), 4.0, 2.0),
        ("Naive", at(4), at(3), 5.0, 4.0), ("Naive", at(5), at(3), 6.0, 4.0),
        ("WindowAverage", at(2), at(1), 3.0, 1.5), ("WindowAverage", at(3), at(1), 4.0, 1.5),
        ("WindowAverage", at(4), at(3), 5.0, 3.5), ("WindowAverage", at(5), at(3), 6.0, 3.5),
    ]


def test_user_function_failures_stay_local(spark):
    def picky(lags, horizon):
        if lags.max() > 100:
            raise ValueError("too high")
        return [lags.min()] * horizon

    panel = make_panel(spark, {1: [1, 2, 3, 4, 5, 6], 2: [1, 2, 300, 4, 5, 6], 3: [1]})
    models = [LocalForecaster("picky", picky), LocalForecaster("short", lambda lags, h: [0.0])]
    options = {"horizon": 2, "input_size": 2, "n_windows": 2}
    cv = cross_validate(panel, models, **options)
    picked = {(r["unique_id"], r["cutoff"]): r["y_hat"] for r in cv.where("model = 'picky'").collect()}
    assert picked == {(1, at(1)): 1.0, (1, at(3)): 3.0, (2, at(1)): 1.0, (2, at(3)): None}
    status = fit_status(
        cv_runs(panel, models, step=None, test_size=None, layout=measure_series(panel), **options)
    )
    assert rows(status.where("model = 'picky'")) == [
        ("picky", 1, "ok", None), ("picky", 2, "failed", "ValueError: too high"),
    ]
    assert rows(fit_summary(status)) == [("picky", "failed", 1), ("picky", "ok", 1), ("short", "failed", 2)]


def test_stored_coefficients_give_the_same_forecasts(spark, exog_panel, tmp_path):
    specs = [NLinear(), LinearExog(exogenous=("carbs",))]
    fitted = fit_all(exog_panel, specs, horizon=H, input_size=L)
    save_params(spark, fitted, str(tmp_path / "params"), "run_1")
    save_params(spark, fitted[:1], str(tmp_path / "params"), "run_2")
    loaded = load_params(spark, str(tmp_path / "params"), "run_1")
    assert sorted(m.name for m in loaded) == ["Linear_exog", "NLinear"]
    assert [m.name for m in load_params(spark, str(tmp_path / "params"), "run_2")] == ["NLinear"]
    options = {"horizon": H, "input_size": L}
    assert rows(run_inference(exog_panel, loaded, **options)) == rows(run_inference(exog_panel, fitted, **options))


def test_unfit_models_raise(spark, panel):
    with pytest.raises(NotFitted):
        fit_linear(make_panel(spark, {1: range(5)}), [NLinear()], input_size=L, horizon=H)
    [model] = fit_linear(panel, [NLinear()], input_size=L, horizon=H)
    with pytest.raises(ValueError):
        model.forecast(H + 1)


def test_constant_series_fit(spark):
    panel = make_panel(spark, {1: [5.0] * 40})
    cv = cross_validate(panel, [NLinear(), DLinear()], horizon=2, input_size=6, n_windows=1)
    assert all(abs(r["y_hat"] - 5.0) < 1e-9 for r in cv.collect())


def test_predict_is_run_inference_of_one_model(spark):
    panel = make_panel(spark, {1: range(10)})
    one = forecast.predict(panel, Naive(), horizon=2, input_size=3)
    assert rows(one) == [("Naive", 1, at(10), 9.0), ("Naive", 1, at(11), 9.0)]
