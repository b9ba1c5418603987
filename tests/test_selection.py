import pytest
from pyspark.sql import functions as F

from rollcast.operators.runs import latest_run_results, run_overview, trained_models
from rollcast.operators.traces import dashboard_traces
from rollcast.operators.selection import (
    best_models,
    best_series,
    drop_empty_models,
    missing_pairs,
    pick_best_series,
    sample_series,
    select_models,
    usable_models,
)
from conftest import at, rows

METRICS = "model string, unique_id bigint, metric string, value double"
PREDICTIONS = "model string, unique_id bigint, ds timestamp_ntz, y_hat double"
SUMMARY = "model string, metric string, mean double"


def metrics_of(spark, data):
    return spark.createDataFrame([(m, u, "mae", v) for m, u, v in data], METRICS)


def predictions_of(spark, pairs, value=1.0):
    return spark.createDataFrame([(m, u, at(0), value) for m, u in pairs], PREDICTIONS)


def test_best_series_averages_models_and_breaks_ties_by_id(spark):
    metrics = metrics_of(spark, [
        ("A", 3, 1.0), ("B", 3, 3.0), ("A", 2, 2.0), ("B", 2, None), ("A", 1, 9.0), ("B", 4, None),
    ])
    assert rows(best_series(metrics, 10)) == [(1, 9.0), (2, 2.0), (3, 2.0)]
    assert [r["unique_id"] for r in best_series(metrics, 2).collect()] == [2, 3]
    assert pick_best_series(metrics) == 2
    with pytest.raises(ValueError):
        pick_best_series(metrics, "rmse")


def test_sample_depends_on_the_seed_only(spark):
    metrics = metrics_of(spark, [("A", u, 1.0) for u in range(50)])
    def draw(frame, seed):
        return [r[0] for r in sample_series(frame, seed, 5).collect()]

    assert draw(metrics, 1) == draw(metrics.repartition(7), 1)
    assert draw(metrics, 1) != draw(metrics, 2)


def test_best_models(spark):
    summary = spark.createDataFrame(
        [("A", "mae", 2.0), ("B", "mae", 1.0), ("C", "mae", None), ("D", "mae", float("nan")),
         ("E", "mae", 1.0), ("A", "rmse", 0.1)], SUMMARY)
    assert [r["model"] for r in best_models(summary, 2).collect()] == ["B", "E"]
    assert [r["model"] for r in best_models(summary).collect()] == ["B", "E", "A"]
    assert best_models(summary, metric="mape").count() == 0


def test_select_models(spark):
    predictions = predictions_of(spark, [(m, u) for m in "ABCD" for u in (1, 2, 3)])
    metrics = metrics_of(spark, [
        ("A", 1, 40.0), ("B", 1, 39.0), ("C", 1, None),            # D has no score on series 1
        ("A", 2, 5.0), ("B", 2, 5.0), ("C", 2, float("inf")), ("D", 2, 4.0),
        ("Z", 1, 1.0),                                              # scored but not predicted
    ])
    def chosen(**options):
        return rows(select_models(predictions, metrics, **options), "unique_id", "model", "rank")

    unfiltered = [(3, m, None) for m in "ABCD"]
    # Strictly below the threshold; missing and infinite scores go; series 3 has no scores at all.
    assert chosen(max_mae=40.0) == [(1, "B", 1), (2, "A", 2), (2, "B", 3), (2, "D", 1), *unfiltered]
    assert chosen(top_n=1) == [(1, "B", 1), (2, "D", 1), *unfiltered]
    assert chosen(max_mae=5.0, top_n=3) == [(2, "D", 1), *unfiltered]
    assert len(chosen()) == 12


def test_a_series_scored_only_for_other_models_is_filtered(spark):
    chosen = select_models(predictions_of(spark, [("A", 1)]), metrics_of(spark, [("Z", 1, 1.0)]), top_n=3)
    assert chosen.count() == 0


def test_usable_models_and_fallback(spark):
    predictions = predictions_of(spark, [("A", 1), ("B", 1), ("C", 2)])
    best = spark.createDataFrame([("B", 1.0), ("X", 2.0)], "model string, mean double")
    assert rows(usable_models(predictions, best), "model") == [("B",)]
    none = best.where("model = 'X'")
    assert rows(usable_models(predictions, none), "model") == [("A",), ("B",), ("C",)]
    assert usable_models(predictions, best.where("false")).count() == 3


def test_selection_is_lazy(spark):
    """Building the frames starts no job, and no plan pairs all series with all models."""
    predictions = predictions_of(spark, [("A", 1), ("B", 1), ("C", 2)])
    best = spark.createDataFrame([("B", 1.0)], "model string, mean double")
    tracker, group = spark.sparkContext.statusTracker(), "lazy-selection"
    spark.sparkContext.setJobGroup(group, group)
    try:
        frames = [
            usable_models(predictions, best), drop_empty_models(predictions),
            missing_pairs(predictions, ["A", "B", "C"], predictions),
            dashboard_traces(predictions.withColumn("y", F.lit(1.0)), predictions),
        ]
        assert not tracker.getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for frame in frames:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
        assert frame.count()


def test_missing_pairs_of_many_models_and_null_ids(spark):
    results = spark.createDataFrame([("m7", None, at(0), 1.0), ("m8", 1, at(0), 1.0)], PREDICTIONS)
    panel = spark.createDataFrame([(1,), (None,), (None,)], "unique_id bigint")
    names = [f"m{i}" for i in range(1500)]
    found = missing_pairs(panel, names, results)
    assert rows(found.groupBy("unique_id").count()) == [(1, 1499), (None, 1499)]
    assert missing_pairs(panel, [], results).count() == 0


def test_missing_pairs(spark):
    results = predictions_of(spark, [("A", 1), ("A", 2), ("B", 1)])
    panel = spark.createDataFrame([(1,), (1,), (2,), (3,)], "unique_id bigint")
    assert rows(missing_pairs(panel, ["A", "B"], results)) == [("A", 3), ("B", 2), ("B", 3)]


def test_empty_models_are_dropped(spark):
    predictions = predictions_of(spark, [("A", 1)]).unionByName(
        predictions_of(spark, [("N", 1)], None)).unionByName(
        predictions_of(spark, [("Q", 1), ("P", 2)], float("nan"))).unionByName(
        predictions_of(spark, [("P", 1)]))
    assert rows(drop_empty_models(predictions), "model", "unique_id") == [("A", 1), ("P", 1), ("P", 2)]


def test_runs(spark):
    data = [("run_2", "A", 1, at(0)), ("run_2", "B", 1, at(1)), ("run_2", "B", 2, at(2)), ("run_10", "A", 1, at(5))]
    results = spark.createDataFrame(data, "run_id string, model string, unique_id bigint, ds timestamp_ntz")
    overview = run_overview(results)
    assert [tuple(r) for r in overview.collect()] == [
        ("run_2", 2, 2, 3, at(0), at(2)), ("run_10", 1, 1, 1, at(5), at(5)),
    ]
    # The greatest id by name, not the newest in time.
    assert rows(latest_run_results(results), "run_id", "model") == [("run_2", "A"), ("run_2", "B"), ("run_2", "B")]
    assert rows(trained_models(results)) == [("A", 1, 2), ("B", 2, 2)]
