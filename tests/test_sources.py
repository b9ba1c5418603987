import pytest

from rollcast.operators.score import leaderboard
from rollcast.sources.results import (
    export_by_model,
    import_cv_results,
    import_predictions,
    read_metrics,
    read_summary,
    write_cv_results,
    write_metrics,
    write_predictions,
    write_summary,
)
from rollcast.sources.scratch import shared_folder, store
from conftest import at, rows


def test_import_reads_each_file_with_its_own_column(spark, tmp_path):
    (tmp_path / "cv_results_A.csv").write_text(
        "unique_id,ds,cutoff,y,A\n1,2024-01-01T00:05:00,2024-01-01T00:00:00,1.0,2.0\n")
    (tmp_path / "cv_results_B.csv").write_text(
        "unique_id,ds,cutoff,y,B\n1,2024-01-01 00:05:00.000000,2024-01-01 00:00:00,1.0,NaN\n2,2024-01-01T00:05:00,,3.0,\n")
    (tmp_path / "cv_results_C_exog.csv").write_text(
        "unique_id,ds,cutoff,y,C\n1,2024-01-01T00:05:00,2024-01-01T00:00:00,1.0,4.0\n")
    (tmp_path / "cv_results_D.csv").write_text("unique_id,ds,y,Other\n1,2024-01-01T00:05:00,1.0,4.0\n")
    (tmp_path / "cv_results_E.csv").write_text("unique_id,ds,E\n1,2024-01-01T00:05:00,4.0\n")
    (tmp_path / "metrics.csv").write_text("unique_id,metric,A\n1,mae,1.0\n")
    frame, skipped = import_cv_results(spark, str(tmp_path))
    assert frame.columns == ["model", "unique_id", "ds", "cutoff", "y", "y_hat"]
    assert rows(frame) == [
        ("A", 1, at(1), at(0), 1.0, 2.0),
        ("B", 1, at(1), at(0), 1.0, None),
        ("B", 2, at(1), None, 3.0, None),
        ("C_exog", 1, at(1), at(0), 1.0, 4.0),
    ]
    assert sorted(p.rsplit("/", 1)[1] for p in skipped) == ["cv_results_D.csv", "cv_results_E.csv"]


def test_import_of_an_empty_folder(spark, tmp_path):
    frame, skipped = import_cv_results(spark, str(tmp_path))
    assert frame.count() == 0 and not skipped and "y_hat" in frame.columns


def test_export_and_import_of_predictions(spark, tmp_path):
    data = [("A", "x", at(0).replace(microsecond=123456), 1.5), ("B", "x", at(1), None)]
    frame = spark.createDataFrame(data, "model string, unique_id string, ds timestamp_ntz, y_hat double")
    export_by_model(frame, str(tmp_path), "predictions_")
    back = import_predictions(spark, str(tmp_path), id_type="string").frame
    assert rows(back) == rows(frame)


def test_writing_a_model_again_replaces_only_that_model(spark, tmp_path):
    path = str(tmp_path / "cv")
    columns = "run_id string, model string, unique_id bigint, y_hat double"
    for data in ([("r1", "A", 1, 1.0), ("r1", "B", 1, 2.0)], [("r1", "B", 1, 3.0)], [("r2", "A", 1, 4.0)]):
        write_cv_results(spark.createDataFrame(data, columns), path)
    table = spark.read.parquet(path)
    assert rows(table, "run_id", "model", "y_hat") == [("r1", "A", 1.0), ("r1", "B", 3.0), ("r2", "A", 4.0)]
    plan = table.where("run_id = 'r2'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan


def test_files_are_rebalanced_by_run_and_model(spark):
    frame = spark.createDataFrame([("r", "A", 1.0)], "run_id string, model string, y_hat double")
    plan = frame.hint("rebalance", "run_id", "model")._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan and "hashpartitioning(run_id" in plan


def test_predictions_table(spark, tmp_path):
    frame = spark.createDataFrame([("A", 1, 1.0)], "model string, unique_id bigint, y_hat double")
    write_predictions(frame, str(tmp_path / "p"))
    assert rows(spark.read.parquet(str(tmp_path / "p")), "model", "y_hat") == [("A", 1.0)]


@pytest.fixture
def metrics(spark):
    data = [("A", 1, "mae", 1.0), ("A", 2, "mae", 3.0), ("B", 1, "mae", 1.5), ("A", 1, "mse", 0.1)]
    return spark.createDataFrame(data, "model string, unique_id bigint, metric string, value double")


def test_metrics_files(spark, metrics, tmp_path):
    write_metrics(metrics, str(tmp_path / "long"), str(tmp_path / "wide"))
    assert rows(spark.read.parquet(str(tmp_path / "long")).select(metrics.columns)) == rows(metrics)
    assert rows(read_metrics(spark, str(tmp_path / "wide")).select(metrics.columns)) == rows(metrics)


@pytest.mark.parametrize("layout", ["wide", "means", "by_metric"])
def test_summary_is_read_from_any_layout(spark, metrics, tmp_path, layout):
    write_summary(leaderboard(metrics), str(tmp_path / layout), layout)
    back = read_summary(spark, str(tmp_path / layout)).where("mean is not null")
    expected = [("A", "mae", 2.0), ("A", "mse", 0.1), ("B", "mae", 1.5)]
    assert rows(back, "model", "metric", "mean") == expected
    with_std = back.where("std is not null").count()
    assert with_std == (0 if layout == "means" else 1)


def test_missing_summary_gives_no_rows(spark, tmp_path):
    assert read_summary(spark, str(tmp_path / "none")).count() == 0


def test_shared_folder_comes_from_the_session(spark):
    class Session:
        conf = {"spark.checkpoint.dir": "hdfs:///shared/"}

    first, second = shared_folder(Session), shared_folder(Session)
    assert first.startswith("hdfs:///shared/rollcast-") and first != second
    assert shared_folder(spark) != shared_folder(spark)


def test_a_cluster_without_a_shared_folder_raises():
    class Session:
        conf = {"spark.master": "local-cluster[3,2,1024]"}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)


def test_store_keeps_rows_and_types(spark, metrics):
    stored = store(metrics)
    assert stored.schema.simpleString() == metrics.schema.simpleString()
    assert rows(stored) == rows(metrics)


def scans_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("FileScan text")


def test_many_files_are_one_scan(spark, tmp_path):
    """The plan does not grow with the files; every file has its own columns and order."""
    plans = []
    for count in (5, 2000):
        folder = tmp_path / str(count)
        folder.mkdir()
        for i in range(count):
            order = ["unique_id", "ds", "y", f"M{i}"] if i % 2 else [f"M{i}", "extra", "y", "ds", "unique_id"]
            cells = {"unique_id": "1", "ds": "2024-01-01T00:00:00", "y": "2.5", f"M{i}": str(i / 4), "extra": '"a, b"'}
            (folder / f"cv_results_M{i}.csv").write_text("\n".join([",".join(order), ",".join(cells[c] for c in order)]) + "\n")
        frame, skipped = import_cv_results(spark, str(folder))
        assert not skipped and scans_of(frame) == 1
        plans.append(len(frame._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(plans[1] - plans[0]) < 200
    assert rows(frame, "model", "y", "y_hat") == sorted((f"M{i}", 2.5, i / 4) for i in range(2000))


def test_awkward_files(spark, tmp_path):
    files = {
        "Windows line ends": "unique_id,ds,y,Windows line ends\r\n1,2024-01-01T00:00:00,1,2\r\n",
        "With+plus": "unique_id,ds,y,With+plus\n1,2024-01-01T00:00:00,1,3\n",
        "Quoted": 'unique_id,ds,y,"Quoted"\n"1","2024-01-01T00:00:00","1","4"\n',
        "Twice": "unique_id,ds,y,Twice\n1,2024-01-01T00:00:00,1,5\n\nunique_id,ds,y,Twice\n1,2024-01-01T00:05:00,,nan\n",
        "HeaderOnly": "unique_id,ds,y,HeaderOnly\n", "Empty": "", "Wrong": "unique_id,ds\n1,2024-01-01T00:00:00\n",
        "Plain_exog": "unique_id,ds,y,cutoff,Plain\n1,2024-01-01T00:00:00,1,2023-12-31T00:00:00,6\n",
    }
    for name, text in files.items():
        (tmp_path / f"cv_results_{name}.csv").write_bytes(text.encode())
    frame, skipped = import_cv_results(spark, str(tmp_path))
    assert skipped == {f"{tmp_path}/cv_results_Empty.csv": "empty file", f"{tmp_path}/cv_results_Wrong.csv": "missing columns: y"}
    found = {(r["model"], r["y"], r["y_hat"], r["cutoff"] is None) for r in frame.collect()}
    assert found == {
        ("Windows line ends", 1.0, 2.0, True), ("With+plus", 1.0, 3.0, True), ("Quoted", 1.0, 4.0, True),
        ("Twice", 1.0, 5.0, True), ("Twice", None, None, True), ("Plain_exog", 1.0, 6.0, False),
    }
