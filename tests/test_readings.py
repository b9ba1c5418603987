from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rollcast.functions import clean_numeric, row_mean, strict_cast
from rollcast.operators.panel import missing_exogenous, prepare_readings, profile_panel, profile_series
from rollcast.sources.readings import read_readings, readings_schema
from rollcast.streaming.readings import stream_readings
from conftest import rows

HEADER = (
    "Event Type,Timestamp (YYYY-MM-DDThh:mm:ss),Glucose Value (mg/dL),"
    "Fast-Acting Insulin Value (u),Long-Acting Insulin Value (u),Carb Value (grams),sequence_id\n"
)
LINES = [
    'EGV,2024-01-01T00:00:00,100,,,"1,200.5",0',
    "EGV,2024-01-01T00:05:00,,,,5,0",
    "EGV,2024-01-01T00:10:00,110,1.5,,x,0",
    "EGV,2024-01-01T00:15:00,112,,7,5d,0",
    "Carbs,2024-01-01T00:16:00,,,,30,0",
    "EGV,2024-01-01T00:20:00,90.5,,,NaN,1",
]


@pytest.fixture
def readings_file(tmp_path):
    def write(lines, name="readings.csv", header=HEADER):
        path = tmp_path / name
        path.write_text(header + "\n".join(lines) + "\n")
        return str(path)

    return write


def test_base_panel(spark, readings_file):
    panel = prepare_readings(read_readings(spark, readings_file(LINES)))
    assert panel.dtypes == [("unique_id", "bigint"), ("ds", "timestamp_ntz"), ("y", "double")]
    assert rows(panel) == [
        (0, datetime(2024, 1, 1, 0, 0), 100.0),
        (0, datetime(2024, 1, 1, 0, 10), 110.0),
        (0, datetime(2024, 1, 1, 0, 15), 112.0),
        (1, datetime(2024, 1, 1, 0, 20), 90.5),
    ]


def test_exogenous_values_are_cleaned_and_never_drop_a_row(spark, readings_file):
    raw = read_readings(spark, readings_file(LINES))
    panel = prepare_readings(raw, include_exogenous=True)
    assert panel.columns == ["unique_id", "ds", "y", "fast_insulin", "long_insulin", "carbs"]
    assert missing_exogenous(raw) == ["flow_amount"]
    # The 30 grams on the carbs event never reach a reading.
    assert [r.carbs for r in panel.orderBy("ds").collect()] == [1200.5, 0.0, 0.0, 0.0]
    assert [r.fast_insulin for r in panel.orderBy("ds").collect()] == [0.0, 1.5, 0.0, 0.0]


@pytest.mark.parametrize(
    "line",
    [
        "EGV,2024-01-01T00:20:00,Low,,,,0",
        "EGV,2024-01-01T00:20:00,5d,,,,0",
        "EGV,yesterday,100,,,,0",
        "EGV,2024-01-01T00:20:00,100,,,,zero",
    ],
)
def test_malformed_keys_and_targets_raise(spark, readings_file, line):
    panel = prepare_readings(read_readings(spark, readings_file([*LINES, line])))
    with pytest.raises(PySparkException):
        panel.collect()


def test_malformed_value_on_another_event_is_ignored(spark, readings_file):
    raw = read_readings(spark, readings_file([*LINES, "Note,2024-01-01T00:20:00,Low,,,,0"]))
    assert prepare_readings(raw).count() == 4


def test_strict_cast_does_not_depend_on_ansi(spark):
    frame = spark.createDataFrame([("Low",)], "v string")
    try:
        spark.conf.set("spark.sql.ansi.enabled", "false")
        with pytest.raises(PySparkException):
            frame.select(strict_cast(F.col("v"), "double")).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_numbers(spark):
    texts = ["1", "-2.5", "+.5", "1,234,567.8", "1e3", " 7", "", None, "Infinity", "0x1A"]
    frame = spark.createDataFrame([(t,) for t in texts], "v string")
    values = [r[0] for r in frame.select(clean_numeric(F.col("v"))).collect()]
    assert values == [1.0, -2.5, 0.5, 1234567.8, 1000.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_row_mean_skips_nulls(spark):
    frame = spark.createDataFrame([(1.0, 3.0, None), (None, None, None)], "a double, b double, c double")
    means = [r[0] for r in frame.select(row_mean(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert means == [2.0, None]


def test_event_filter_reaches_the_scan(spark, readings_file):
    panel = prepare_readings(read_readings(spark, readings_file(LINES)))
    plan = panel._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(Event Type,EGV)" in plan
    scan = next(line for line in plan.splitlines() if "ReadSchema" in line)
    assert "Carb Value" not in scan.split("ReadSchema")[1]


def test_profiles(spark, readings_file):
    panel = prepare_readings(read_readings(spark, readings_file(LINES)))
    assert rows(profile_panel(panel)) == [(4, 2, datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 20))]
    assert rows(profile_series(panel), "unique_id", "n_rows") == [(0, 3), (1, 1)]
    empty = panel.where("false")
    assert rows(profile_panel(empty)) == [(0, 0, None, None)]


def test_stream_gives_the_same_panel(spark, readings_file, tmp_path):
    batch = prepare_readings(read_readings(spark, readings_file(LINES)), include_exogenous=True)
    present = tuple(c for c in readings_schema().names[3:-1] if c != "flow_amount")
    stream = stream_readings(spark, str(tmp_path), exogenous=present, include_exogenous=True)
    job = (
        stream.writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    )
    job.awaitTermination(60)
    assert rows(spark.table("streamed")) == rows(batch)
