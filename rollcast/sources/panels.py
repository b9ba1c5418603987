"""Panels made from the star-schema and event tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcast.operators.panel import EVENT_COLUMN, SERIES_COLUMN, TIME_COLUMN, VALUE_COLUMN
from rollcast.operators.series import ID, TS, Y, SeriesLayout, grid_layout, measure_series


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_readings(spark: SparkSession, folder: str) -> DataFrame:
    """The events as raw text readings; the JSON number plays the exogenous column."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias(EVENT_COLUMN),
        F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T")).alias(TIME_COLUMN),
        F.col("value").cast("string").alias(VALUE_COLUMN),
        F.get_json_object("props", "$.k").alias("Carb Value (grams)"),
        F.col("user_id").cast("string").alias(SERIES_COLUMN),
    )


def events_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Many short series: one per user, with ``carbs`` as exogenous column."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias(ID),
        F.col("ts").alias(TS),
        F.col("value").alias(Y),
        F.get_json_object("props", "$.k").cast("double").alias("carbs"),
    )


def orders_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Five long series with text ids: daily order value by priority."""
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_orderpriority").alias(ID), F.col("o_orderdate").alias(TS))
        .agg(F.sum("o_totalprice").alias(Y))
    )


def supplier_panel(spark: SparkSession, folder: str) -> DataFrame:
    """One long series per supplier: quantity shipped per day."""
    day = F.col("l_shipdate").cast("date").cast("timestamp_ntz")
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias(ID), day.alias(TS))
        .agg(F.sum("l_quantity").alias(Y))
    )


def supplier_layout(spark: SparkSession, folder: str) -> SeriesLayout:
    """Layout of ``supplier_panel``: one row per day at most, so the date range bounds a series."""
    span = table(spark, folder, "lineitem").agg(
        F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last")
    ).first()
    small = span["first"] and grid_layout(span["first"], span["last"], timedelta(days=1))
    return small or measure_series(supplier_panel(spark, folder))
