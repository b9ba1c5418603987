"""Stored runs that are replaced as a whole.

Result tables are partitioned by run and generation.  A job writes all its tables under a
new generation, and then appends one row to the table ``commits``: with that row the
generation is the run's current one, for all tables at once.  Until then readers see the
generation before, whatever became of the job.  Older generations are deleted only after
the row is written; what a stopped job left is deleted with the next replacement.
"""

from __future__ import annotations

import time
import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcast.sources.scratch import file_system

COMMITS = "commits"
COMMIT_SCHEMA = "run_id string, generation string"

# Partition columns of result tables; always text, whatever their values look like.
PARTITIONS = ("run_id", "generation", "model")


def new_generation() -> str:
    """A name that sorts after all earlier ones."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def publish(spark: SparkSession, folder: str, run_id: str, generation: str) -> None:
    """Make a generation the current one of its run: one row, in one file."""
    row = spark.createDataFrame([(run_id, generation)], COMMIT_SCHEMA)
    row.coalesce(1).write.mode("append").parquet(f"{folder}/{COMMITS}")


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The current generation of every run: ``run_id, generation``."""
    try:
        commits = spark.read.schema(COMMIT_SCHEMA).parquet(f"{folder}/{COMMITS}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        commits = spark.createDataFrame([], COMMIT_SCHEMA)
    return commits.groupBy("run_id").agg(F.max("generation").alias("generation"))


def current(spark: SparkSession, folder: str, run_id: str | None = None) -> tuple[str, str] | None:
    """Run id and current generation of a run, or of the greatest run id; None without any."""
    found = published(spark, folder)
    if run_id is not None:
        found = found.where(F.col("run_id") == run_id)
    row = found.orderBy(F.desc("run_id")).first()
    return (row["run_id"], row["generation"]) if row else None


def stored_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """Schema of a stored result table; None if there is no such table."""
    try:
        found = spark.read.parquet(path).schema
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return T.StructType([T.StructField(f.name, T.StringType()) if f.name in PARTITIONS else f for f in found])


def read_current(
    spark: SparkSession, folder: str, table: str, at: tuple[str, str] | None = None, schema=None
) -> DataFrame | None:
    """A result table's current rows: of one run and generation, or of all published runs."""
    path = f"{folder}/{table}"
    schema = schema or stored_schema(spark, path)
    if schema is None:
        return None
    rows = spark.read.schema(schema).parquet(path)
    if at is None:
        rows = rows.join(published(spark, folder), ["run_id", "generation"], "left_semi")
    else:
        # Literals, so that only this run's folders are listed and read.
        rows = rows.where((F.col("run_id") == at[0]) & (F.col("generation") == at[1]))
    return rows.drop("generation")


def remove_older(spark: SparkSession, folder: str, tables: tuple[str, ...], run_id: str, generation: str) -> None:
    """Delete the generations of a run that sort before this one."""
    for table in tables:
        files, root = file_system(spark, f"{folder}/{table}")
        if not files.exists(root):
            continue
        of_run = [s.getPath() for s in files.listStatus(root) if unquote(s.getPath().getName()) == f"run_id={run_id}"]
        for run in of_run:
            for status in files.listStatus(run):
                name = unquote(status.getPath().getName())
                if name.startswith("generation=") and name.removeprefix("generation=") < generation:
                    files.delete(status.getPath(), True)
