"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the session names in ``spark.checkpoint.dir``.

    All executors must see that folder.  A session without the setting gets a
    temporary folder if it runs in this one process (``local[n]``), else an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="rollcast-")
    return f"{base.rstrip('/')}/rollcast-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path as it knows it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder when the session's process ends."""
    files, folder = file_system(spark, path)
    files.deleteOnExit(folder)


def store(frame: DataFrame, path: str | None = None) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back.

    Later steps start from the files, so a lost executor costs no recomputation.
    Shuffle files of the finished step are freed at once.  Without a ``path`` the table
    is scratch and goes when the process ends.
    """
    spark = frame.sparkSession
    if path is None:
        path = shared_folder(spark)
        delete_at_end(spark, path)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        frame.write.mode("errorifexists").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(frame.schema).parquet(path)


def remove_partitions(spark: SparkSession, path: str, keys: dict[str, list[str]]) -> None:
    """Delete the partitions of a stored table whose keys, outermost first, have these values."""
    files, folder = file_system(spark, path)
    found = [folder] if files.exists(folder) else []
    for key, values in keys.items():
        names = {f"{key}={value}" for value in values}
        inside = [status.getPath() for parent in found for status in files.listStatus(parent)]
        found = [child for child in inside if unquote(child.getName()) in names]
    for partition in found:
        files.delete(partition, True)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later step reads."""
    files, folder = file_system(spark, path)
    files.delete(folder, True)
