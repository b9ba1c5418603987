"""Small helpers of the corpus operators: row packing, row keys, prefix sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of one Arrow batch: texts may be long, so batches are short.
BATCH_ROWS = 512

ROW = "__row"


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def without(frame: DataFrame, *names: str) -> DataFrame:
    """Input columns that clash with result columns are replaced by the results."""
    return frame.select(*[column(c) for c in frame.columns if c not in names])


def row_key(id_column: str, text_column: str) -> Column:
    """What identifies a document: its id and its text; repeated rows share it."""
    return F.struct(column(id_column).alias("id"), F.xxhash64(column(text_column)).alias("h"))


def texts_of(values: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    for value in values.cast(pa.large_binary()):
        yield value.as_py() or b""


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def annotate(
    docs: DataFrame, text: str, results: T.StructType,
    function: Callable[[], Callable[[Iterator[bytes]], dict[str, pa.Array]]],
) -> DataFrame:
    """Add result columns computed from the whole text of each row, in Arrow batches.

    ``function`` is called once per task and returns what turns the texts of a batch
    into arrays by result name.  Other columns pass through; clashing ones are replaced.
    """
    names = [f.name for f in results]
    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(
        F.struct(*[column(c).alias(c) for c in kept]).alias(ROW), column(text).cast("string").alias("__text")
    )
    schema = T.StructType([rows.schema[ROW], *results.fields])
    types = {f.name: _arrow_type(f.dataType) for f in results}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = function()
        for batch in small_batches(batches):
            found = work(texts_of(batch.column(1)))
            arrays = [pa.array(found[n], types[n]) if not isinstance(found[n], pa.Array) else found[n] for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [ROW, *names])

    mapped = rows.mapInArrow(run, schema)
    return mapped.select(*[F.col(ROW).getField(c).alias(c) for c in kept], *names)


def _arrow_type(dtype: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(dtype)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression once, so that lambdas inside ``body`` do not evaluate it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_total(
    frame: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, name: str
) -> DataFrame:
    """Add the sum of ``value`` over the earlier rows of the group, as ``name``.

    Rows are ordered by ``bucket``, then ``order``.  No task sees a whole group: buckets
    are summed first, and a row adds the sum of the earlier buckets to its place within
    its own bucket.
    """
    from pyspark.sql import Window

    keys = [*group, bucket]
    sums = frame.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start")
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = frame.withColumn("__local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return (
        local.join(sums, same)
        .withColumn(name, F.col("__start") + F.col("__local"))
        .drop("__start", "__local", *[f"__{k}" for k in keys])
    )
