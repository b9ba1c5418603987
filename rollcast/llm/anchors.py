"""Anchors: positions that equal passages have in common, and which of them occur again.

Of the hashes of all runs of ``seed`` units inside a window, the least is the window's
seed; positions that are least in some window are anchors.  Equal windows have equal
seeds, so a window whose seed occurs once in the corpus occurs once.  About ``2 / (window
- seed + 2)`` of all positions are anchors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcast.llm.common import small_batches, texts_of
from rollcast.sources.scratch import discard, shared_folder, store

SEEDS = T.StructType([
    T.StructField("seed", T.LongType()), T.StructField("key", T.LongType()), T.StructField("times", T.LongType())
])


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours."""
    pick, done = (np.minimum if least else np.maximum), 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


def window_seeds(hashes: np.ndarray, width: int) -> np.ndarray:
    """The seed of every window, given the hashes of its runs; ``width`` runs make a window."""
    return sliding(hashes, width, True) if len(hashes) >= width else hashes[:0]


def anchor_positions(hashes: np.ndarray, seeds: np.ndarray, width: int) -> np.ndarray:
    """Positions whose hash is the seed of some window that holds them."""
    if not len(seeds):
        return np.zeros(0, np.int64)
    pad = np.zeros(width - 1, np.uint64)
    most = sliding(np.concatenate((pad, seeds, pad)), width, False)
    return np.flatnonzero(most == hashes)


def seed_counts(docs: DataFrame, hashes_of: Callable[[bytes], np.ndarray], width: int) -> DataFrame:
    """``seed, key, times``: how often each document has each of its seeds as an anchor.

    ``docs`` has ``key`` (a hash of the document) and ``text``.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            seeds, keys, times = [], [], []
            for key, text in zip(batch.column("key").to_pylist(), texts_of(batch.column("text"))):
                hashes = hashes_of(text)
                found = anchor_positions(hashes, window_seeds(hashes, width), width)
                values, n = np.unique(hashes[found], return_counts=True)
                seeds.append(values)
                keys.append(np.full(len(values), key, np.int64))
                times.append(n)
            if seeds:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(seeds).view(np.int64)), pa.array(np.concatenate(keys)),
                     pa.array(np.concatenate(times).astype(np.int64))],
                    SEEDS.names,
                )

    return docs.select("key", "text").mapInArrow(find, SEEDS)


def repeated_seeds(seeds: DataFrame) -> DataFrame:
    """``key, seeds``: of each document the seeds that occur again, with their number ``n``.

    Counting is combined before the shuffle, and a seed that very many documents have
    is split by Spark's skew join; the result is stored.
    """
    spark = seeds.sparkSession
    path = shared_folder(spark)
    kept = store(seeds, path)
    again = kept.groupBy("seed").agg(F.sum("times").alias("n")).where("n > 1")
    met = kept.select("seed", "key").join(again, "seed")
    found = store(met.groupBy("key").agg(F.collect_set(F.struct("seed", "n")).alias("seeds")))
    discard(spark, path)
    return found


def largest(again: DataFrame) -> int:
    """The most occurrences of a seed."""
    return again.agg(F.max(F.array_max(F.transform("seeds", lambda s: s["n"])))).first()[0] or 0


def chosen(again: DataFrame, wanted: Callable[[Column], Column]) -> DataFrame:
    """``key, seeds``: the seeds of each document that are wanted, without their numbers."""
    found = again.select("key", F.transform(F.filter("seeds", wanted), lambda s: s["seed"]).alias("seeds"))
    return found.where(F.size("seeds") > 0)


def runs_of_windows(own: np.ndarray, seeds: list[int]) -> Iterator[tuple[int, int, np.uint64]]:
    """Runs ``[a, b)`` of neighbouring windows that share one of the wanted seeds."""
    if not len(own):
        return
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    last = np.append(first[1:], len(own))
    keep = np.isin(own[first].view(np.int64), np.array(seeds, np.int64))
    yield from zip(first[keep].tolist(), last[keep].tolist(), own[first[keep]])


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables in which no seed's rows are split; rows come sorted by seed."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        seeds = table["seed"].to_numpy()
        changes = np.flatnonzero(seeds[1:] != seeds[:-1]) + 1
        if not len(changes):
            held = table
            continue
        held = table.slice(int(changes[-1]))
        yield table.slice(0, int(changes[-1])).combine_chunks()
    if held is not None:
        yield held.combine_chunks()


def leaf_runs(leaf: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of marked windows that lie in one row."""
    joined = np.concatenate(([False], leaf[1:] & leaf[:-1] & (row[1:] == row[:-1])))
    return np.flatnonzero(leaf & ~joined), np.flatnonzero(leaf & ~np.append(joined[1:], False))


def covered(spans: Sequence[dict] | None, n: int) -> np.ndarray:
    """Which of ``n`` units lie in a span ``from .. to``."""
    edge = np.zeros(n + 1, np.int64)
    if spans:
        np.add.at(edge, [s["from"] for s in spans], 1)
        np.add.at(edge, [s["to"] for s in spans], -1)
    return np.cumsum(edge[:-1]) > 0
