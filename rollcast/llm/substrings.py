"""Removal of repeated passages of words, by prefix-partitioned suffix trees.

A window of ``width`` words is a suffix of its document cut at that depth; windows that
occur again are the leaves below the tree's nodes of that depth.  The tree is never
built whole:

* Only suffixes that can lie below such a node are kept: those whose seed (the least
  hashed run of ``seed`` words inside, see ``anchors``) occurs again in the corpus.
* The seed is the string by which suffixes are dealt to groups.  A seed with up to
  ``group_rows`` occurrences makes one group, and its subtree is built in memory: suffixes
  are sorted by their path, and those with equal neighbours are under a deep node.
* For a seed with more occurrences the string is lengthened to the whole window.  Such a
  group is a single node, so its members are only counted, and never brought together;
  neighbouring suffixes that many documents have alike are merged before that.

Neighbouring leaves of a document join to its maximal repeats, the spans.

Defined results: null and empty texts have no words; documents shorter than a window
stay whole; repeated rows are documents of their own, so their windows repeat; documents
with the same id are told apart by their text; an empty table gives an empty result;
other columns pass through, clashing ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcast.llm.anchors import (
    chosen, covered, largest, leaf_runs, repeated_seeds, runs_of_windows, seed_counts, whole_groups, window_seeds,
)
from rollcast.llm.common import ROW, column, row_key, small_batches, texts_of
from rollcast.llm.hashing import Runs, word_hashes
from rollcast.sources.scratch import store

WIDTH = 35
SEED_WORDS = 8
GROUP_ROWS = 10_000

LONGS = T.ArrayType(T.LongType())
SUFFIXES = T.StructType([
    T.StructField("seed", T.LongType()), T.StructField("id", T.StringType()), T.StructField("h", T.LongType()),
    T.StructField("start", T.LongType()), T.StructField("paths", LONGS),
])
SPANS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("h", T.LongType()),
    T.StructField("from", T.LongType()), T.StructField("to", T.LongType()),
])


def _suffixes(docs: DataFrame, width: int, seed_words: int) -> DataFrame:
    """Runs of suffixes with the same seed: their first word, and the path of each to the full depth."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            out = [[], [], [], []]
            paths, lengths = [], []
            wanted = batch.column("seeds").to_pylist()
            for id_, h, seeds, text in zip(
                batch.column("id").to_pylist(), batch.column("h").to_pylist(), wanted, texts_of(batch.column("text"))
            ):
                runs = Runs(word_hashes(text)[2])
                own = window_seeds(runs.windows(seed_words), width - seed_words + 1)
                path = runs.windows(width)
                for a, b, seed in runs_of_windows(own, seeds):
                    out[0].append(seed)
                    out[1].append(id_)
                    out[2].append(h)
                    out[3].append(a)
                    paths.append(path[a:b])
                    lengths.append(b - a)
            if paths:
                offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
                values = pa.array(np.concatenate(paths).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(out[0], np.uint64).view(np.int64)), pa.array(out[1], pa.string()),
                     pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.ListArray.from_arrays(offsets, values)],
                    SUFFIXES.names,
                )

    return docs.mapInArrow(cut, SUFFIXES)


def _deep_nodes(width: int):
    """Per group of one seed: spans of the suffixes under nodes of full depth with two leaves or more."""

    def spans_of(table: pa.Table) -> pa.RecordBatch:
        lists = table["paths"].chunk(0)
        lengths = np.diff(lists.offsets.to_numpy())
        path, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lengths)), lengths)
        order = np.argsort(path, kind="stable")
        same = path[order][1:] == path[order][:-1]
        leaf = np.zeros(len(path), bool)
        leaf[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
        begin, end = leaf_runs(leaf, row)
        place = np.arange(len(path)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = row[begin]
        starts = table["start"].to_numpy()[at]
        picked = table.select(["id", "h"]).take(pa.array(at)).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [picked["id"].combine_chunks(), picked["h"].combine_chunks(),
             pa.array(starts + place[begin]), pa.array(starts + place[end] + width)],
            SPANS.names,
        )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal paths have equal seeds, so whole groups suffice."""
        yield from map(spans_of, whole_groups(batches))

    return walk


def repeated_spans(
    docs: DataFrame, *, width: int = WIDTH, seed_words: int = SEED_WORDS, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """``id, h, spans``: word ranges of each document that repeated windows cover.

    ``docs`` has ``id`` (a string), ``h`` and ``text``.
    """
    key = F.xxhash64("id", "h")
    keyed = docs.withColumn("key", key)
    hashes_of = _seed_hashes(seed_words)
    again = repeated_seeds(seed_counts(keyed, hashes_of, width - seed_words + 1))

    def suffixes(wanted):
        return _suffixes(keyed.join(chosen(again, wanted), "key"), width, seed_words)

    small = suffixes(lambda s: s["n"] <= group_rows).repartition("seed").sortWithinPartitions("seed")
    one = F.array(F.struct("from", "to")).alias("spans")
    spans = small.mapInArrow(_deep_nodes(width), SPANS).select("id", "h", one)
    if largest(again) > group_rows:
        spans = spans.unionByName(_whole_paths(suffixes(lambda s: s["n"] > group_rows), width))
    return spans.groupBy("id", "h").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def _whole_paths(runs: DataFrame, width: int) -> DataFrame:
    """Spans of the runs of frequent seeds: equal runs are merged, then whole paths counted.

    A run that many documents share is one row of the count, whatever their number.
    """
    runs = runs.withColumn("content", F.xxhash64("paths"))
    contents = runs.groupBy("content").agg(F.count("*").alias("n"), F.first("paths").alias("paths"))
    suffixes = contents.select("content", "n", F.posexplode("paths").alias("nth", "path"))
    nodes = suffixes.groupBy("path").agg(F.sum("n").alias("n")).where("n > 1").select("path")
    leaves = suffixes.join(nodes, "path").groupBy("content").agg(F.sort_array(F.collect_list("nth")).alias("nths"))
    first, last = F.element_at("nths", 1), F.element_at("nths", -1)
    span = lambda a, b: F.struct((F.col("start") + a).alias("from"), (F.col("start") + b + width).alias("to"))
    together = F.size("nths") == last - first + 1
    spans = F.when(together, F.array(span(first, last))).otherwise(F.transform("nths", lambda n: span(n, n)))
    return runs.select("content", "id", "h", "start").join(leaves, "content").select("id", "h", spans.alias("spans"))


def _seed_hashes(seed_words: int):
    return lambda text: Runs(word_hashes(text)[2]).windows(seed_words)


def remove_repeats(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH,
    seed_words: int = SEED_WORDS, group_rows: int = GROUP_ROWS, keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``n_words``, ``n_removed`` and ``kept_text`` (the words left, joined by a space)."""
    names = ("n_words", "n_removed", "kept_text")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    key = row_key(id_column, text_column)
    rows = docs.select(
        F.struct(*[column(c).alias(c) for c in kept]).alias(ROW), key["id"].cast("string").alias("id"),
        key["h"].alias("h"), column(text_column).cast("string").alias("text"),
    )
    spans = store(repeated_spans(
        rows.select("id", "h", "text"), width=width, seed_words=seed_words, group_rows=group_rows
    ).withColumnsRenamed({"id": "__i", "h": "__h"}))
    same = F.col("id").eqNullSafe(F.col("__i")) & (F.col("h") == F.col("__h"))
    met = rows.join(spans, same, "left").select(ROW, "text", "spans")
    results = T.StructType([
        met.schema[ROW], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept_text", T.StringType()),
    ])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            n_words, n_removed, texts = [], [], []
            for text, spans in zip(texts_of(batch.column("text")), batch.column("spans").to_pylist()):
                words = text.split()
                gone = covered(spans, len(words))
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                left = [w for w, g in zip(words, gone.tolist()) if not g] if spans else words
                texts.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(texts, pa.binary()).cast(pa.string())],
                results.names,
            )

    found = met.mapInArrow(apply, results)
    return found.select(*[F.col(ROW).getField(c).alias(c) for c in kept], *names)
