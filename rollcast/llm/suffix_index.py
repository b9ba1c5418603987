"""Removal of repeated byte strings by a logarithmic family of suffix indexes.

Documents arrive in batches, in the order of their ids.  A batch's suffixes, cut to what
a match of ``width`` bytes needs, are sorted (its suffix array) and merge-scanned against
the levels of the index: a string that an earlier suffix has is a match.  What is new
in the batch becomes a level; two levels of equal size merge into one of twice the size,
so there are few levels at any time and a suffix is rewritten a logarithmic number of
times.  A level is a stored table, distributed and sorted by the suffixes' first key.

Only suffixes that can match are indexed: those whose window's seed (see ``anchors``)
occurs again.  Neighbouring windows with one seed are one entry, with its bytes; of a
stretch that repeats itself (a line over and over) only the windows that are new in it
are kept, and the others are matches already.  Equal
strings have equal seeds, so entries are dealt to groups by seed.  A group is sorted and
scanned in memory.  A seed with more than ``group_rows`` occurrences is not brought
together: of its equal entries the earliest stands for all, and the windows of the
distinct ones get seeds from longer runs, up to the whole window.  Windows that reach into
text of their own have such a seed alone and are left out, so each round is smaller.
Copies never meet the earliest entry: a document is told which of its entries are
earliest, and its others are copies.

Defined results: a null text is empty; a null id comes after all others; documents with
the same id are ordered by a hash of their texts; repeated rows (same id and text) are
one document, so they do not match each other and get the same result; matches never
cross documents; an empty table gives an empty result; other columns pass through,
clashing ones are replaced.  Ids must be numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcast.llm.anchors import (
    covered, largest, leaf_runs, repeated_seeds, runs_of_windows, seed_counts, whole_groups, window_seeds,
)
from rollcast.llm.common import ROW, column, row_key, small_batches, texts_of
from rollcast.llm.hashing import byte_runs
from rollcast.sources.scratch import store

WIDTH = 100
SEED_BYTES = 32
GROUP_ROWS = 20_000
BATCHES = 4


def _fields(id_type: T.DataType, *more: T.StructField) -> T.StructType:
    return T.StructType([
        T.StructField("seed", T.LongType()), T.StructField("id", id_type), T.StructField("h", T.LongType()),
        T.StructField("start", T.LongType()), *more,
    ])


def _new_and_again(path: np.ndarray) -> list[list[tuple[int, int]]]:
    """Runs ``[a, b)`` of windows that are new among these, and of those that repeat one of them."""
    new = np.zeros(len(path), bool)
    new[np.unique(path, return_index=True)[1]] = True
    found = (leaf_runs(marked, np.zeros(len(path), np.int8)) for marked in (new, ~new))
    return [list(zip(first.tolist(), (last + 1).tolist())) for first, last in found]


def _entries(texts: DataFrame, width: int, seed_bytes: int) -> DataFrame:
    """Runs of windows with one seed: their place, their bytes, and whether the seed is ``frequent``.

    A run longer than the windows over one seed repeats that seed, and maybe windows:
    those are matches, with ``from`` and ``to`` and without ``content``.  ``texts`` has ``id, h``, the ``start`` of ``text`` in its document, and the wanted
    ``seeds`` with the ``frequent`` among them.
    """
    schema = _fields(
        texts.schema["id"].dataType, T.StructField("content", T.BinaryType()), T.StructField("from", T.LongType()),
        T.StructField("to", T.LongType()), T.StructField("frequent", T.BooleanType()),
    )
    most = width - seed_bytes + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            rows, found, seeds_out, starts, often = [], [], [], [], []
            matches = []
            columns = (batch.column(c).to_pylist() for c in ("seeds", "frequent", "start"))
            for i, (seeds, frequent, start, text) in enumerate(zip(*columns, texts_of(batch.column("text")))):
                runs = byte_runs(text)
                own = window_seeds(runs.windows(seed_bytes), most)
                many = set(np.array(frequent, np.int64).view(np.uint64).tolist())
                for a, b, seed in runs_of_windows(own, seeds):
                    new = ((a, b),)
                    if b - a > most:
                        at = np.arange(a, b)
                        new, again = ([(a + c, a + d) for c, d in x] for x in _new_and_again(runs.between(at, at + width)))
                        matches += [(i, start + c, start + d + width - 1) for c, d in again]
                    for c, d in new:
                        rows.append(i)
                        seeds_out.append(seed)
                        starts.append(start + c)
                        found.append(text[c : d + width - 1])
                        often.append(int(seed) in many)
            if rows:
                at, none = pa.array(rows), pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(seeds_out, np.uint64).view(np.int64)), batch.column("id").take(at),
                     batch.column("h").take(at), pa.array(starts, pa.int64()), pa.array(found, pa.binary()), none, none,
                     pa.array(often)],
                    schema.names,
                )
            if matches:
                at, begin, end = map(pa.array, zip(*matches))
                none = pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, batch.column("id").take(at), batch.column("h").take(at), none, pa.nulls(len(at), pa.binary()),
                     begin, end, pa.nulls(len(at), pa.bool_())],
                    schema.names,
                )

    return texts.select("id", "h", "start", "text", "seeds", "frequent").mapInArrow(cut, schema)


def _merge_scan(suffixes: DataFrame, width: int) -> DataFrame:
    """Scan sorted groups: the matches of new entries, and the entries with anything new.

    ``suffixes`` has entries, and ``level``: 0 for those of the index, 1 for the new.
    Matches have ``from`` and ``to``; entries to add have ``content``.
    """
    id_type = suffixes.schema["id"].dataType
    schema = _fields(
        id_type, T.StructField("content", T.BinaryType()), T.StructField("from", T.LongType()), T.StructField("to", T.LongType())
    )
    order = ["seed", "level", F.isnull("id"), "id", "h", "start"]
    sorted_ = suffixes.repartition("seed").sortWithinPartitions(*order)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            yield from _scan_groups(table, width, schema.names)

    return sorted_.mapInArrow(scan, schema)


def _scan_groups(table: pa.Table, width: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    batch = table.to_batches()[0]
    content = batch.column("content")
    offsets = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + len(content) + 1].astype(np.int64)
    lengths = np.diff(offsets)
    runs = byte_runs(content.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]])
    counts = lengths - width + 1
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (offsets[:-1] - offsets[0])[row] + place
    path = runs.between(at, at + width)
    # Rows are in order of place, so the first of equal windows is the earliest.
    first = np.zeros(len(path), bool)
    _, earliest, inverse = np.unique(path, return_index=True, return_inverse=True)
    first[earliest] = True
    start = batch.column("start").to_numpy()[row] + place
    # A repeated row's window is at the very place of the earliest: no match with itself.
    ids, h = batch.column("id"), batch.column("h").to_numpy()
    origin = earliest[inverse]
    same = (h[row[origin]] == h[row]) & (start[origin] == start) & (row[origin] != row)
    if same.any():
        a, b = ids.take(pa.array(row[origin][same])), ids.take(pa.array(row[same]))
        equal = [x.as_py() == y.as_py() for x, y in zip(a, b)]
        same[np.flatnonzero(same)[~np.array(equal)]] = False
    new = batch.column("level").to_numpy()[row] == 1
    begin, end = leaf_runs(~first & ~same & new, row)
    picked = pa.array(row[begin])
    none = pa.nulls(len(begin), pa.binary())
    yield pa.RecordBatch.from_arrays(
        [batch.column("seed").take(picked), ids.take(picked), batch.column("h").take(picked),
         batch.column("start").take(picked), none, pa.array(start[begin]), pa.array(start[end] + width)],
        names,
    )
    # New windows of a row are kept from the first to the last of them.
    fresh = np.flatnonzero(first & new)
    if not len(fresh):
        return
    rows, head = np.unique(row[fresh], return_index=True)
    tail = np.append(head[1:], len(fresh)) - 1
    low, high = place[fresh[head]], place[fresh[tail]] + width
    picked = pa.array(rows)
    kept = [c[a:b] for c, a, b in zip(content.take(picked).to_pylist(), low.tolist(), high.tolist())]
    nothing = pa.nulls(len(rows), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [batch.column("seed").take(picked), ids.take(picked), batch.column("h").take(picked),
         pa.array(batch.column("start").to_numpy()[rows] + low), pa.array(kept, pa.binary()), nothing, nothing],
        names,
    )


class IndexFamily:
    """Levels of stored suffix tables; sizes are counted in batches."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, entries: DataFrame, last: bool = False) -> DataFrame:
        """Matches of a batch (``id, h, from, to``) with all before it and inside it.

        The batch joins the index unless it is the ``last``.
        """
        old = [level.withColumn("level", F.lit(0)) for _, level in self.levels]
        scanned = reduce(DataFrame.unionByName, old, entries.withColumn("level", F.lit(1)))
        found = store(_merge_scan(scanned, self.width))
        if not last:
            self.levels.append((1, found.where("content IS NOT NULL").drop("from", "to")))
            while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
                size, newer = self.levels.pop()
                _, older = self.levels.pop()
                merged = older.unionByName(newer).repartition("seed").sortWithinPartitions("seed")
                self.levels.append((2 * size, store(merged)))
        return found.where("content IS NULL").select("id", "h", "from", "to")


def repeated_spans(
    docs: DataFrame, *, width: int = WIDTH, seed_bytes: int = SEED_BYTES, batches: int = BATCHES,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``id, h, spans``: byte ranges of each document that an earlier place has too.

    ``docs`` has ``id`` (a number), ``h`` and ``text``.
    """
    texts = docs.withColumn("start", F.lit(0).cast("long")).withColumn("key", F.xxhash64("id", "h"))
    grouped, spans, copied = [], [], []
    while True:
        hashes = lambda text, seed=seed_bytes: byte_runs(text).windows(seed)
        again = repeated_seeds(seed_counts(texts, hashes, width - seed_bytes + 1))
        wanted = again.select("key", F.transform("seeds", lambda s: s["seed"]).alias("seeds"), F.transform(
            F.filter("seeds", lambda s: s["n"] > group_rows), lambda s: s["seed"]
        ).alias("frequent"))
        cut = store(_entries(texts.join(wanted, "key"), width, seed_bytes))
        spans.append(cut.where("from IS NOT NULL").select("id", "h", "from", "to"))
        entries = cut.where("from IS NULL").drop("from", "to")
        grouped.append(entries.where("NOT frequent").drop("frequent"))
        if largest(again) <= group_rows:
            break
        if seed_bytes == width:
            copied.append(_equal_windows(entries.where("frequent")))
            break
        # Of equal entries the earliest stands for all; windows of the others only match it.
        contents, copies = _distinct(entries.where("frequent"))
        copied.append(copies)
        texts = contents.select("place.id", "place.h", "place.start", F.col("content").alias("text"), F.xxhash64("content").alias("key"))
        seed_bytes = width - (width - seed_bytes) // 5
    entries = reduce(DataFrame.unionByName, grouped)

    cuts = [i / batches for i in range(1, batches)]
    borders = (docs.agg(F.percentile_approx("id", cuts).alias("b")).first()["b"] or []) if cuts else []
    borders = sorted(set(borders))
    family = IndexFamily(width)
    for i, (low, high) in enumerate(zip([None, *borders], [*borders, None])):
        after = F.lit(True) if low is None else F.isnull("id") | (F.col("id") > low)
        inside = after if high is None else after & F.coalesce(F.col("id") <= high, F.lit(False))
        spans.append(family.add(entries.where(inside), last=i == len(borders)))

    every = reduce(DataFrame.unionByName, spans)
    found = every.groupBy("id", "h").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    if not copied:
        return found
    rows = reduce(DataFrame.unionByName, copied, found)
    return rows.groupBy("id", "h").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _places(entries: DataFrame) -> DataFrame:
    """Entries with their ``place``, in the order of which one is the earliest."""
    place = F.struct(F.isnull("id").alias("last"), "id", "h", "start", F.length("content").cast("long").alias("length"))
    return entries.select("seed", "content", place.alias("place"))


def _of_documents(places: DataFrame, name: str) -> DataFrame:
    """``id, h`` and all places of the document: starts and lengths, in one number each."""
    code = F.shiftleft("place.start", 32) + F.col("place.length")
    return places.groupBy("place.id", "place.h").agg(F.collect_set(code).alias(name))


def _later(places: DataFrame, earliest: DataFrame) -> DataFrame:
    """``id, h, spans`` of the places that are not among the ``earliest``, a row per document.

    No two entries of a document start together, so the place tells an entry.
    """
    first = _of_documents(earliest, "first").withColumnsRenamed({"id": "__i", "h": "__h"})
    same = F.col("id").eqNullSafe(F.col("__i")) & (F.col("h") == F.col("__h"))
    met = _of_documents(places, "all").join(first, same, "left")
    later = F.when(F.isnull("first"), F.col("all")).otherwise(F.array_except("all", "first"))

    def span(code):
        start = F.shiftright(code, 32)
        return F.struct(start.alias("from"), (start + code.bitwiseAND(F.lit((1 << 32) - 1))).alias("to"))

    return met.select("id", "h", F.transform(later, span).alias("spans")).where(F.size("spans") > 0)


def _distinct(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct contents with their earliest ``place``, and the spans of all their copies."""
    placed = _places(entries)
    contents = store(placed.groupBy("content").agg(F.min("place").alias("place")))
    return contents, _later(placed, contents)


def _equal_windows(entries: DataFrame) -> DataFrame:
    """Matches among entries whose seed is the whole window, so that they have one each: all but the earliest."""
    placed = _places(entries)
    return _later(placed, store(placed.groupBy("seed").agg(F.min("place").alias("place"))))


def remove_repeats(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH,
    seed_bytes: int = SEED_BYTES, batches: int = BATCHES, group_rows: int = GROUP_ROWS,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_bytes`` (binary)."""
    names = ("n_bytes", "n_removed", "n_spans", "kept_bytes")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    key = row_key(id_column, text_column)
    rows = docs.select(
        F.struct(*[column(c).alias(c) for c in kept]).alias(ROW), key["id"].alias("id"), key["h"].alias("h"),
        column(text_column).cast("string").alias("text"),
    )
    spans = store(repeated_spans(
        rows.select("id", "h", "text"), width=width, seed_bytes=seed_bytes, batches=batches, group_rows=group_rows
    ).withColumnsRenamed({"id": "__i", "h": "__h"}))
    same = F.col("id").eqNullSafe(F.col("__i")) & (F.col("h") == F.col("__h"))
    met = rows.join(spans, same, "left").select(ROW, "text", "spans")
    results = T.StructType([
        met.schema[ROW], *[T.StructField(n, T.LongType()) for n in names[:3]], T.StructField(names[3], T.BinaryType()),
    ])

    def apply(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches_):
            out = [[], [], [], []]
            for text, own in zip(texts_of(batch.column("text")), batch.column("spans").to_pylist()):
                gone = covered(own, len(text))
                out[0].append(len(text))
                out[1].append(int(gone.sum()))
                out[2].append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                out[3].append(np.frombuffer(text, np.uint8)[~gone].tobytes() if own else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.binary())], results.names
            )

    found = met.mapInArrow(apply, results)
    return found.select(*[F.col(ROW).getField(c).alias(c) for c in kept], *names)
