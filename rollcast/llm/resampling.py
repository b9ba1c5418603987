"""Importance resampling towards a target distribution, over hashed word n-grams.

Texts are lower-cased (A-Z) and cut into words, joined by one space.  A document is
scanned once: the CRC-32 after each of its words is stored (``running_crcs``), four bytes
a word, next to the words' lengths.  From then on no text is read.  CRC-32 is linear over
GF(2): with ``s`` the CRC of a prefix and ``p`` that of a longer one, the CRC of the ``k``
bytes between is ``p`` xor (``s`` moved on by ``k`` zero bytes), and moving on by ``k``
bytes is a product of fixed 32 x 32 bit matrices, one per binary digit of ``k``.  So every
n-gram of any order comes from two stored numbers, whole arrays at a time.

A bucket is an n-gram's CRC modulo ``buckets``.  Tasks count buckets in one array each, so
what is shuffled is at most ``buckets`` rows a task.  Bucket counts of all documents and of
the target texts give a gain per bucket; their tables have ``buckets`` rows, whatever the
corpus.  A document's weight is the sum of its n-grams' gains; with a Gumbel number made
from its id added, the highest scores are a draw without replacement by weight.

The draw is a share of all rows, so it is ranked by a range-partitioned sort: no task and
no driver holds it.  A quantile sketch leaves out rows that cannot be drawn; if it should
leave too few, all rows are sorted.

Defined results: a null or empty text, or one without words, has no features and weight 0;
a null id counts as an empty one in the random number, and comes last among equal scores;
repeated rows are rows of their own with equal scores, in any order; an empty target gives
every bucket the gain of no occurrences; an empty table gives an empty result; other
columns pass through, clashing ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcast.llm.common import ROW, annotate, column, small_batches
from rollcast.llm.decontamination import words_of
from rollcast.sources.scratch import store

ORDERS = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024

# Rank error of the sketch that sets the lowest score worth sorting.
SKETCH = 10_000

PREFIXES = T.StructType([T.StructField("__crcs", T.BinaryType()), T.StructField("__lengths", T.BinaryType())])
NAMES = ("n_words", "n_features", "weight", "score", "rank")

# Row number of a sorted partition: the bits below Spark's partition number.
_PART_BITS = 33


def _byte_step() -> np.ndarray:
    """What one zero byte does to each value of a CRC's low byte (reflected CRC-32)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> np.uint32(1)), step >> np.uint32(1))
    return step


def _apply(matrix: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """A 32 x 32 bit matrix, as four tables by byte, times many CRCs."""
    parts = crcs.view(np.uint8).reshape(-1, 4) if crcs.flags.c_contiguous else np.ascontiguousarray(crcs).view(np.uint8).reshape(-1, 4)
    return matrix[0][parts[:, 0]] ^ matrix[1][parts[:, 1]] ^ matrix[2][parts[:, 2]] ^ matrix[3][parts[:, 3]]


def _shifts(digits: int = 32) -> list[np.ndarray]:
    """Matrices that move a CRC on by 1, 2, 4, ... zero bytes."""
    value = np.arange(256, dtype=np.uint32)
    step = _byte_step()
    matrix = np.stack([step, *[value << np.uint32(8 * (j - 1)) for j in (1, 2, 3)]])
    found = [matrix]
    for _ in range(digits - 1):
        found.append(np.stack([_apply(found[-1], row) for row in found[-1]]))
    return found


_STEP, _SHIFTS = _byte_step(), _shifts()


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs moved on by so many zero bytes each."""
    out = crcs.copy()
    most, digit = int(lengths.max(initial=0)), 0
    while most >> digit:
        at = np.flatnonzero(lengths >> digit & 1)
        out[at] = _apply(_SHIFTS[digit], out[at])
        digit += 1
    return out


def running_crcs(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """CRC of the normalised text up to each word's end, and the words' lengths in bytes."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    spaced = [words[0], *[b" " + w for w in words[1:]]]
    crcs = accumulate(spaced, lambda crc, word: crc32(word, crc), initial=0)
    next(crcs)
    return np.fromiter(crcs, np.uint32, len(words)), np.fromiter(map(len, words), np.uint32, len(words))


def gram_crcs(crcs: np.ndarray, lengths: np.ndarray, order: int) -> np.ndarray:
    """CRCs of all runs of ``order`` words, from those of the prefixes."""
    count = max(0, len(crcs) - order + 1)
    if not count:
        return np.zeros(0, np.uint32)
    # The CRC after the space that follows a word: one step on from the word's end.
    inverted = ~crcs
    spaced = ~(_STEP[(inverted ^ np.uint32(0x20)) & np.uint32(255)] ^ (inverted >> np.uint32(8)))
    before = np.concatenate((np.zeros(1, np.uint32), spaced[:-1]))[:count]
    ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    size = ends[order:] - ends[:count] + (order - 1)
    return crcs[order - 1 :] ^ shifted(before, size)


def _prefixes(docs: DataFrame, text_column: str) -> DataFrame:
    """Running CRCs and word lengths instead of the text."""

    def task():
        def work(texts: Iterator[bytes]) -> dict:
            both = [running_crcs(t) for t in texts]
            return {name: pa.array([x[i].tobytes() for x in both], pa.binary()) for i, name in enumerate(PREFIXES.names)}

        return work

    return annotate(docs, text_column, PREFIXES, task).drop(text_column)


def _arrays(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return tuple(
        [np.frombuffer(v.as_buffer(), np.uint32) for v in batch.column(name)] for name in PREFIXES.names
    )


def bucket_counts(prefixes: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how often n-grams of all documents fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in small_batches(batches):
            for crcs, lengths in zip(*_arrays(batch)):
                for order in range(1, orders + 1):
                    total += np.bincount(gram_crcs(crcs, lengths, order) % np.uint32(buckets), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], ["bucket", "n"])

    counted = prefixes.select(*PREFIXES.names).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame, buckets: int) -> np.ndarray:
    """At most ``buckets`` rows reach the driver."""
    table = counts.toArrow()
    found = np.zeros(buckets, np.int64)
    found[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return found


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares of target and corpus, in thousandths, by bucket."""
    buckets = len(corpus)
    s, t = corpus.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weigh(prefixes: DataFrame, gains: np.ndarray, orders: int) -> DataFrame:
    """Replace the prefixes by ``n_words``, ``n_features`` and ``weight``."""
    shared = prefixes.sparkSession.sparkContext.broadcast(gains)
    kept = [f for f in prefixes.schema if f.name not in PREFIXES.names]
    schema = T.StructType([*kept, *[T.StructField(n, T.LongType()) for n in NAMES[:3]]])
    rest = [f.name for f in kept]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in small_batches(batches):
            out = [[], [], []]
            for crcs, lengths in zip(*_arrays(batch)):
                grams = [gram_crcs(crcs, lengths, order) % np.uint32(len(gain)) for order in range(1, orders + 1)]
                out[0].append(len(crcs))
                out[1].append(sum(map(len, grams)))
                out[2].append(sum(int(gain[g].sum()) for g in grams))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in rest], *[pa.array(x, pa.int64()) for x in out]], schema.names
            )

    return prefixes.mapInArrow(weigh, schema)


def _gumbel(id_: Column, seed: int) -> Column:
    """A random number fixed by seed and id, in thousandths."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def _ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``rank``, from 1, over all rows in this order, by a range-partitioned sort."""
    at = store(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    )
    part = F.shiftright("__at", _PART_BITS)
    # One row per partition of the sort.
    sizes = at.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__start"))
    place = F.col("__at").bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    return (
        at.withColumn("__part", part).join(starts, "__part")
        .withColumn("rank", F.col("__start") + place + 1).drop("__part", "__start", "__at")
    )


def resample(
    docs: DataFrame, target: DataFrame, *, text_column: str = "text", id_column: str = "doc_id",
    target_text_column: str = "text", orders: int = ORDERS, buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``n_words, n_features, weight, score`` and ``rank`` (null: not drawn) to every row.

    Of the rows with ``least_words`` words or more, ``percent`` in a hundred are drawn.
    ``keep`` names the columns to pass through (default: all).
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in NAMES]
    rows = docs.select(
        F.struct(*[column(c).alias(c) for c in kept]).alias(ROW + "_kept"), column(id_column).alias("__id"),
        column(text_column).cast("string").alias("__body"),
    )
    prefixes = store(_prefixes(rows, "__body"))
    wanted = _prefixes(target.select(column(target_text_column).cast("string").alias("__body")), "__body")
    gains = gains_of(*[_dense(bucket_counts(p, orders, buckets), buckets) for p in (prefixes, wanted)])
    weighed = _weigh(prefixes, gains, orders)
    scored = store(
        weighed.withColumn("score", F.col("weight") + _gumbel(F.col("__id"), seed))
        .withColumn("__tie", F.monotonically_increasing_id())
    )

    eligible = F.col("n_words") >= least_words
    # The sketch's rank is off by at most n / SKETCH; twice that is put on top of the share.
    low = max(0.0, 1 - percent / 100 - 2 / SKETCH)
    found = scored.where(eligible).agg(
        F.count("*").alias("n"), F.percentile_approx("score", low, SKETCH).alias("low")
    ).first()
    drawn = percent * found["n"] // 100
    hopeful = eligible
    if found["low"] is not None:
        above = eligible & (F.col("score") >= found["low"])
        if scored.where(above).count() >= drawn:
            hopeful = above
    order = [F.col("score").desc(), F.col("__id").asc_nulls_last(), F.col("__tie").asc()]
    ranked = _ranked(scored.where(hopeful), order)
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    rest = scored.where(~hopeful).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", rank).unionByName(rest).select(
        *[F.col(ROW + "_kept").getField(c).alias(c) for c in kept], *NAMES
    )
