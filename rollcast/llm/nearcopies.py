"""Near copies by SimHash, verified by the Jaccard similarity of word shingles.

Texts with the same shingles are merged first.  A text's SimHash is that of its distinct
shingles.  Candidates are found by fingerprint: equal ones, and those that the range join
of ``simhash`` links (segment popcounts, Manhattan distance, at most three bits).  A pair
at the wanted similarity differs in more bits than blocks can bound: in 10 on average at
0.8, and in more than ``most_different``, which is 30, with probability 7e-8 at most.  So
the same comparison, out to that distance, is made inside cells of minimum hashes, too:
``BANDS`` cells, each of ``BAND`` hashes; there a pair must also have ``least_equal`` or
more equal bytes of all minimum hashes.  A pair at 0.8 shares no cell with probability
5e-8, and falls short of ``least_equal`` with 1e-7; closer pairs with less.

The components of the candidates' links are groups.  Every text goes to its one group,
where the similarity is computed exactly from the shingles; only pairs that reach it are
linked.

Links go to the first of a kind, never all pairs.  A cell or group with more than
``cell_rows`` members (or ``GROUP_BYTES`` of shingles) is cut into parts, and every pair of
parts is a task's group of its own, so no group grows with the table.

Defined results: null and empty texts and those without words are copies of each other; a
text of fewer than ``words`` words is one shingle; a null id is ignored as a component's
smallest id, which is null if all are; an empty table gives an empty result; other columns
pass through, clashing ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcast.llm.common import annotate, column
from rollcast.llm.simhash import CELL_ROWS, LINKS, SEED, components, embedding, fingerprint_of, link, near, shingle_hashes
from rollcast.sources.scratch import store

WORDS = 5
SIMILARITY = 0.8
BANDS, BAND = 32, 4
HASHES = BANDS * BAND
GROUP_BYTES = 1 << 25

SKETCH = T.StructType([
    T.StructField("__set", T.LongType()), T.StructField("__bands", T.ArrayType(T.LongType())),
    T.StructField("__fingerprint", T.LongType()), T.StructField("__sketch", T.BinaryType()),
])
SHINGLES = T.StructType([T.StructField("load", T.BinaryType())])
KEYS = ["grid", "cell", "part", "other"]

_SALTS = np.frombuffer(b"".join(xxhash.xxh64_digest(str(i), SEED) for i in range(HASHES)), "<u8").reshape(-1, 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def least_equal(similarity: float) -> int:
    """Equal hashes that a pair of this similarity has, but for one in 1e7."""
    return max(1, int(HASHES * similarity - 5.6 * (HASHES * similarity * (1 - similarity)) ** 0.5))


def most_different(similarity: float) -> int:
    """Bits that the SimHashes of such a pair differ in at most, but for one in 1e7.

    A bit differs with the angle between the sets over pi, in sets of few shingles with up
    to a quarter more (3/16 for four of five at 0.8).
    """
    chance = min(0.5, 1.25 * math.acos(2 * similarity / (1 + similarity)) / math.pi)
    return min(64, int(64 * chance + 6 * (64 * chance * (1 - chance)) ** 0.5))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted hashes of a text's runs of words."""
    return np.unique(shingle_hashes(text, words))


def minimum_hashes(hashes: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, "<u8")
    for at in range(0, len(hashes), 4096):
        mixed = (hashes[at : at + 4096] ^ _SALTS) * _ODD
        mixed ^= mixed >> np.uint64(29)
        mixed *= _SALTS | np.uint64(1)
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, mixed.min(axis=1))
    return least


def _sketches(words: int):
    def task():
        def work(texts: Iterator[bytes]) -> dict:
            sets, bands, prints, sketches = [], [], [], []
            for text in texts:
                hashes = shingles(text, words)
                least = minimum_hashes(hashes)
                sets.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                cells = [xxhash.xxh64_intdigest(b.tobytes()) for b in least.reshape(BANDS, BAND)] if len(hashes) else []
                bands.append(np.array(cells, "<u8").view("<i8").tolist())
                prints.append(fingerprint_of(hashes))
                # The fingerprint goes ahead of the minimum hashes.
                sketches.append(prints[-1].to_bytes(8, "little") + least.astype(np.uint8).tobytes())
            return {
                "__set": pa.array(np.array(sets, np.uint64).view(np.int64)),
                "__bands": pa.array(bands, pa.list_(pa.int64())),
                "__fingerprint": pa.array(np.array(prints, np.uint64).view(np.int64)),
                "__sketch": pa.array(sketches, pa.binary()),
            }

        return work

    return task


def _spanning(n: int, close: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links from every member that is close to another to the first of its kind."""
    left, links = np.arange(n), []
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        front = [root]
        while front and len(left):
            found = close(front.pop(), left)
            if len(found):
                left = np.setdiff1d(left, found, assume_unique=True)
                front += found.tolist()
                links += [(f, root) for f in found.tolist()]
    return links


def _alike(loads: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """Links of a cell's members by their fingerprints, then by their minimum hashes."""
    rows = np.frombuffer(b"".join(loads), np.uint8).reshape(-1, 8 + HASHES)
    prints, sketches = rows[:, :8].copy().view("<u8")[:, 0], rows[:, 8:]
    counts, distance, least = embedding(prints), most_different(similarity), least_equal(similarity)

    def close(one: int, among: np.ndarray) -> np.ndarray:
        among = near(prints, counts, one, among, distance)
        return among[(sketches[among] == sketches[one]).sum(axis=1) >= least]

    return _spanning(len(loads), close)


def _similar(loads: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """Links of a group's members by the exact similarity of their shingles."""
    sizes = np.array([len(x) // 8 for x in loads])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    values, codes = np.unique(np.frombuffer(b"".join(loads), "<u8"), return_inverse=True)

    def close(one: int, among: np.ndarray) -> np.ndarray:
        has = np.zeros(len(values), np.int32)
        has[codes[starts[one] : starts[one] + sizes[one]]] = 1
        both = np.add.reduceat(has[codes], starts)[among]
        return among[both >= similarity * (sizes[among] + sizes[one] - both) - 1e-9]

    return _spanning(len(loads), close)


def _links(members: DataFrame, cell_rows: int, similarity: float, linked: Callable) -> DataFrame:
    """Links ``a > b`` inside the cells of ``grid, cell, print, load``."""
    crowded = members.groupBy("grid", "cell").agg(F.count("*").alias("n"), F.sum(F.length("load")).alias("size")).where("n > 1")
    parts = F.ceil(F.greatest(F.col("n") / cell_rows, F.col("size") / GROUP_BYTES)).cast("int")
    met = (
        members.join(crowded.select("grid", "cell", parts.alias("parts")), ["grid", "cell"])
        .withColumn("own", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
        # A part meets each other part once, and itself where there is no other.
        .withColumn("with", F.explode(F.expr(
            "CASE WHEN parts = 1 THEN array(0) ELSE filter(sequence(0, parts - 1), i -> i <> own) END"
        )))
        .withColumn("part", F.least("own", "with"))
        .withColumn("other", F.greatest("own", "with"))
    )

    def links_of(table: pa.Table, bounds: list[int]) -> pa.RecordBatch:
        prints, pairs = table["print"].to_numpy(), []
        for a, b in zip(bounds, bounds[1:]):
            if b - a > 1:
                pairs += [(a + i, a + j) for i, j in linked(table["load"].slice(a, b - a).to_pylist(), similarity)]
        at = np.array(pairs, np.int64).reshape(-1, 2)
        one, two = prints[at[:, 0]], prints[at[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(one, two)), pa.array(np.minimum(one, two))], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group may go on in the next batch."""
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            group = np.stack([table[c].to_numpy() for c in KEYS])
            changes = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
            held = table.slice(int(changes[-1])) if len(changes) else table
            if len(changes):
                yield links_of(table, [0, *changes.tolist()])
        if held is not None:
            yield links_of(held, [0, held.num_rows])

    grouped = met.select(*KEYS, "print", "load").repartition(*KEYS).sortWithinPartitions(*KEYS)
    return grouped.mapInArrow(work, LINKS).distinct()


def fingerprint_links(prints: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links ``a > b`` between texts whose fingerprints are equal or linked by ``simhash``.

    ``prints`` has a text's ``print`` and its ``fingerprint``.
    """
    least = store(prints.groupBy("fingerprint").agg(F.min("print").alias("least")))
    equal = prints.join(least, "fingerprint").where("print > least").select(F.col("print").alias("a"), F.col("least").alias("b"))
    linked = link(least.select(F.col("fingerprint").alias("print")), cell_rows)
    one = least.select(F.col("fingerprint").alias("a"), F.col("least").alias("one"))
    two = least.select(F.col("fingerprint").alias("b"), F.col("least").alias("two"))
    different = linked.join(one, "a").join(two, "b").select(F.greatest("one", "two").alias("a"), F.least("one", "two").alias("b"))
    return equal.unionByName(different)


def near_copies(
    docs: DataFrame, *, text_column: str = "text", id_column: str = "doc_id", words: int = WORDS,
    similarity: float = SIMILARITY, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Add ``component_id`` and ``first`` to every row.

    ``first`` marks one row of each component: one with the component's smallest id.
    """
    names = ("component_id", "first")
    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(
        F.struct(*[column(c).alias(c) for c in kept]).alias("__kept"), column(id_column).alias("__id"),
        column(text_column).cast("string").alias("__text_of"),
    )
    # Stored, so that sketches are made once and row numbers stay.
    marked = annotate(rows, "__text_of", SKETCH, _sketches(words)).drop("__text_of")
    marked = store(marked.withColumn("__row_number", F.monotonically_increasing_id()))
    text: Column = F.col("__kept").getField(text_column).cast("string")

    earliest = F.struct(F.isnull("__id").alias("last"), F.col("__id").alias("id"), F.col("__row_number").alias("row"))
    prints = store(marked.groupBy(F.col("__set").alias("print")).agg(F.min(earliest).alias("earliest")))
    chosen = marked.join(prints.select(F.col("earliest.row").alias("__row_number")), "__row_number", "left_semi")
    cells = chosen.select(F.col("__set").alias("print"), F.posexplode("__bands").alias("grid", "cell"))
    # Only members of shared cells get their fingerprints and minimum hashes.
    shared = cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    loads = chosen.select(F.col("__set").alias("print"), F.col("__sketch").alias("load"))
    cells = store(cells.join(shared, ["grid", "cell"], "left_semi").join(loads, "print"))
    # Texts without words have no cells, and only copies.
    worded = chosen.where(F.size("__bands") > 0).select(F.col("__set").alias("print"), F.col("__fingerprint").alias("fingerprint"))
    # Stored one after the other, so that only one of them holds shuffle files.
    close = store(fingerprint_links(worded, cell_rows)).unionByName(store(_links(cells, cell_rows, similarity, _alike)))
    candidates = components(close.distinct())

    # The candidates' shingles, each in its one group.
    members = store(candidates.select(F.col("a").alias("print"), F.col("b").alias("cell")).unionByName(
        candidates.select(F.col("b").alias("print"), F.col("b").alias("cell")).distinct()
    ))
    of_member = members.join(prints, "print").select("print", "cell", F.col("earliest.row").alias("__row_number"))
    texts = of_member.join(marked.select("__row_number", text.alias("__text_of")), "__row_number").select("print", "cell", "__text_of")

    def task():
        return lambda found: {"load": pa.array([shingles(t, words).tobytes() for t in found], pa.binary())}

    loaded = store(annotate(texts, "__text_of", SHINGLES, task).select(F.lit(0).alias("grid"), "cell", "print", "load"))
    labels = components(_links(loaded, cell_rows, similarity, _similar))

    rooted = prints.join(labels, F.col("print") == F.col("a"), "left").select(
        "print", "earliest", F.coalesce("b", "print").alias("root")
    )
    best = rooted.groupBy("root").agg(F.min("earliest").alias("best"))
    classes = store(rooted.join(best, "root").select("print", "best"))
    return marked.join(classes, F.col("__set") == F.col("print")).select(
        *[F.col("__kept").getField(c).alias(c) for c in kept],
        F.col("best.id").alias("component_id"),
        (F.col("best.row") == F.col("__row_number")).alias("first"),
    )
