"""Near-duplicates by SimHash, found through a segment-popcount embedding.

A fingerprint's 64 bits are cut into 32 segments of two.  The counts of set bits in the
segments are its embedding; the Manhattan distance of two embeddings is at most the
Hamming distance of the fingerprints.  Written in unary, an embedding is again 64 bits
(``counts``), and that distance is the number of differing bits.

Range join: the segments form ``BLOCKS`` blocks.  If the distance is at most three, all
but three blocks agree, so each choice of blocks that must agree gives a grid whose cell
is the counts in those blocks; near fingerprints share a cell of some grid.  Candidates of
a cell are pruned by the Manhattan distance, then verified on the fingerprints.

Exact copies share a fingerprint and are merged before the join.  A cell gives one link
per member at most (to the smallest of its group inside the cell), never all pairs.  A
cell with more than ``CELL_ROWS`` fingerprints is cut into parts, and every pair of parts
is a task's group of its own, so no group grows with the table.  Links are turned into
components by alternating large and small stars over stored tables.

Defined results: null and empty texts and those without words have fingerprint zero,
which links like others; repeated rows are exact copies; a null id is ignored as a
component's smallest id, which is null if all are; an empty table gives an empty
result; other columns pass through, clashing ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcast.llm.common import annotate, column
from rollcast.sources.scratch import store

WORDS = 3
SEED = 42
DISTANCE = 3
BLOCKS = 6
CELL_ROWS = 2000

FINGERPRINT = T.StructType([T.StructField("__fingerprint", T.LongType())])
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

_LOW = 0x5555555555555555


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """Hashes of a text's runs of words, in their order, repeats included."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, "<u8")
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]).tolist()
    starts = [0, *ends[:-1]]
    spans = zip(starts, ends[words - 1 :]) if len(tokens) >= words else [(0, len(line) + 1)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a : b - 1], SEED) for a, b in spans], "<u8")


def fingerprint_of(hashes: np.ndarray) -> int:
    """The unsigned 64-bit SimHash of shingles given by their hashes; zero if there are none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The unsigned 64-bit SimHash of a text."""
    return fingerprint_of(shingle_hashes(text, words))


def _counts(x: Column) -> Column:
    """Set bits of every two-bit segment, in unary: 00, 01 or 11."""
    other = F.shiftrightunsigned(x, 1)
    low = F.lit(_LOW)
    return x.bitwiseOR(other).bitwiseAND(low).bitwiseOR(F.shiftleft(x.bitwiseAND(other).bitwiseAND(low), 1))


def _grids() -> list[int]:
    """For each choice of blocks that must agree, the mask of their bits (signed)."""
    edges = np.linspace(0, 32, BLOCKS + 1).round().astype(int) * 2
    masks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:])]
    grids = [sum(c) for c in combinations(masks, BLOCKS - DISTANCE)]
    return [g - (1 << 64) if g >> 63 else g for g in grids]


def embedding(prints: np.ndarray) -> np.ndarray:
    """What ``_counts`` computes, for an array of unsigned fingerprints."""
    low = np.uint64(_LOW)
    other = prints >> np.uint64(1)
    return ((prints | other) & low) | ((prints & other & low) << np.uint64(1))


def near(prints: np.ndarray, counts: np.ndarray, one: int, among: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Those of ``among`` that are near one fingerprint: first by Manhattan distance."""
    among = among[np.bitwise_count(counts[among] ^ counts[one]) <= distance]
    return among[np.bitwise_count(prints[among] ^ prints[one]) <= distance]


def _group_links(prints: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Links from every member of a group that is near another to the first of its kind."""
    left, links = np.arange(len(prints)), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            found = near(prints, counts, front.pop(), left)
            if len(found):
                left = np.setdiff1d(left, found, assume_unique=True)
                front += found.tolist()
                links += [(f, root) for f in found.tolist()]
    return links


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; a group may go on in the next batch."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        group = np.stack([table[c].to_numpy() for c in ("grid", "cell", "part", "other")])
        changes = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
        if not len(changes):
            held = table
            continue
        held = table.slice(int(changes[-1]))
        yield _links_of(table, [0, *changes.tolist()])
    if held is not None:
        yield _links_of(held, [0, held.num_rows])


def _links_of(table: pa.Table, bounds: list[int]) -> pa.RecordBatch:
    prints = table["print"].to_numpy().view(np.uint64)
    counts = table["counts"].to_numpy().view(np.uint64)
    links = []
    for a, b in zip(bounds, bounds[1:]):
        links += [(a + i, a + j) for i, j in _group_links(prints[a:b], counts[a:b])]
    pairs = np.array(links, np.int64).reshape(-1, 2)
    signed = prints.view(np.int64)
    high, low = signed[pairs[:, 0]], signed[pairs[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(high, low)), pa.array(np.minimum(high, low))], ["a", "b"])


def link(prints: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links ``a > b`` that connect all fingerprints within the distance of each other.

    ``prints`` has distinct fingerprints, as ``print``.
    """
    coded = prints.select("print", _counts(F.col("print")).alias("counts"))
    grids = F.array(*[
        F.struct(F.lit(i).alias("grid"), F.col("counts").bitwiseAND(F.lit(g)).alias("cell"))
        for i, g in enumerate(_grids())
    ])
    cells = coded.withColumn("at", F.explode(grids)).select("at.grid", "at.cell", "print", "counts")
    crowded = cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / cell_rows).cast("int")
    own = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    met = (
        cells.join(crowded, ["grid", "cell"])
        .withColumn("parts", parts)
        .withColumn("own", own)
        # A part meets each other part once, and itself where there is no other.
        .withColumn("with", F.explode(F.expr(
            "CASE WHEN parts = 1 THEN array(0) ELSE filter(sequence(0, parts - 1), i -> i <> own) END"
        )))
        .withColumn("part", F.least("own", "with"))
        .withColumn("other", F.greatest("own", "with"))
    )
    keys = ["grid", "cell", "part", "other"]
    grouped = met.select(*keys, "print", "counts").repartition(*keys).sortWithinPartitions(*keys)
    return grouped.mapInArrow(_link, LINKS).distinct()


def components(links: DataFrame) -> DataFrame:
    """The smallest member of each linked one's component: ``a`` (not itself smallest), ``b``."""
    stars, before = store(links), None
    while True:
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return stars
        before = state
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("b"))
        rest = large.join(least.withColumnRenamed("b", "m"), "a").where("b <> m")
        small = least.unionByName(rest.select(F.col("b").alias("a"), F.col("m").alias("b")))
        stars = store(small.distinct())


def near_duplicates(
    docs: DataFrame, *, text_column: str = "text", id_column: str = "doc_id", words: int = WORDS,
    cell_rows: int = CELL_ROWS, keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``fingerprint`` (16 hex digits), ``component_id`` and ``first`` to every row.

    ``first`` marks one row of each component: one with the component's smallest id.
    ``keep`` limits the columns that pass through (and are stored on the way).
    """
    names = ("fingerprint", "component_id", "first")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]

    def task():
        def work(texts: Iterator[bytes]) -> dict:
            found = np.array([fingerprint(t, words) for t in texts], np.uint64)
            return {"__fingerprint": pa.array(found.view(np.int64))}

        return work

    rows = docs.select(
        F.struct(*[column(c).alias(c) for c in kept]).alias("__kept"), column(id_column).alias("__id"),
        column(text_column).cast("string").alias("__text_of"),
    )
    marked = annotate(rows, "__text_of", FINGERPRINT, task).drop("__text_of")
    # Stored, so that fingerprints are made once and row numbers stay.
    marked = store(marked.withColumn("__row_number", F.monotonically_increasing_id()))

    earliest = F.struct(F.isnull("__id").alias("last"), F.col("__id").alias("id"), F.col("__row_number").alias("row"))
    prints = store(
        marked.groupBy(F.col("__fingerprint").alias("print")).agg(F.min(earliest).alias("earliest"))
    )
    labels = components(link(prints.select("print"), cell_rows))
    rooted = prints.join(labels, F.col("print") == F.col("a"), "left").select(
        "print", "earliest", F.coalesce("b", "print").alias("root")
    )
    best = rooted.groupBy("root").agg(F.min("earliest").alias("best"))
    classes = store(rooted.join(best, "root").select("print", "best"))
    return marked.join(classes, F.col("__fingerprint") == F.col("print")).select(
        *[F.col("__kept").getField(c).alias(c) for c in kept],
        F.lower(F.lpad(F.hex("__fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("best.id").alias("component_id"),
        (F.col("best.row") == F.col("__row_number")).alias("first"),
    )
