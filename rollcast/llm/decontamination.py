"""Benchmark decontamination by one Aho-Corasick automaton.

Benchmark questions and answers are lower-cased (A-Z) and cut into words; every run of
``window`` words of an item, or a whole shorter item, is a pattern over word numbers.
One automaton holds all patterns.  Each document is scanned once; normalising keeps
byte positions, so hits map back to the original text.

The benchmark is what an executor keeps in memory.  Its size is checked: above
``block_words`` words its patterns are dealt to several automata, which scan one after
the other, each over a stored table of what the earlier ones found.

Defined results: null and empty texts have no words and no hits; an item without words
is never found; items sharing an id are one item; a null item_id hits but is not listed;
an empty benchmark or table gives no hits; repeated rows are judged alike; other columns
pass through, clashing ones are replaced.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcast.llm.common import annotate, column
from rollcast.sources.scratch import store

WINDOW = 13
BLOCK_WORDS = 200_000

# Bytes that separate words become spaces, A-Z become a-z; every byte keeps its place.
_SPACES = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
NORMAL = bytes(
    0x20 if b in _SPACES else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)
)

RESULTS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    # Code points, end exclusive, of runs of hit words.
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())
    ]))),
])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class _Automaton:
    """All patterns of the items over word numbers; what a pattern says is kept in arrays.

    A pattern's value is its place in ``lengths`` and in ``bounds``, which cuts ``holders``
    (places in ``ids``) into the items of each pattern.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.ids = [item for item, _ in items]
        self.numbers: dict[bytes, int] = {}
        self.scan = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        lengths, pattern, holder = array("H"), array("q"), array("q")
        for item, (_, text) in enumerate(items):
            numbers = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            for at in range(max(1, len(numbers) - window + 1) if numbers else 0):
                key = tuple(numbers[at : at + window])
                place = self.scan.get(key, -1)
                if place < 0:
                    place = len(lengths)
                    self.scan.add_word(key, place)
                    lengths.append(len(key))
                pattern.append(place)
                holder.append(item)
        self.scan.make_automaton()
        self.lengths = np.frombuffer(lengths, np.uint16) if lengths else np.zeros(0, np.uint16)
        order = np.argsort(np.array(pattern, np.int64), kind="stable")
        self.holders = np.array(holder, np.int32)[order]
        self.bounds = np.concatenate(([0], np.cumsum(np.bincount(np.array(pattern, np.int64), minlength=len(lengths)))))

    def items_of(self, places: set[int]) -> list[str]:
        found = {self.ids[k] for p in places for k in self.holders[self.bounds[p] : self.bounds[p + 1]].tolist()}
        return sorted(x for x in found if x is not None)


def _word_starts(normal: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last byte of every word."""
    inside = np.zeros(len(normal) + 2, np.int8)
    inside[1:-1] = np.frombuffer(normal, np.uint8) != 0x20
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _scanner(items: list[tuple[str | None, bytes]], window: int):
    """What scans the texts of a batch; made once per task."""
    automaton = _Automaton(items, window)
    numbers, lengths = automaton.numbers, automaton.lengths.tolist()

    def scan(texts: Iterator[bytes]) -> dict:
        out = {name: [] for name in RESULTS.names}
        for text in texts:
            normal = text.translate(NORMAL)
            words = normal.split()
            found, hits = set(), None
            ids = [numbers.get(w, 0) for w in words]
            for end, place in automaton.scan.iter(tuple(ids)) if any(ids) else ():
                if hits is None:
                    hits = np.zeros(len(words), bool)
                hits[end - lengths[place] + 1 : end + 1] = True
                found.add(place)
            spans = []
            if hits is not None:
                starts, ends = _word_starts(normal)
                for a, b in zip(*_runs(hits)):
                    start = len(text[: starts[a]].decode("utf-8", "replace"))
                    stop = start + len(text[starts[a] : ends[b - 1]].decode("utf-8", "replace"))
                    spans.append({"start": start, "end": stop})
            out["n_words"].append(len(words))
            out["n_hit"].append(0 if hits is None else int(hits.sum()))
            out["items"].append(automaton.items_of(found))
            out["spans"].append(spans)
        return out

    return scan


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text_column: str = "text", item_column: str = "item_id",
    item_text_column: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Add ``n_words, n_hit, items, spans, contaminated`` to every document.

    ``items`` are ids as strings in order; a document is contaminated if it has hits and
    they are a twentieth of its words or more.
    """
    items = benchmark.select(
        column(item_column).cast("string").alias("item"), column(item_text_column).cast("string").alias("text")
    ).where("text IS NOT NULL")
    # An upper bound of the words: each takes two bytes with its separator.
    size = items.agg((F.sum(F.octet_length("text") + 1) / 2).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(size) // block_words))
    if blocks > 1:
        return _judge(_in_blocks(docs, items, text_column, window, blocks))
    return _judge(_scan(docs, items, text_column, window))


def _scan(docs: DataFrame, items: DataFrame, text_column: str, window: int) -> DataFrame:
    rows = [(r["item"], r["text"].encode()) for r in items.collect()]  # at most block_words words
    shared = docs.sparkSession.sparkContext.broadcast(rows)  # texts; a task makes its automaton
    return annotate(docs, text_column, RESULTS, lambda: _scanner(shared.value, window))


def _in_blocks(docs: DataFrame, items: DataFrame, text_column: str, window: int, blocks: int) -> DataFrame:
    """One scan per block of items; items and spans add up, and words hit twice count once."""
    kept = [c for c in docs.columns if c not in (*RESULTS.names, "contaminated")]
    found = docs.select(
        *[column(c) for c in kept],
        F.array().cast("array<string>").alias("__items"),
        F.array().cast("array<struct<start:int,end:int>>").alias("__spans"),
    )
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        scanned = _scan(found, part, text_column, window)
        found = store(scanned.select(
            *[column(c) for c in kept], "n_words",
            F.array_union("__items", "items").alias("__items"), F.array_union("__spans", "spans").alias("__spans"),
        ))
        if block < blocks - 1:
            found = found.drop("n_words")
    return _merge_spans(found, text_column, kept)


def _merge_spans(found: DataFrame, text_column: str, kept: list[str]) -> DataFrame:
    """Join overlapping spans and count their words in the text."""
    ordered = F.array_sort("__spans")
    joined = F.aggregate(
        ordered,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, span: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= span["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(
                    F.element_at(done, -1)["start"].alias("start"),
                    F.greatest(F.element_at(done, -1)["end"], span["end"]).alias("end"),
                )),
            ),
        ).otherwise(F.concat(done, F.array(span))),
    )
    text = column(text_column).cast("string")
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    inside = F.transform("spans", lambda s: text.substr(s["start"] + 1, s["end"] - s["start"]))
    n_hit = F.aggregate(inside, F.lit(0).cast("long"), lambda n, t: n + F.regexp_count(t, F.lit(word)))
    return (
        found.withColumn("spans", joined)
        .select(*[column(c) for c in kept], "n_words", F.coalesce(n_hit, F.lit(0)).alias("n_hit"),
                F.array_sort("__items").alias("items"), "spans")
    )


def _judge(found: DataFrame) -> DataFrame:
    hit = F.col("n_hit")
    return found.withColumn("contaminated", (hit > 0) & (hit * 20 >= F.col("n_words")))
