"""Ranked lexical search without random access (NRA), over impact-sorted posting lists.

A text's terms are counted once: only terms that some query has are kept, as numbers, in
one compact stored row per document (``postings``).  Document frequencies, the number of
documents and the number of terms are aggregates over all of them.

Scoring runs in segments.  A task reads its share of the stored rows; every
``segment_rows`` of them make a segment, whose postings are sorted by term and falling
impact.  For each query the lists of its terms are read from the top, level by level.  A
document met on the way has a lower bound (the impacts read) and an upper one (plus, for
each list it was not met in, the impact at which that list stands).  Reading goes on until
the ten best are known: no document can still enter, every one that could be among them
has been met or ruled out in all lists, so its bounds agree, and ties are in order.  Lists
are never looked up by document, and documents ruled out are not kept.

A task carries the ten best of its segments on, so later segments start from their
threshold and often need no reading at all.  It emits ten rows a query at most; these are
ranked in two steps, so a query's rows do not meet in one task before most are gone.

Queries are dealt into blocks of at most ``block_bytes`` of text: the terms of one block
are what the driver and a task keep in memory, whatever the number of queries.

Defined results: a null or empty text, or one without terms, is never found and does not
count as a document; a query without terms finds nothing; queries that share an id are
queries of their own; repeated rows are documents of their own; equal scores are ordered
by id, null last; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcast.llm.common import annotate, column
from rollcast.llm.decontamination import words_of
from rollcast.sources.scratch import store

TOP = 10
SEGMENT_ROWS = 16_384
BLOCK_BYTES = 8_000_000

# Fixed values of the score: saturation, length normalisation, scale.
SCALE, SATURATION, SHARE = 1000, 8, 90

POSTINGS = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())),
    T.StructField("counts", T.ArrayType(T.IntegerType())),
])


def _postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """``id, n, terms, counts``: the number of terms, and those that queries have."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def task():
        known = shared.value

        def work(texts: Iterator[bytes]) -> dict:
            sizes, terms, counts = [], [], []
            for text in texts:
                words = words_of(text)
                found = np.array([known[w] for w in words if w in known], np.int32)
                own, times = np.unique(found, return_counts=True)
                sizes.append(len(words))
                terms.append(own)
                counts.append(times.astype(np.int32))
            kind = pa.list_(pa.int32())
            return {"n": pa.array(sizes, pa.int64()), "terms": pa.array(terms, kind), "counts": pa.array(counts, kind)}

        return work

    return annotate(docs, "body", POSTINGS, task).drop("body").where("n > 0")


def weight_of(n_docs: int, df: int) -> int:
    return math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Segment:
    """Posting lists of some documents, each sorted by falling impact."""

    def __init__(self, terms: np.ndarray, places: np.ndarray, impacts: np.ndarray, size: int):
        order = np.lexsort((places, -impacts, terms))
        self.size, self.places, self.impacts = size, places[order], impacts[order]
        self.names, first = np.unique(terms[order], return_index=True)
        self.bounds = np.append(first, len(order))

    def lists(self, query: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and impacts of the query's terms that occur here."""
        at = np.flatnonzero(np.isin(self.names, query, assume_unique=True))
        return [
            (self.places[a:b], self.impacts[a:b]) for a, b in zip(self.bounds[at], self.bounds[at + 1])
        ]

    def best(self, query: np.ndarray, top: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``top`` best above ``floor``, best first, by NRA."""
        lists = self.lists(query)
        heads = np.array([impacts[0] for _, impacts in lists], np.int64)
        nothing = np.zeros(0, np.int64)
        if not len(lists) or heads.sum() <= floor:
            return nothing, nothing
        lower = np.zeros(self.size, np.int64)
        met = np.zeros((len(lists), self.size), bool)
        read = np.zeros(len(lists), np.int64)
        stands = heads.copy()  # the impact at which each list stands, 0 at its end
        open_to_all, candidates, level = True, nothing, int(heads.max())
        kept = np.zeros(self.size, bool)
        while True:
            level //= 2
            for i, (places, impacts) in enumerate(lists):
                if not stands[i]:
                    continue
                # Impacts fall, so this is where they drop below the level.
                stop = len(impacts) - int(np.searchsorted(impacts[::-1], level, "left"))
                new, gain = places[read[i] : stop], impacts[read[i] : stop]
                if not open_to_all:
                    wanted = kept[new]
                    new, gain = new[wanted], gain[wanted]
                lower[new] += gain
                met[i, new] = True
                read[i] = stop
                stands[i] = impacts[stop] if stop < len(impacts) else 0
            if open_to_all:
                candidates = np.flatnonzero(met.any(axis=0))
            scores = lower[candidates]
            threshold = floor
            if len(scores) >= top:
                threshold = max(floor, int(np.partition(scores, len(scores) - top)[len(scores) - top]))
            upper = scores + stands @ ~met[:, candidates]
            # Ties stay: they are settled when all scores are final.
            able = (upper >= threshold) & (upper > floor)
            candidates = candidates[able]
            # A document not met so far could reach the sum of where the lists stand.
            reach = stands.sum()
            if reach < threshold or reach <= floor:
                open_to_all = False
            if not open_to_all:
                kept[:] = False
                kept[candidates] = True
                if (upper[able] == lower[candidates]).all():
                    break
        scores = lower[candidates]
        order = np.lexsort((candidates, -scores))[:top]
        return candidates[order], scores[order]


def _found(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("query", T.IntegerType()), T.StructField("id", id_type), T.StructField("score", T.LongType())
    ])


def _search_segments(
    postings: DataFrame, queries: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, top: int, segment_rows: int
) -> DataFrame:
    """``query, id, score``: of every task its ``top`` best documents of each query."""
    schema = _found(postings.schema["id"].dataType)
    shared = postings.sparkSession.sparkContext.broadcast((queries, weights))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in batches:
            while size + batch.num_rows >= segment_rows:
                part = batch.slice(0, segment_rows - size)
                yield pa.Table.from_batches([*held, part])
                held, size, batch = [], 0, batch.slice(part.num_rows)
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
        if held:
            yield pa.Table.from_batches(held)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        if not asked:
            return
        # Of each query the best so far: scores, and the rows' places among ``ids``.
        ids, best = None, [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in asked]
        for table in segments(batches):
            table = table.combine_chunks()
            sizes = table["n"].to_numpy()
            terms = table["terms"].combine_chunks()
            count = table["counts"].combine_chunks().flatten().to_numpy().astype(np.int64)
            term = terms.flatten().to_numpy()
            place = np.repeat(np.arange(len(sizes)), terms.value_lengths().to_numpy())
            m = 100 - SHARE + SHARE * sizes * n_docs // n_terms
            impact = weight[term] * (1_000_000_000 * count // (SCALE * count + SATURATION * m[place]))
            segment = Segment(term, place, impact, len(sizes))
            base = 0 if ids is None else len(ids)
            ids = table["id"].combine_chunks() if ids is None else pa.concat_arrays([ids, table["id"].combine_chunks()])
            for i, query in enumerate(asked):
                scores, places = best[i]
                # A later row of equal score comes after, so it has to be better.
                floor = int(scores[-1]) if len(scores) == top else 0
                new, gained = segment.best(query, top, floor)
                if len(new):
                    scores, places = np.concatenate((scores, gained)), np.concatenate((places, new + base))
                    order = np.argsort(-scores, kind="stable")[:top]
                    best[i] = scores[order], places[order]
            # Only rows that are still among the best are carried on.
            used = np.unique(np.concatenate([p for _, p in best]))
            ids = ids.take(pa.array(used))
            best = [(s, np.searchsorted(used, p)) for s, p in best]
        if ids is not None:
            number = np.repeat(np.arange(len(best), dtype=np.int32), [len(s) for s, _ in best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(number), ids.take(pa.array(np.concatenate([p for _, p in best]))),
                 pa.array(np.concatenate([s for s, _ in best]))], schema.names,
            )

    # Rows in order of id, so that a place decides between equal scores.
    ordered = postings.sortWithinPartitions(F.col("id").asc_nulls_last())
    return ordered.select("n", "terms", "counts", "id").mapInArrow(search, schema)


def _first(found: DataFrame, group: list[str], top: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    window = Window.partitionBy(*group).orderBy(*order)
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top)


def _search_block(docs: DataFrame, block: list[tuple[object, bytes]], item_type: T.DataType, top: int, segment_rows: int) -> DataFrame:
    spark = docs.sparkSession
    numbers: dict[bytes, int] = {}
    queries = [
        np.array(sorted({numbers.setdefault(w, len(numbers)) for w in words_of(text)}), np.int32) for _, text in block
    ]
    postings = store(_postings(docs, numbers))
    size = postings.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    # A row per term of the block.
    counted = postings.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    weights = np.zeros(len(numbers), np.int64)
    for term, df in zip(counted["term"].to_pylist(), counted["count"].to_pylist()):
        weights[term] = weight_of(size["docs"], df)
    found = _search_segments(postings, queries, weights, size["docs"], max(1, size["terms"] or 0), top, segment_rows)
    salted = found.withColumn("__part", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(64)))
    best = _first(_first(salted, ["query", "__part"], top).drop("__part"), ["query"], top)
    items = spark.createDataFrame(
        [(i, item) for i, (item, _) in enumerate(block)],
        T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item_id", item_type)]),
    )
    return best.join(items, "query").select("item_id", "rank", "id", "score")


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """Queries in blocks of bounded text, dealt by a hash; a longer text is a block of its own."""
    size = items.agg(F.sum(F.octet_length("body")).alias("n")).first()["n"] or 0
    count = max(1, -(-2 * size // block_bytes))
    dealt: Column = F.pmod(F.xxhash64("item", "body", F.monotonically_increasing_id()), F.lit(count))
    stored = store(items.withColumn("block", dealt)) if count > 1 else items.withColumn("block", F.lit(0))
    for block in range(count):
        yield [(r["item"], r["body"].encode()) for r in stored.where(F.col("block") == block).collect()]


def search(
    docs: DataFrame, items: DataFrame, *, text_column: str = "text", id_column: str = "doc_id",
    item_column: str = "item_id", item_text_column: str = "text", top: int = TOP,
    segment_rows: int = SEGMENT_ROWS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``item_id, rank, id, score``: of every item the ``top`` documents with the highest scores above 0."""
    rows = docs.select(column(id_column).alias("id"), column(text_column).cast("string").alias("body"))
    asked = items.select(column(item_column).alias("item"), column(item_text_column).cast("string").alias("body"))
    asked = asked.where("body IS NOT NULL")
    item_type = asked.schema["item"].dataType
    found = [_search_block(rows, block, item_type, top, segment_rows) for block in _blocks(asked, block_bytes)]
    return reduce(DataFrame.unionByName, found)
