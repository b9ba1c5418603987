"""Mixing of sources to target weights by a low-discrepancy schedule. DataFrame operations only.

The documents of a source are shuffled (by a hash of id and text) and laid end to end as
one stream of words, which repeats while the target asks for more.  The stream is cut
into blocks of equally many words; a source needs so many blocks as reach its target.  With
``B`` blocks in all, slot ``i`` of the mix is the point ``frac(i * g / B)``, where ``g / B`` is
the fraction next to the inverse golden ratio with ``g`` prime to ``B``.  These points are as
evenly spread as those of the golden ratio itself, and each multiple of ``1 / B`` is met
exactly once: the cumulative numbers of blocks map a point to a source, and every source,
however small, gets exactly as many slots as it needs.  The k-th slot of a source takes
the k-th block of its stream; what the mix takes of a document is what these blocks hold.

Defined results: a null text has no words; a null source is a source of its own, last in
order; a null id is kept; repeated rows are laid end to end like other rows; documents
without words are returned with ``taken = 0``; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcast.llm.common import column, running_total
from rollcast.sources.scratch import store

WORD = r"[^\x20\x09-\x0D]+"

# Inverse golden ratio, and into how many cells the points are dealt.
GOLDEN = (5**0.5 - 1) / 2
CELLS = 4096

ROWS_PER_BUCKET = 50_000
SLOTS_PER_BUCKET = 65_536


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), total: float = 1.5, cap: int = 2
) -> DataFrame:
    """Targets of the sources: ``source, source_size`` in, with ``target`` out.

    Weights go round over the sources in code point order, null last.  ``total`` times all
    sizes is shared by weight; a source stops at ``cap`` times its size, and the excess is
    shared again among the others.  That is ``least(cap, level * weight)`` for one level,
    found by one pass over the sources in the order in which they reach their caps.
    There is one row per source, so the windows over all sources stay small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod("number", F.lit(len(weights))).cast("int") + 1)
    named = (
        sizes.withColumn("number", (F.row_number().over(by_name) - 1).cast("long"))
        .withColumn("weight", weight.cast("long"))
        .withColumn("most", F.col("source_size") * cap)
    )
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), "number")
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    earlier = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) * F.lit(float(total))
        - F.coalesce(F.sum("most").over(earlier), F.lit(0))
    ) / F.sum("weight").over(rest)
    fits = F.col("level") <= F.col("most") / F.col("weight")
    return (
        named.withColumn("level", level)
        .withColumn("level", F.max(F.when(fits, F.col("level"))).over(everything))
        .withColumn("target", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")))
        .select("source", "number", "source_size", "target")
    )


def step_of(n_slots: int) -> int:
    """The number next to the golden section of ``n_slots`` that has no divisor with it."""
    step = max(1, round(n_slots * GOLDEN))
    while gcd(step, n_slots) > 1:
        step += 1
    return step


def _slots(blocks: DataFrame, n_slots: int) -> DataFrame:
    """``number, rank, slot``: the source of every slot and the slot's place among that source's.

    ``blocks`` has the sources with their ``n_blocks``, which sum to ``n_slots``, and the
    number ``first`` of blocks before them.
    """
    spark, step, cell = blocks.sparkSession, step_of(n_slots), n_slots // CELLS + 1
    intervals = blocks.where("n_blocks > 0").select(
        "number", F.col("first").alias("__from"), (F.col("first") + F.col("n_blocks")).alias("__to"),
        F.explode(F.expr(f"sequence(first div {cell}, (first + n_blocks - 1) div {cell})")).alias("cell"),
    )
    # slot * step modulo n_slots, in two parts so that no product overflows.
    high, low = f"(id div {1 << 20})", f"(id % {1 << 20})"
    point = F.expr(f"(({high} * {step} % {n_slots}) * {1 << 20} % {n_slots} + {low} * {step} % {n_slots}) % {n_slots}")
    points = spark.range(n_slots).select(F.col("id").alias("slot"), point.alias("point"))
    points = points.withColumn("cell", F.expr(f"point div {cell}"))
    # Stored, so that Spark knows its size: a few thousand rows and one per source.
    placed = points.join(store(intervals), "cell").where("point >= __from AND point < __to")
    placed = placed.select("number", "slot", F.expr(f"slot div {SLOTS_PER_BUCKET}").alias("bucket"), F.lit(1).alias("one"))
    return running_total(placed, ["number"], "bucket", [F.col("slot")], "one", "rank").select("number", "rank", "slot")


def mix_blocks(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    weights: Sequence[int] = (5, 2, 1), total: float = 1.5, cap: int = 2, block_words: int = 64,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix itself, with its documents and targets.

    Returns ``(pieces, placed, targets)``.  ``pieces`` has one row for each part of a
    document in a block: ``slot`` orders the mix, ``first_word`` and ``n_words`` say what
    the part holds.  ``placed`` is every document with its size and place in its stream.
    """
    text = column(text_column)
    place = F.xxhash64(column(id_column).cast("string"), text, F.lit(7))
    sized = docs.select(
        column(id_column).alias("id"),
        column(source_column).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        place.alias("place"),
    )
    sized = store(sized)
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sizes = store(sizes)
    n_rows = sizes.agg(F.sum("n")).first()[0] or 0
    targets = store(source_targets(sizes.drop("n"), weights, total, cap))

    blocks = F.expr(f"(CAST(floor(target) AS BIGINT) + {block_words - 1}) div {block_words}")
    earlier = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    in_blocks = targets.withColumn("n_blocks", blocks)
    in_blocks = in_blocks.withColumn("first", F.coalesce(F.sum("n_blocks").over(earlier), F.lit(0).cast("long")))

    bits = max(0, -(-n_rows // ROWS_PER_BUCKET) - 1).bit_length()
    bucket = F.shiftright("place", 64 - bits) if bits else F.lit(0).cast("long")
    numbered = sized.withColumn("bucket", bucket).join(
        targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))
    ).drop("__source")
    worded = numbered.where("size > 0")
    order = [F.col(c) for c in ("place", "id", "size")]
    placed = store(running_total(worded, ["number"], "bucket", order, "size", "start").drop("bucket"))

    n_slots = in_blocks.agg(F.sum("n_blocks")).first()[0] or 0
    slots = _slots(in_blocks, max(1, n_slots))

    # A document lies once in every pass over the stream, up to the target.
    end = F.least(F.col("from") + F.col("size"), F.floor("target"))
    passes = (
        placed.withColumn("pass", F.explode(F.array(*[F.lit(i).cast("long") for i in range(cap)])))
        .withColumn("from", F.col("start") + F.col("pass") * F.col("source_size"))
        .withColumn("to", end)
        .where("to > from")
        .withColumn("rank", F.explode(F.expr(f"sequence(from div {block_words}, (to - 1) div {block_words})")))
    )
    first = F.greatest("from", F.col("rank") * block_words)
    last = F.least("to", (F.col("rank") + 1) * block_words)
    pieces = passes.join(slots, ["number", "rank"]).select(
        "slot", "source", "number", "id", "start", "pass",
        (first - F.col("from")).alias("first_word"), (last - first).alias("n_words"),
    )
    empty = numbered.where("size = 0").withColumn("start", F.lit(None).cast("long")).drop("bucket")
    return pieces, placed.unionByName(empty), targets


def mix(docs: DataFrame, **options) -> DataFrame:
    """How many words the mix takes of every document.

    ``id, source, size, source_size, target, taken``, the first slot with words of the document, and a
    digest of all its slots (the exclusive or of their hashes); one row per input row.
    """
    pieces, placed, _ = mix_blocks(docs, **options)
    # Documents with words start at different places of their stream.
    taken = pieces.groupBy("number", "start").agg(
        F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"), F.bit_xor(F.xxhash64("slot")).alias("slots_digest")
    )
    return placed.join(taken, ["number", "start"], "left").select(
        "id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"),
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "slots_digest",
    )
