"""Quality rules: repetition counts and calibrated n-gram models against fixed thresholds.

A row fails the base rules with fewer than ``least_words`` words or with more than
``most_repeated`` percent of its words in repeated 5-word windows.  Other rows are kept
if every model gives its good class a probability of ``threshold`` or more.  There is a
model for quality and one for freedom from toxic words, trained on labelled rows.

Defined results: null and empty texts have no words and fail the base rules; without
labelled rows of both kinds a model passes everything or nothing, as its labels say, and
without any label it passes everything; repeated rows are judged alike; other columns
pass through, clashing ones are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcast.llm.common import annotate
from rollcast.llm.hashing import Runs, word_hashes
from rollcast.llm.linear import SAMPLE_ROWS, features, fit_models

SYMBOLS = b"#*$%&|<>"
REPEAT = 5

RESULTS = T.StructType([
    *[T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    *[T.StructField(n, T.DoubleType()) for n in ("p_quality", "p_clean")],
])

_SPACES = bytes([0x20, *range(0x09, 0x0E)])


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words in repeated windows."""
    starts, _, hashes = word_hashes(text)
    in_words = np.frombuffer(text.translate(None, _SPACES), np.uint8)
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line.strip(_SPACES):
            again += line in seen
            seen.add(line)
    windows = Runs(hashes).windows(REPEAT)
    repeated = 0
    if len(windows):
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
        cover = np.zeros(len(starts) + 1, np.int64)
        at = np.flatnonzero(counts[inverse] > 1)
        cover[at] += 1
        np.add.at(cover, at + REPEAT, -1)
        repeated = int((np.cumsum(cover)[:-1] > 0).sum())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(starts), int(((in_words & 0xC0) != 0x80).sum()), symbols, again, repeated


def judge(
    docs: DataFrame, labels: DataFrame, *, text_column: str = "text", id_column: str = "doc_id",
    quality_column: str = "quality", toxic_column: str = "toxic", sample_rows: int = SAMPLE_ROWS,
    least_words: int = 10, most_repeated: int = 20, threshold: float = 0.5,
) -> DataFrame:
    """Add the counts, both probabilities, ``base_failed`` and ``kept`` to every row."""
    good = {quality_column: lambda v: v > 0, toxic_column: lambda v: v <= 0}
    fitted = fit_models(docs, labels, good, id_column=id_column, text_column=text_column, sample_rows=sample_rows)
    models = docs.sparkSession.sparkContext.broadcast(fitted)

    def task():
        scorers = [m.scorer() for m in models.value]

        def work(texts: Iterator[bytes]) -> dict:
            out = []
            for text in texts:
                found = features(text)
                out.append((*base_counts(text), *[float(s(*found)) for s in scorers]))
            return dict(zip(RESULTS.names, zip(*out)))

        return work

    found = annotate(docs, text_column, RESULTS, task)
    few = F.col("n_words") < least_words
    repeated = F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated
    good = (F.col("p_quality") >= threshold) & (F.col("p_clean") >= threshold)
    return found.withColumn("base_failed", few | repeated).withColumn("kept", ~F.col("base_failed") & good)
