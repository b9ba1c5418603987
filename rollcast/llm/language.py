"""Language of every stretch of a text: script ranges, n-gram scores, Viterbi over words.

A word is a run of letters (and marks on them) of one script.  Learning counts, for every
language, the hashed character n-grams of all its words, word borders included, and the
letters of each script.  Every labelled row takes part: tasks add to one array per
language, and the arrays' entries are summed by Spark, so a language with a third of all
rows costs no more than others.  The model has ``buckets`` numbers per n-gram length and
language; that is all that reaches the driver and the tasks.

Scoring: a word's script leaves the languages that write in it; each gets the mean log
probability of the word's n-grams times the root of their number, since overlapping n-grams
say less than independent ones.  Viterbi finds the best sequence of languages where every
change costs ``penalty``.  It runs over the words of many texts side by side, so its loop is
as long as the longest text of a batch, not as all of them.  Neighbouring words of one
language form a span; the language with most letters is the text's, and its share of them
the score.

Defined results: a null or empty text, or one without letters, has language ``und``, score
0 and no spans; so has every text if nothing was learned.  A script that no learned language
uses leaves all of them.  Equal shares of letters, and equal paths, go to the language first
by code point.  Rows with a null label or text are not learned from; repeated rows count as
often as they occur; an empty table gives an empty result; other columns pass through,
clashing ones are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcast.llm.common import ROW, column, small_batches, texts_of
from rollcast.llm.hashing import Runs, mix

ORDERS = (1, 2, 3)
BUCKETS = 1 << 14
PENALTY = 3.0
SMOOTHING = 0.5
# Of a language's letters, the least share a script must have to be one of its scripts.
LEAST_SHARE = 0.001
# Words that are scored side by side: enough for short loops, few enough for little memory.
BATCH_LETTERS = 2_000_000

UNKNOWN = "und"

# First and last code point of the blocks of each script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x250, 0x2AF), (0x300, 0x36F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "burmese": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
OTHER = len(SCRIPTS) + 1
HAN_END = SCRIPTS["han"][-1][1]

COUNTS = "language string, kind int, at long, n long"

SPAN = T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("language", T.StringType())
])
RESULTS = T.StructType([
    T.StructField("language", T.StringType()), T.StructField("score", T.DoubleType()),
    # Code points, end exclusive, of runs of words of one language.
    T.StructField("spans", T.ArrayType(SPAN)),
])


# Beyond this code point there are only Han letters, tags and private characters.
_LAST = 0x20000


def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: script of a letter or mark (0: neither), is it a letter, and its lower case."""
    kind = np.array([unicodedata.category(chr(c))[0] for c in range(_LAST)] + ["L"], "U1")
    script = np.where((kind == "L") | (kind == "M"), OTHER, 0).astype(np.uint8)
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            part = script[first : last + 1]
            part[part > 0] = number
    lower = np.arange(_LAST + 1, dtype=np.uint32)
    for c in np.flatnonzero(kind == "L")[:-1].tolist():
        small = chr(c).lower()
        if len(small) == 1:
            lower[c] = ord(small)
    return script, kind == "L", lower


@dataclass(frozen=True)
class Words:
    """The words of some texts, in order, over one array of their characters.

    Before and after each word stands a border (0), so n-grams see where words begin.
    """

    characters: np.ndarray
    first: np.ndarray  # where each word begins in ``characters``
    size: np.ndarray  # and its characters
    start: np.ndarray  # and its place in its text
    text: np.ndarray  # which text
    script: np.ndarray
    letters: np.ndarray

    @staticmethod
    def of(texts: list[bytes], tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Words:
        script_of, letter, lower = tables
        points = [np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        sizes = np.array([len(p) for p in points], np.int64)
        # A border after each text keeps words of different texts apart.
        joined = np.concatenate([x for p in points for x in (p, np.zeros(1, np.uint32))] or [np.zeros(0, np.uint32)])
        joined = np.where(joined <= HAN_END, np.minimum(joined, _LAST), 0)
        script = script_of[joined]
        edge = np.flatnonzero(np.diff(script, prepend=0, append=0))
        begin, end = edge[:-1], edge[1:]
        inside = script[begin] > 0 if len(begin) else np.zeros(0, bool)
        begin, end = begin[inside], end[inside]
        text_end = np.cumsum(sizes + 1)
        text = np.searchsorted(text_end, begin, "right")
        size = end - begin
        # Copied with a border before each word and one at the very end.
        first = np.cumsum(size + 1) - size
        characters = np.zeros(int(first[-1] + size[-1]) + 1 if len(size) else 1, np.uint32)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        source = np.repeat(begin, size) + place
        characters[np.repeat(first, size) + place] = lower[joined[source]]
        letters = np.add.reduceat(letter[joined[source]].astype(np.int64), np.cumsum(size) - size) if len(size) else size
        own = begin - (text_end - sizes - 1)[text]
        return Words(characters, first, size, own, text, script[begin], letters)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """One of each group of equal words, and the group of every word."""
        runs = Runs(mix(self.characters.astype(np.uint64)))
        _, which, group = np.unique(runs.between(self.first, self.first + self.size), return_index=True, return_inverse=True)
        return which, group

    def grams(self, which: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the n-grams of these words, and the place in ``which`` of each one's word."""
        # Each word with both borders: characters first - 1 ... first + size.
        length = self.size[which] + 2
        word = np.repeat(np.arange(len(which)), length)
        place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        fits = place <= length[word] - order
        if order == 1:
            fits &= (place > 0) & (place < length[word] - 1)
        at = (np.repeat(self.first[which] - 1, length) + place)[fits]
        h = np.full(len(at), order, np.uint64)
        for i in range(order):
            h = (h ^ self.characters[at + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h % np.uint64(buckets)).astype(np.int64), word[fits]


@dataclass(frozen=True)
class Model:
    """Log probabilities by order, bucket and language; which languages write in each script."""

    languages: list[str]
    tables: list[np.ndarray]
    allowed: np.ndarray
    orders: tuple[int, ...] = ORDERS
    buckets: int = BUCKETS

    def score(self, words: Words) -> np.ndarray:
        """Words by languages; minus infinity where the script rules a language out."""
        which, group = words.distinct()
        total = np.zeros((len(which), len(self.languages)), np.float32)
        number = np.zeros(len(which), np.float32)
        for order, table in zip(self.orders, self.tables):
            bucket, word = words.grams(which, order, self.buckets)
            count = np.bincount(word, minlength=len(which))
            number += count
            some = np.flatnonzero(count)
            if len(some):
                starts = (np.cumsum(count) - count)[some]
                total[some] += np.add.reduceat(table[bucket], starts, axis=0)
        total /= np.sqrt(np.maximum(number, 1))[:, None]
        total[~self.allowed[words.script[which]]] = -np.inf
        return total[group]


def learn(
    docs: DataFrame, *, text_column: str = "text", label_column: str = "lang", orders: tuple[int, ...] = ORDERS,
    buckets: int = BUCKETS,
) -> Model:
    """Count the n-grams and scripts of all labelled texts."""
    rows = docs.select(
        column(label_column).cast("string").alias("language"), column(text_column).cast("string").alias("body")
    ).where("language IS NOT NULL AND body IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[np.ndarray]] = {}
        tables = _characters()
        for batch in _letter_batches(batches):
            texts = list(texts_of(batch.column("body")))
            names = np.array(batch.column("language").to_pylist(), object)
            for name in set(names):
                own = found.setdefault(name, [np.zeros(buckets, np.int64) for _ in orders] + [np.zeros(OTHER + 1, np.int64)])
                words = Words.of([texts[i] for i in np.flatnonzero(names == name)], tables)
                which, group = words.distinct()
                times = np.bincount(group, minlength=len(which))
                for i, order in enumerate(orders):
                    bucket, word = words.grams(which, order, buckets)
                    own[i] += np.bincount(bucket, times[word], buckets).astype(np.int64)
                own[-1] += np.bincount(words.script, words.letters, OTHER + 1).astype(np.int64)
        for name, arrays in found.items():
            for kind, values in enumerate(arrays):
                at = np.flatnonzero(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(np.full(len(at), kind, np.int32)),
                     pa.array(at), pa.array(values[at])], ["language", "kind", "at", "n"],
                )

    counted = rows.mapInArrow(count, COUNTS).groupBy("language", "kind", "at").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counted["language"].to_pylist()))
    number = {name: i for i, name in enumerate(languages)}
    own = np.array([number[n] for n in counted["language"].to_pylist()], np.int64)
    kind, at, n = (counted[c].to_numpy() for c in ("kind", "at", "n"))
    tables = []
    for i in range(len(orders)):
        table = np.zeros((buckets, len(languages)))
        here = kind == i
        table[at[here], own[here]] = n[here]
        tables.append(np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * buckets)).astype(np.float32))
    letters = np.zeros((OTHER + 1, len(languages)))
    here = kind == len(orders)
    letters[at[here], own[here]] = n[here]
    allowed = letters >= LEAST_SHARE * np.maximum(letters.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True
    return Model(languages, tables, allowed, orders, buckets)


def best_paths(scores: np.ndarray, text: np.ndarray, penalty: float) -> np.ndarray:
    """The language of every word: the best path of each text, where a change costs ``penalty``.

    Words come in order, texts one after the other.  Step ``t`` handles the ``t``-th words of
    all texts that have one; texts are taken by falling length, so these stand first.
    """
    if not len(text):
        return np.zeros(0, np.int64)
    _, first, count = np.unique(text, return_index=True, return_counts=True)
    by_length = np.argsort(-count, kind="stable")
    first, count = first[by_length], count[by_length]
    steps = int(count[0])
    # How many texts have a t-th word, and where those words are.
    active = np.searchsorted(-count, -np.arange(steps), "left")
    came_from = np.zeros(scores.shape, np.int32)
    value = scores[first].astype(float)
    rows = np.arange(len(first))
    for t in range(1, steps):
        k = active[t]
        before = value[:k]
        top = before.argmax(axis=1)
        change = (before[rows[:k], top] - penalty)[:, None]
        at = first[:k] + t
        # -1: stayed.
        came_from[at] = np.where(before >= change, -1, top[:, None])
        value[:k] = np.maximum(before, change) + scores[at]
    path = np.zeros(len(text), np.int64)
    state = value.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        path[at] = state[:k]
        if t:
            origin = came_from[at, state[:k]]
            state[:k] = np.where(origin < 0, state[:k], origin)
    return path


def _letter_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded text (or a single row)."""
    for batch in small_batches(batches, 4096):
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("body")), 0).to_numpy(zero_copy_only=False))
        at, done = 0, 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(sizes, done + BATCH_LETTERS, "right")))
            stop = min(stop, batch.num_rows)
            yield batch.slice(at, stop - at)
            at, done = stop, int(sizes[stop - 1])


def _label(texts: list[bytes], model: Model, penalty: float, tables) -> dict[str, list]:
    languages: list[str] = [UNKNOWN] * len(texts)
    shares, spans = [0.0] * len(texts), [[] for _ in texts]
    words = Words.of(texts, tables)
    if model.languages and len(words.size):
        path = best_paths(model.score(words), words.text, penalty)
        # Letters of each language in each text; the first of the greatest wins.
        width = len(model.languages)
        letters = np.bincount(words.text * width + path, words.letters, len(texts) * width).reshape(-1, width)
        whole = letters.sum(axis=1)
        for i in np.flatnonzero(whole):
            best = int(letters[i].argmax())
            languages[i], shares[i] = model.languages[best], float(letters[i, best] / whole[i])
        new = np.flatnonzero((np.diff(words.text, prepend=-1) != 0) | (np.diff(path, prepend=-1) != 0))
        last = np.append(new[1:], len(path)) - 1
        for a, b in zip(new.tolist(), last.tolist()):
            if whole[words.text[a]]:
                end = int(words.start[b] + words.size[b])
                spans[words.text[a]].append({"start": int(words.start[a]), "end": end, "language": model.languages[path[a]]})
    return {"language": languages, "score": shares, "spans": spans}


def identify(docs: DataFrame, model: Model, *, text_column: str = "text", penalty: float = PENALTY) -> DataFrame:
    """Add ``language``, ``score`` and ``spans`` to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = RESULTS.names
    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(
        F.struct(*[column(c).alias(c) for c in kept]).alias(ROW), column(text_column).cast("string").alias("body")
    )
    schema = T.StructType([rows.schema[ROW], *RESULTS.fields])
    kinds = [pa.string(), pa.float64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("language", pa.string())]))]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _characters()
        for batch in _letter_batches(batches):
            found = _label(list(texts_of(batch.column("body"))), shared.value, penalty, tables)
            arrays = [pa.array(found[n], kind) for n, kind in zip(names, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(ROW), *arrays], [ROW, *names])

    mapped = rows.mapInArrow(label, schema)
    return mapped.select(*[F.col(ROW).getField(c).alias(c) for c in kept], *names)
