"""Calibrated logistic regression over hashed word and character n-grams.

Features of a text, lower-cased (A-Z): which words and pairs of neighbouring words occur
(hashed), and the square root of the share of each hashed character n-gram; only what a
text has is kept.  Models are trained on a bounded sample of labelled rows (``sample_rows``):
features are screened by their score test, a ridge regression is fitted on those that
pass, and its scores are calibrated on held-out rows (Platt).  The sample is gathered in one
task, whose size that parameter bounds, and fitted there; only the weights come back.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcast.llm.common import annotate, column
from rollcast.llm.hashing import Runs, byte_runs, word_hashes

WORD_SPACE = 1 << 22
CHAR_SPACE = 1 << 13
GRAM = 3

# Screening: rows a feature must occur in, its least score, and how many features pass at most.
LEAST_ROWS, LEAST_Z, MOST_FEATURES = 8, 4.0, 1600
RIDGE = 3.0
SAMPLE_ROWS = 4000
HELD_OUT = 5  # one row in so many
BLOCK = 256  # rows weighted at a time


# Hashed words and word pairs that occur; n-grams that occur, and the roots of their shares.
Features = tuple[np.ndarray, np.ndarray, np.ndarray]


def features(text: bytes) -> Features:
    lower = text.lower()
    _, _, hashes = word_hashes(lower)
    both = np.concatenate((hashes, Runs(hashes).windows(2)))
    words = np.unique((both % np.uint64(WORD_SPACE)).astype(np.int32))
    grams = byte_runs(lower).windows(GRAM) % np.uint64(CHAR_SPACE)
    counts = np.bincount(grams.astype(np.int64), minlength=CHAR_SPACE)
    at = np.flatnonzero(counts).astype(np.int32)
    return words, at, np.sqrt(counts[at] / max(1, len(grams))).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Weights by feature; ``scale`` and ``shift`` calibrate.  Without features all rows get ``shift``."""

    words: np.ndarray
    word_weights: np.ndarray
    grams: np.ndarray
    gram_weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def scorer(self):
        of_word, of_gram = np.zeros(WORD_SPACE, np.float32), np.zeros(CHAR_SPACE, np.float32)
        of_word[self.words] = self.word_weights
        of_gram[self.grams] = self.gram_weights

        def score(words: np.ndarray, grams: np.ndarray, shares: np.ndarray) -> float:
            raw = self.bias + float(of_word[words].sum()) + float(of_gram[grams] @ shares)
            return sigmoid(self.scale * raw + self.shift)

        return score


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression; the last column of ``x`` is the intercept."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        hessian, spread = np.diag(penalty), np.maximum(p * (1 - p), 1e-6)
        for at in range(0, len(x), BLOCK):
            part = x[at : at + BLOCK]
            hessian += (part * spread[at : at + BLOCK, None]).T @ part
        step = np.linalg.solve(hessian, gradient)
        size = np.abs(step).max()
        w -= step * min(1.0, 5 / max(size, 1e-12))
        if size < 1e-6:
            break
    return w


def fit(rows: list[Features], labels: np.ndarray) -> Model:
    """Fit on the features of labelled rows.

    Rows of one kind only give a model that says so of all texts; no rows, one that
    passes all texts.
    """
    labels = np.asarray(labels).astype(np.int64)
    none = np.zeros(0, np.int64)
    if len(rows) == 0 or labels.min() == labels.max():
        shift = -20.0 if len(rows) and not labels[0] else 20.0
        return Model(none, none, none, none, 0.0, 0.0, shift)
    held = np.arange(len(rows)) % HELD_OUT == 0
    if min(labels[held].min(), 1 - labels[held].max()) or labels[~held].min() == labels[~held].max():
        held[:] = False
    train = ~held
    y = labels[train].astype(float)
    n, base = len(y), y.mean()
    centred, spread = y - base, base * (1 - base)

    # Score test of every feature against the label.
    picked = [rows[i] for i in np.flatnonzero(train)]
    words, grams, shares = (np.concatenate([p[i] for p in picked]) for i in range(3))
    of_words, of_grams = (np.repeat(centred, [len(p[i]) for p in picked]) for i in range(2))
    seen, words = np.unique(words, return_inverse=True)
    count = np.bincount(words, minlength=len(seen))
    share = count / n
    z = np.bincount(words, of_words, len(seen)) / np.sqrt(np.maximum(spread * n * share * (1 - share), 1e-12))
    z[count < LEAST_ROWS] = 0
    mean, square = (np.bincount(grams, v, CHAR_SPACE) / n for v in (shares, shares.astype(float) ** 2))
    deviation = np.sqrt(np.maximum(square - mean**2, 0))
    product = np.bincount(grams, of_grams * shares, CHAR_SPACE)
    z_grams = product / np.sqrt(np.maximum(spread * n, 1e-12)) / np.maximum(deviation, 1e-6)
    z_grams[np.bincount(grams, minlength=CHAR_SPACE) < LEAST_ROWS] = 0
    del words, grams, shares, of_words, of_grams, count, share
    both = np.abs(np.concatenate((z, z_grams)))
    able = np.flatnonzero(both >= LEAST_Z)
    best = able[np.argsort(-both[able], kind="stable")[:MOST_FEATURES]]
    words, chars = seen[np.sort(best[best < len(seen)])], np.sort(best[best >= len(seen)] - len(seen))

    place, place_gram = np.full(WORD_SPACE, -1, np.int32), np.full(CHAR_SPACE, -1, np.int32)
    place[words] = np.arange(len(words))
    place_gram[chars] = np.arange(len(chars)) + len(words)
    x = np.zeros((len(rows), len(words) + len(chars) + 1))
    # Gram shares are small numbers; scaled, the ridge treats them like the words.
    scale = 1 / np.maximum(deviation[chars], 1e-6)
    for i, (own, grams, shares) in enumerate(rows):
        found = place[own]
        x[i, found[found >= 0]] = 1
        found = place_gram[grams]
        x[i, found[found >= 0]] = shares[found >= 0]
    x[:, len(words) : -1] *= scale
    x[:, -1] = 1
    w = _newton(x[train], y, RIDGE)
    a, b = 1.0, 0.0
    if held.any():
        raw = x[held] @ w
        calibration = _newton(np.stack((raw, np.ones(len(raw))), 1), labels[held].astype(float), 1e-2)
        if calibration[0] > 0:
            a, b = map(float, calibration)
    return Model(words, w[: len(words)].astype(np.float32), chars, (w[len(words) : -1] * scale).astype(np.float32), float(w[-1]), a, b)


SAMPLE = T.StructType([T.StructField(n, T.BinaryType()) for n in ("words", "grams", "shares")])


def fit_models(
    docs: DataFrame, labels: DataFrame, good: dict[str, Callable[[np.ndarray], np.ndarray]], *,
    id_column: str = "doc_id", text_column: str = "text", sample_rows: int = SAMPLE_ROWS,
) -> list[Model]:
    """A model per label column; ``good`` tells which of its values are the good ones.

    At most ``sample_rows`` labelled documents are learned from, drawn by a hash of the id.
    Rows without an id or any label are no examples; contradicting labels count as the lowest.
    """
    names = list(good)
    known = labels.select(column(id_column).alias("__id"), *[column(c).cast("int").alias(c) for c in names])
    known = known.where(F.col("__id").isNotNull()).dropna(subset=names)
    known = known.groupBy("__id").agg(*[F.min(c).alias(c) for c in names])
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    rows = docs.select(column(id_column).alias("__id"), column(text_column).alias("__body")).join(sample, "__id")

    def task():
        def work(texts: Iterator[bytes]) -> dict:
            found = [features(t) for t in texts]
            return {n: pa.array([f[i].tobytes() for f in found], pa.binary()) for i, n in enumerate(SAMPLE.names)}

        return work

    # Repeated documents could make more rows than the sample has labels.
    found = annotate(rows, "__body", SAMPLE, task).drop("__body").orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, examples, values = (np.int32, np.int32, np.float32), [], {n: [] for n in names}
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in SAMPLE.names]
            examples += [tuple(np.frombuffer(v, kind) for v, kind in zip(row, kinds)) for row in zip(*columns)]
            for n in names:
                values[n] += batch.column(n).to_pylist()
        if examples:
            models = [fit(examples, good[n](np.array(values[n], np.int64))) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps([asdict(m) for m in models])], pa.binary())], ["models"])

    # The limit leaves one partition; without rows there is nothing to learn.
    fitted = found.select(*SAMPLE.names, *names).mapInArrow(learn, "models binary").collect()
    if not fitted:
        return [fit([], np.zeros(0)) for _ in names]
    return [Model(**fields) for fields in pickle.loads(fitted[0]["models"])]
