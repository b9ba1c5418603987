"""Token counts by a tokenizer compiled into a finite-state transducer.

A byte-fallback BPE model is turned into a deterministic transducer over characters
whose transitions carry the change of the token count.  Let ``e(i)`` be the last token
of the encoding of the first ``i`` characters.  A token ``t`` that ends at ``i`` is
``e(i)`` exactly if BPE leaves the pair ``e(i - len(t)), t`` as it is, and
then ``count(i) = count(i - len(t)) + cost(t)``.  So a state holds, for each position
from which a piece may still be running, the characters since then, the last token
before it and the relative count: finitely many, since pieces are short.  States are
made when first reached; the table is bounded and starts anew when full.

No merge crosses two characters that are adjacent in no piece: there the transducer is
back in its start state.  The state map of a chunk is thus what it holds before its
first and after its last such place, and the count between.  Maps compose associatively,
and the chunks of a long text are composed by a pairwise scan.

Defined results: null counts as empty, and empty texts have no token; repeated rows
count alike; other columns pass through, clashing ones are replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcast.llm.common import annotate

SPACE = "▁"
CHUNK = 1 << 16
# Bounds of what a task remembers; a full table is emptied.
MAX_STATES = 150_000
MAX_UNITS = 400_000
MAX_PAIRS = 150_000

RESULTS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


@dataclass(frozen=True)
class Model:
    """Pieces with their scores, and how a text is prepared."""

    scores: dict[str, float]
    dummy_prefix: bool


def load_model(path: str) -> Model:
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    spec, trainer = proto.normalizer_spec, proto.trainer_spec
    if trainer.model_type != trainer.BPE or not trainer.byte_fallback or spec.precompiled_charsmap:
        raise ValueError("only byte-fallback BPE models without normalisation rules are supported")
    if spec.remove_extra_whitespaces or not spec.escape_whitespaces or trainer.treat_whitespace_as_suffix:
        raise ValueError("the model treats white space in another way")
    if any(p.type == p.USER_DEFINED for p in proto.pieces):
        raise ValueError("user-defined pieces are not supported")
    return Model({p.piece: p.score for p in proto.pieces if p.type == p.NORMAL}, spec.add_dummy_prefix)


class Transducer:
    """Counts tokens; see the module's text."""

    def __init__(self, model: Model):
        self.scores = scores = model.scores
        self.prefixes = {p[:i] for p in scores for i in range(1, len(p))}
        self.joins = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        self.compatible = lru_cache(MAX_PAIRS)(self._compatible)
        self._clear()

    def _clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.contents: list[tuple] = []
        self.moves: list[dict] = []
        self.start = self._state((("", "", 0),))

    def _state(self, content: tuple) -> int:
        known = self.states.get(content)
        if known is None:
            known = self.states[content] = len(self.contents)
            self.contents.append(content)
            self.moves.append({})
        return known

    def _cost(self, token: str) -> int:
        return 1 if token in self.scores else len(token.encode())

    def merge(self, text: str) -> list[str]:
        """BPE of a short text: the best-scored neighbours merge first, leftmost among equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, left: str, right: str) -> bool:
        return self.merge(left + right) == [left, right]

    def _move(self, state: int, char: str) -> tuple[int, int]:
        """The next state, and by how much the token count changes."""
        content = self.contents[state]
        seen = content[-1][1]
        if seen and seen[-1] + char not in self.joins:
            state_after = self._step(self.start, char)
            self.moves[state][char] = state_after
            return state_after
        running, last, change = [], None, 0
        for since, before, ahead in content:
            token = since + char
            if last is None and (token in self.scores or len(token) == 1):
                if not before or self.compatible(before, token):
                    last, change = token, self._cost(token) - ahead
            if token in self.prefixes:
                running.append((token, before, ahead))
        if last is None:
            raise ValueError(f"no encoding ends with {char!r}")
        after = (*((u, e, n + change) for u, e, n in running), ("", last, 0))
        move = self._state(after), change
        self.moves[state][char] = move
        return move

    def _step(self, state: int, char: str) -> tuple[int, int]:
        return self.moves[state].get(char) or self._move(state, char)

    def run(self, text: str) -> int:
        """Tokens of a text; where no piece can join two characters the start state returns."""
        if len(self.contents) > MAX_STATES:
            self._clear()
        state, count, moves = self.start, 0, self.moves
        for char in text:
            move = moves[state].get(char) or self._move(state, char)
            state = move[0]
            count += move[1]
        return count


class Units(dict):
    """Token counts of words, remembered, since words come again; emptied when full."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, text: str) -> int:
        count = self.transducer.run(text)
        if len(text) < 64:
            if len(self) >= MAX_UNITS:
                self.clear()
            self[text] = count
        return count


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does from any state: ``head`` and ``tail`` are open, ``count`` is closed.

    ``whole`` means that the chunk has no place where the state is known, and is all head.
    """

    head: str
    count: int = 0
    tail: str = ""
    whole: bool = False


class Counter:
    """Counts the tokens of texts as they are."""

    def __init__(self, model: Model):
        self.transducer = Transducer(model)
        self.unit = Units(self.transducer).__getitem__
        self.prefix = SPACE if model.dummy_prefix else ""
        before_space = {p for p in self.transducer.joins if p[1] == SPACE and p[0] != SPACE}
        newline = any("\n" in p for p in model.scores)
        if before_space or newline:
            raise ValueError("a piece holds a space after another character, or a line end")
        self.word = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")

    def chunk(self, text: str) -> ChunkMap:
        """State map of a chunk of prepared text."""
        words = self.word.findall(text)
        if len(words) < 2:
            return ChunkMap(text, whole=True)
        return ChunkMap(words[0], sum(map(self.unit, words[1:-1])), words[-1])

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.whole and b.whole:
            return self.chunk(a.head + b.head) if len(self.word.findall(a.head[-1:] + b.head[:1])) > 1 else ChunkMap(a.head + b.head, whole=True)
        if a.whole:
            return ChunkMap(a.head + b.head, b.count, b.tail)
        if b.whole:
            return ChunkMap(a.head, a.count, a.tail + b.head)
        return ChunkMap(a.head, a.count + self.unit(a.tail + b.head) + b.count, b.tail)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """All maps composed, in pairs: the order of a parallel scan."""
        while len(maps) > 1:
            pairs = [self.compose(*maps[i : i + 2]) for i in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[len(maps) - len(maps) % 2 :]
        return maps[0]

    def count(self, text: str) -> int:
        if not text:
            return 0
        prepared = self.prefix + text.replace(" ", SPACE)
        cuts = range(0, len(prepared), CHUNK)
        whole = self.scan([self.chunk(prepared[i : i + CHUNK]) for i in cuts])
        return self.unit(whole.head) + whole.count + self.unit(whole.tail)


def count_tokens(docs: DataFrame, model_path: str, *, text_column: str = "text", limit: int = 4096) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` to every row."""
    # The compiled model is a fixed vocabulary, read once on the driver.
    model = docs.sparkSession.sparkContext.broadcast(load_model(model_path))

    def task():
        counter = Counter(model.value)

        def work(texts: Iterator[bytes]) -> dict:
            out = {"n_bytes": [], "n_tokens": []}
            for text in texts:
                out["n_bytes"].append(len(text))
                out["n_tokens"].append(counter.count(text.decode("utf-8", "replace")))
            return out

        return work

    found = annotate(docs, text_column, RESULTS, task)
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
