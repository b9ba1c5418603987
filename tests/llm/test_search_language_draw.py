"""Ranked search, language of spans and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcast.llm import language, ranking, resampling

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))


def clashing(frame, *names):
    return frame.withColumns({n: F.lit("other") for n in (*names, "id", "body", "n", "row", "a.b")})


# Ranked search


def brute_search(docs, items, top=10):
    texts = [(i, Counter(words(t)), len(words(t))) for i, t in docs if words(t)]
    n_docs, n_terms = len(texts), sum(n for _, _, n in texts)
    found = []
    for item, query in items:
        scores = []
        for place, (i, own, n) in enumerate(texts):
            m, score = 100 - 90 + 90 * n * n_docs // n_terms, 0
            for term in set(words(query)):
                if own[term]:
                    df = sum(term in o for _, o, _ in texts)
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += w * (1_000_000_000 * own[term] // (1000 * own[term] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i))
        found += [(item, rank, s[2], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:top], 1)]
    return sorted(found, key=repr)


def searched(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "id", "score").collect()), key=repr)


def crowd(seed, count):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 30)))) for i in range(count)]


@pytest.mark.parametrize("segment_rows", [16_384, 7])
@pytest.mark.parametrize("block_bytes", [8_000_000, 100])
def test_search_many_ties(spark, segment_rows, block_bytes):
    docs = crowd(1, 150) + [(200 + i, t) for i, t in crowd(1, 40)] + [(3, crowd(1, 4)[3][1])]
    items = [(i, " ".join(f"w{j}" for j in range(i, 40, 7))) for i in range(7)] + [(7, "W0 w0, w1?"), (8, None), (9, "!"), (9, "w39")]
    found = ranking.search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
        spark.createDataFrame(items, "item_id long, text string"), segment_rows=segment_rows, block_bytes=block_bytes,
    )
    assert searched(found) == brute_search(docs, items)


def test_search_awkward(spark, awkward):
    docs = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    items = [(1, "word1x0 WORD2x0 start"), (None, "ok 中文 no id"), (2, ""), (3, "nothing of it")]
    found = ranking.search(clashing(awkward, "score", "rank"), spark.createDataFrame(items, "item_id long, text string"))
    assert searched(found) == brute_search(docs, items)


def test_search_empty(spark, empty, awkward):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranking.search(empty, items).count() == 0
    assert ranking.search(awkward, items.where("false")).count() == 0


def test_segment_reads_less_than_everything():
    """Reading stops early where ten documents stand out, with the same result."""
    rng = np.random.default_rng(3)
    terms = np.repeat([0, 1], 5000)
    places = np.concatenate((np.arange(5000), np.arange(5000)))
    impacts = rng.integers(1, 50, 10000)
    impacts[:20] += 1_000_000
    impacts[5000:5020] += 1_000_000
    segment = ranking.Segment(terms, places, impacts, 5000)
    found, scores = segment.best(np.array([0, 1], np.int32), 10)
    total = impacts[:5000] + impacts[5000:]
    expected = np.lexsort((np.arange(5000), -total))[:10]
    assert found.tolist() == expected.tolist() and scores.tolist() == total[expected].tolist()
    assert segment.best(np.array([0, 1], np.int32), 10, int(scores[0]))[0].size == 0


# Language


def test_best_paths_against_all_paths():
    rng = np.random.default_rng(1)
    for penalty in (0.5, 2.0):
        counts = [1, 4, 6, 2, 6]
        text = np.repeat(np.arange(len(counts)), counts)
        scores = rng.normal(size=(len(text), 3))
        scores[4, 1] = -np.inf
        path = language.best_paths(scores, text, penalty)
        for i in range(len(counts)):
            own = np.flatnonzero(text == i)

            def value(states):
                return sum(scores[w, s] for w, s in zip(own, states)) - penalty * sum(a != b for a, b in zip(states, states[1:]))

            best = max(value(p) for p in product(range(3), repeat=len(own)))
            assert value(path[own].tolist()) == pytest.approx(best)


TALK = {
    "en": "the quick brown fox jumps over the lazy dog while everything there was nothing with them",
    "de": "der schnelle braune fuchs springt über den faulen hund während nichts schön größer wäre",
    "ru": "быстрая коричневая лиса прыгает через ленивую собаку пока ничего не было",
    "el": "η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(t, k) for k, t in TALK.items()] * 3 + [("ignored text", None), (None, "xx")]
    return language.learn(spark.createDataFrame(rows, "text string, lang string"))


def test_counts_are_of_all_rows(spark, model):
    """Probabilities by hand: single letters of the English rows."""
    assert model.languages == sorted(TALK)
    words_ = language.Words.of([b"e"], language._characters())
    bucket = int(words_.grams(np.array([0]), 1, model.buckets)[0][0])
    letters = TALK["en"].replace(" ", "")
    share = (3 * letters.count("e") + 0.5) / (3 * len(letters) + 0.5 * model.buckets)
    assert model.tables[0][bucket, model.languages.index("en")] == pytest.approx(math.log(share), abs=1e-5)


def test_mixed_text_gives_spans(spark, model):
    text = "Nothing over THE lazy dog. Der faule Hund springt über den Fuchs! быстрая лиса, 123"
    found = language.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    parts = [(s["language"], text[s["start"] : s["end"]]) for s in found["spans"]]
    assert [p[0] for p in parts] == ["en", "de", "ru"]
    assert parts[1][1] == "Der faule Hund springt über den Fuchs" and parts[2][1] == "быстрая лиса"
    letters = Counter()
    for name, part in parts:
        letters[name] += sum(c.isalpha() for c in part)
    best = max(letters, key=letters.get)
    assert found["language"] == best and found["score"] == pytest.approx(letters[best] / sum(letters.values()))


def test_script_rules_languages_out(spark, model):
    found = language.identify(spark.createDataFrame([(1, "fox лиса"), (2, "𠀀中文")], "doc_id long, text string"), model)
    rows = {r["doc_id"]: r for r in found.collect()}
    assert [s["language"] for s in rows[1]["spans"]][1] == "ru"
    assert rows[2]["language"] in TALK and rows[2]["spans"][0]["end"] == 3


def test_language_awkward(spark, awkward, empty, model):
    found = language.identify(clashing(awkward, "language", "spans", "score"), model)
    assert found.columns[-3:] == ["language", "score", "spans"] and found.count() == awkward.count()
    for row in found.collect():
        has_letter = any(c.isalpha() for c in row["text"] or "")
        assert (row["language"] in TALK) == has_letter and (row["language"] == "und") != has_letter
        assert 0 <= row["score"] <= 1
    assert language.identify(empty, model).count() == 0
    nothing = language.learn(empty)
    assert {r["language"] for r in language.identify(awkward, nothing).collect()} == {"und"}


def test_batches_do_not_matter(model):
    texts = [TALK["en"] + " " + TALK["de"], "", TALK["ru"] * 5, "x", TALK["el"]]
    tables = language._characters()
    together = language._label([t.encode() for t in texts], model, 3.0, tables)
    for i, t in enumerate(texts):
        alone = language._label([t.encode()], model, 3.0, tables)
        assert alone["language"][0] == together["language"][i] and alone["spans"][0] == together["spans"][i]


# Resampling


@pytest.mark.parametrize("order", [1, 2, 3])
def test_gram_crcs(order):
    for text in ("Hello, wörld 12 the quick-brown é", "", "one", "a b " * 500, "x" * 70_000 + " end and more"):
        crcs, lengths = resampling.running_crcs(text.encode())
        own = words(text)
        expected = [zlib.crc32(b" ".join(own[i : i + order])) for i in range(max(0, len(own) - order + 1))]
        assert resampling.gram_crcs(crcs, lengths, order).tolist() == expected


def brute_draw(docs, target, orders, buckets, least, percent, seed):
    def grams(text):
        own = words(text)
        return [zlib.crc32(b" ".join(own[i : i + o])) % buckets for o in range(1, orders + 1) for i in range(len(own) - o + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(grams(text))
    for text in target:
        t.update(grams(text))
    all_s, all_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))

    out = []
    for i, text in docs:
        own = grams(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, own))
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("orders", [1, 3])
def test_draw(spark, orders):
    docs = crowd(2, 300) + [(i, t) for i, t in crowd(2, 300)[:20]]
    target = ["w0 w1 w2 w30 w31", None, "", "w39 w39"]
    found = resampling.resample(
        clashing(spark.createDataFrame(docs, "doc_id long, text string"), "rank", "weight").repartition(4),
        spark.createDataFrame([(t,) for t in target], "text string"), orders=orders, buckets=97, least_words=10, percent=30,
    )
    rows = sorted((tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert rows == brute_draw(docs, target, orders, 97, 10, 30, 2024)


def test_draw_awkward(spark, awkward, empty):
    docs = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    target = spark.createDataFrame([("ok no id here",)], "text string")
    found = resampling.resample(awkward, target, least_words=1, percent=50)
    rows = sorted((tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert rows == brute_draw(docs, ["ok no id here"], 1, 10_000, 1, 50, 2024)
    assert set(awkward.columns) <= set(found.columns)
    assert resampling.resample(empty, target).count() == 0
    assert resampling.resample(awkward, target.where("false")).count() == len(docs)


def test_nothing_left_out_when_the_sketch_is_short(spark):
    """All scores equal but for noise, and a full draw: every eligible row gets a rank."""
    docs = [(i, "a b c") for i in range(50)]
    found = resampling.resample(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("a",)], "text string"),
        least_words=1, percent=100,
    )
    assert sorted(r["rank"] for r in found.collect()) == list(range(1, 51))
