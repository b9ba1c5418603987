"""Corpus operators against brute force, on small and awkward tables."""

import hashlib
import random
import re
from collections import Counter

import ahocorasick  # noqa: F401 - the scan needs it
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from rollcast.llm import (
    decontamination, mixing, privacy, quality, rules, simhash, substrings, suffix_index, tokens, warc,
)
from rollcast.llm.linear import fit

SPACES = rb"[^\x20\x09-\x0D]+"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def tuples(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def clashing(frame, *names):
    return frame.withColumns({n: F.lit("other") for n in (*names, "row", "key", "a.b")})


# SimHash


def brute_print(text):
    words = re.findall(SPACES, (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def test_near_duplicates_awkward(awkward):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    roots = brute_components({brute_print(t) for _, t in rows})
    least = {}
    for i, t in rows:
        ids = least.setdefault(roots[brute_print(t)], [])
        ids += [] if i is None else [i]
    expected = sorted(
        ((i, f"{brute_print(t):016x}", min(least[roots[brute_print(t)]], default=None)) for i, t in rows), key=repr
    )
    found = simhash.near_duplicates(clashing(awkward, "fingerprint", "first"))
    assert tuples(found, "doc_id", "fingerprint", "component_id") == expected
    assert found.where("first").count() == len(least)


@pytest.mark.parametrize("cell_rows", [2000, 5])
def test_links_of_a_dense_ball(spark, cell_rows):
    """A crowd of near fingerprints, cut into parts, keeps its components."""
    draw = random.Random(5)
    centre, prints = draw.getrandbits(64), set()
    while len(prints) < 150:
        prints.add(centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 4))))
    prints |= {draw.getrandbits(64) for _ in range(50)}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    links = simhash.link(spark.createDataFrame([(s,) for s in signed.values()], "print long"), cell_rows)
    found = dict(map(tuple, simhash.components(links).collect()))
    classes = Counter(found.get(s, s) for s in signed.values())
    assert sorted(classes.values()) == sorted(Counter(brute_components(prints).values()).values())


# Personal data

CHECKS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(re.sub(r"\D", "", v)) <= 19 and luhn(re.sub(r"\D", "", v))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15),
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute_spans(text):
    return [
        (k, m.start(), m.end()) for k, (pattern, good) in enumerate(CHECKS.values())
        for m in re.finditer(pattern, text or "") if good(m.group())
    ]


def test_base_spans(spark, awkward):
    texts = [
        "a@b.c+x@d.e é 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 a@b a.b@c@d.ef 4111 1111 1111 1111 +1 (234) 567-8901. +123",
        "4111-1111-1111-1111 1.2.3 " + "1" * 3000 + " " + "1." * 900 + "a@b" + ".c" * 1500, "me@x.org " * 600, "+49 1.2.3.4 5555 end",
    ]
    docs = awkward.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"), True)
    found = privacy.sanitise(clashing(docs, "spans", "base"))
    for row in found.select("text", "spans").collect():
        assert [(s["kind"], s["start"], s["end"]) for s in row["spans"] if s["kind"] < 4] == brute_spans(row["text"])
    assert found.count() == docs.count()


def test_terms_that_disclose(spark):
    shared = [(i, f"agent quokka calls kim@park.org about the case number {i}") for i in range(6)]
    other = [(50 + i, f"the case about something else entirely {i}") for i in range(40)]
    found = privacy.sanitise(spark.createDataFrame(shared + other, "doc_id long, text string"))
    rows = {r["doc_id"]: r for r in found.collect()}
    assert "kim" not in rows[0]["clean_text"] and "quokka" not in rows[0]["clean_text"]
    assert "[EMAIL]" in rows[0]["clean_text"] and "about the case" in rows[0]["clean_text"]
    assert all(rows[i]["clean_text"] == t for i, t in other)

    # The disclosure is the one of the formula.
    docs = spark.createDataFrame(shared + other, "doc_id long, text string").withColumn("h", F.lit(1))
    mentions = privacy.find_mentions(docs, "text").where("size(mentions) > 0")
    measured = {(r["entity"], r["term"]): r["disclosure"] for r in privacy.disclosures(mentions, docs, "text").collect()}
    n, e = 46, 6
    for term, holders in (("quokka", 6), ("about", 46), ("number", 6)):
        assert measured["email:kim@park.org", term] == pytest.approx(np.log(n * e / (e * holders)) / np.log(n / e))


# Passages of words and strings of bytes


def brute_words(rows, width):
    words = [re.findall(SPACES, (t or "").encode()) for _, t in rows]
    count = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {k for a in range(len(w) - width + 1) if count[tuple(w[a : a + width])] > 1 for k in range(a, a + width)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group_rows", [10_000, 2])
def test_repeated_words(awkward, group_rows):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    found = substrings.remove_repeats(clashing(awkward, "n_words", "spans", "id", "h"), group_rows=group_rows)
    assert tuples(found, "doc_id", "n_words", "n_removed", "kept_text") == brute_words(rows, 35)


def brute_bytes(rows, width):
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - width + 1):
            if b[a : a + width] in seen:
                gone[a : a + width] = True
            seen.add(b[a : a + width])
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i, t] = (i, len(b), int(gone.sum()), runs, np.frombuffer(b, np.uint8)[~gone].tobytes())
    return sorted((out[r] for r in rows), key=repr)


@pytest.mark.parametrize("group_rows, batches", [(20_000, 4), (2, 3), (20_000, 1)])
def test_repeated_bytes(spark, awkward, group_rows, batches):
    more = spark.createDataFrame([(20, "ab" * 300), (21, "q" + "ab" * 99 + LONG), (22, LONG[:150] + "!")], "doc_id long, text string")
    docs = awkward.unionByName(more, True)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = suffix_index.remove_repeats(clashing(docs, "n_bytes", "seed"), group_rows=group_rows, batches=batches)
    got = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes").collect()), key=repr)
    assert got == brute_bytes(rows, 100)


@pytest.mark.parametrize("group_rows", [4, 30])
def test_frequent_passages_in_varied_text(spark, group_rows):
    draw = random.Random(5)
    own = lambda n: "".join(draw.choice("abcdefghijklmnop ") for _ in range(n))
    rows = [(i, own(150) + LONG[:180] + own(150)) for i in range(60)] + [(100 + i, "z" * (150 + i)) for i in range(40)]
    spans = suffix_index.repeated_spans(
        spark.createDataFrame(rows, "id long, text string").withColumn("h", F.xxhash64("text")), group_rows=group_rows
    )
    # No window of a frequent passage is a row of its own.
    assert "Generate" not in spans._jdf.queryExecution().toString()
    found = suffix_index.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), group_rows=group_rows)
    got = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in found.drop("text").collect()), key=repr)
    assert got == brute_bytes(rows, 100)


@pytest.mark.parametrize("last", [False, True])
def test_copies_are_told_by_document(spark, last):
    """Copies of frequent entries make a row per document, not one each."""
    at = [(i, 200 * k) for i in (7, None, 3, 5) for k in range(6)] + [(3, 0)]  # a repeated row's entry
    rows = [(start // 400, i, 0 if i else 1, start, bytes([start // 400]) * 100) for i, start in at]
    entries = spark.createDataFrame(rows, "seed long, id long, h long, start long, content binary")
    found = suffix_index._equal_windows(entries) if last else suffix_index._distinct(entries)[1]
    got = [(r["id"], r["h"], sorted(map(tuple, r["spans"]))) for r in found.collect()]
    later = [(start, start + 100) for start in range(0, 1200, 200)]
    expected = [(3, 0, later[1::2]), (5, 0, later), (7, 0, later), (None, 1, later)]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_lines_over_and_over_are_short_entries(spark, monkeypatch):
    """A stretch that repeats itself has its period's windows once, in each round."""
    line, entries, split = "a line of twenty-nine bytes.\n", [], suffix_index._distinct

    def counted(frequent):
        entries.append(frequent.agg(F.count("*"), F.sum(F.length("content"))).first())
        return split(frequent)

    monkeypatch.setattr(suffix_index, "_distinct", counted)
    rows = [(i, line[i % 7 :] + line * (20 + i)) for i in range(25)] + [(30, "z" * 500 + line * 9 + "z" * 300 + "yx" * 400)]
    found = suffix_index.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), group_rows=20)
    got = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in found.drop("text").collect()), key=repr)
    assert got == brute_bytes(rows, 100)
    assert entries
    assert all(n <= 3 * len(rows) and size <= 200 * n for n, size in entries)


LONG = "".join(random.Random(1).choice("abcdefgh ") for _ in range(400))


def test_levels_merge_geometrically(spark):
    docs = spark.createDataFrame([(i, LONG[i : i + 150]) for i in range(8)], "doc_id long, text string")
    family = suffix_index.IndexFamily()
    entries = docs.select(F.lit(1).cast("long").alias("seed"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("h"),
                          F.lit(0).cast("long").alias("start"), F.col("text").cast("binary").alias("content"))
    sizes = []
    for i in range(4):
        family.add(entries.where(f"id in ({2 * i}, {2 * i + 1})"))
        sizes.append([n for n, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4]]


# Web archives


def test_archives(spark, tmp_path):
    big = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n é</p>"
    rows = [(1, "http://a.org/x", big), (2, None, big), (2, None, big), (3, "https://b.org", "tiny"), (4, "u", "tiny"),
            (5, "u", None), (6, "u", ""), (None, "u", big), (7, "h\r\nx: y", "y" * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit(1))
    found = warc.page_captures(pages).select(
        F.col("page_id").cast("long"), F.col("response.payload_bytes"), F.col("response.payload_digest"), "response.kind",
        F.col("metadata.fields")["refers_to"].cast("long"),
    )
    expected = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = html == big and i != 1
        expected.append((i, len(data), sha(data), "revisit" if again else "response", 1 if again else None))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert warc.page_captures(pages.limit(0)).count() == 0


def test_a_capture_is_whole(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x?y=1", "<b>é</b>")], "page_id long, url string, html string")
    row = warc.page_captures(pages).first()
    assert bytes(row["response"]["http"]).endswith("\r\n\r\n<b>é</b>".encode())
    assert bytes(row["request"]["http"]).startswith(b"GET / HTTP/1.1\r\nHost: a.org")
    assert row["url"] == "http://a.org/x?y=1" and row["metadata"]["fields"]["page_id"] == "1"


# Benchmark


def brute_hits(text, items):
    word = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = re.findall(word, (text or "").encode().lower())
    hit, found = set(), set()
    for item, t in items:
        q = re.findall(word, (t or "").encode().lower())
        for a in range(max(1, len(q) - 12) if q else 0):
            pattern = q[a : a + 13]
            for b in range(len(w) - len(pattern) + 1):
                if w[b : b + len(pattern)] == pattern:
                    hit |= set(range(b, b + len(pattern)))
                    found.add(item)
    return len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block_words", [2_000_000, 12])
def test_decontamination(spark, awkward, block_words):
    question = "What is the Answer to the big question of life the universe and everything else, Frank?"
    items = [(1, question), (2, "short one"), (2, "éa bé"), (3, None), (4, ""), (None, "no id"), (5, " ".join(LOREM_WORDS[5:30]))]
    more = [(30, "Say: WHAT is the answer-to the big question of life, the universe and everything? Short one."), (31, "éa, bé no id " + "pad " * 200)]
    docs = awkward.unionByName(spark.createDataFrame(more, "doc_id long, text string"), True)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_contamination(clashing(docs, "items", "n_hit"), benchmark, block_words=block_words)
    for row in found.select("text", "n_words", "n_hit", "items", "contaminated", "spans").collect():
        assert tuple(row[1:5]) == brute_hits(row["text"], items)
    spans = found.where("doc_id = 30").first()["spans"]
    assert more[0][1][spans[0]["start"] : spans[0]["end"]].startswith("WHAT is")
    assert found.count() == docs.count()
    assert decontamination.find_contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0


LOREM_WORDS = [f"word{i % 97}x{i // 7}" for i in range(120)]


# Mixing


def test_mix(spark, awkward):
    rows = [(i, "w " * (i % 40 + 1), f"s{i % 7}") for i in range(700)] + [(9000, "big " * 5000, "s0"), (9001, "lone", "z"), (9002, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    assert sorted(r["id"] for r in found) == sorted(r[0] for r in rows)
    sizes, targets, taken = Counter(), {}, Counter()
    for r in found:
        sizes[r["source"]] += r["size"]
        targets[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, expected = 1.5 * sum(sizes.values()), {}
    while True:  # share again whatever the full ones cannot take
        open_ = [s for s in names if s not in expected]
        full = [s for s in open_ if left * weights[s] / sum(weights[o] for o in open_) > 2 * sizes[s]]
        if not full:
            expected |= {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
            break
        expected |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
    for s in names:
        assert targets[s] == pytest.approx(expected[s])
        assert abs(taken[s] - targets[s]) <= 64
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, found), key=repr)
    assert mixing.mix(clashing(awkward, "size", "target", "number")).count() == awkward.count()


def test_pieces_make_whole_blocks(spark):
    docs = spark.createDataFrame([(i, "w " * 50, "ab"[i % 2]) for i in range(100)], "doc_id long, text string, source string")
    pieces, _, _ = mixing.mix_blocks(docs)
    per_slot = [r["n"] for r in pieces.groupBy("slot").agg(F.sum("n_words").alias("n")).collect()]
    assert Counter(per_slot).most_common(1)[0][0] == 64 and max(per_slot) == 64


# Tokens


def test_tokens(spark, awkward):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    draw = random.Random(3)
    odd = ["<s></s><0x0A>", "  a  b ", "▁▁ a", "\n\n x", "    " * 5 + "def f():\n\treturn 1", "😀é中" * 30, "aaa bbb" * 20000, "x" * 70000]
    odd += ["".join(draw.choice("ab ▁\n,.'é1 the") for _ in range(draw.randint(1, 60))) for _ in range(300)]
    docs = awkward.unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"), True)
    for row in tokens.count_tokens(clashing(docs, "n_tokens"), path).collect():
        text = row["text"] or ""
        n = len(library.encode(text))
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len(text.encode()), n, n > 4096), text[:60]


def test_chunks_compose():
    counter = tokens.Counter(tokens.load_model(public_tokenizers.path("piece_bpe_32k.model")))
    text = "▁the▁quick▁▁brown\nfox" * 40
    for size in (1, 3, 7, 50):
        whole = counter.scan([counter.chunk(text[i : i + size]) for i in range(0, len(text), size)])
        direct = counter.chunk(text)
        for m in (whole, direct):
            assert not m.whole
        total = [counter.unit(m.head) + m.count + counter.unit(m.tail) for m in (whole, direct)]
        assert total[0] == total[1]


# Classifiers


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(9)
    good = [f"term{draw.randint(0, 400)}" for _ in range(4000)]
    rows, labels = [], []
    for i in range(600):
        bad, toxic = i % 5 == 0, i % 7 == 0
        words = [draw.choice(good) for _ in range(draw.randint(30, 80))]
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words.insert(draw.randint(0, 20), draw.choice(["idiot", "scum"]))
        rows.append((i, " ".join(words), "en", f"h{i % 3}", 1))
        labels.append((i, int(not bad), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    held = {i: (q, t) for i, q, t in labels if i % 2}
    known = spark.createDataFrame([r for r in labels if not r[0] % 2] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    return table, known, held


def accuracy(found, held):
    rows = [r for r in found.select("doc_id", "kept").collect() if r["doc_id"] in held]
    return np.mean([r["kept"] == (held[r["doc_id"]] == (1, 0)) for r in rows])


def test_quality_held_out(labelled, awkward, empty):
    table, known, held = labelled
    assert accuracy(quality.classify(clashing(table, "p_doc", "kept"), known), held) > 0.95
    assert quality.classify(awkward, known).count() == awkward.count()
    assert quality.classify(awkward, known.limit(0)).where("kept").count() == awkward.count()
    assert quality.classify(empty, known).count() == 0


def test_sites_shrink_toward_the_rest(spark, labelled):
    table, known, _ = labelled
    moved = table.withColumn("source", F.when(F.col("doc_id") % 5 == 0, "bad").otherwise("good"))
    found = quality.classify(moved, known)
    rate = {r["source"]: r["p"] for r in found.groupBy("source").agg(F.avg("p_host").alias("p")).collect()}
    raw = {r["source"]: r["p"] for r in found.groupBy("source").agg(F.avg("p_doc").alias("p")).collect()}
    assert raw["bad"] < rate["bad"] < rate["good"] < raw["good"]


def test_rules_held_out(labelled, awkward, empty):
    table, known, held = labelled
    assert accuracy(rules.judge(clashing(table, "n_words", "kept"), known), held) > 0.95
    assert rules.judge(empty, known).count() == 0
    for row in rules.judge(awkward, known.limit(0)).collect():
        text = row["text"] or ""
        words = re.findall(SPACES, text.encode())
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        repeated = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in text.split("\n") if re.search(SPACES, x.encode())]
        n = len(words)
        failed = n < 10 or 100 * len(repeated) > 20 * n
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")) == (
            n, sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(repeated), failed, not failed,
        )


def test_fit_of_one_kind():
    none = (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))
    assert fit([none] * 3, np.ones(3)).scorer()(*none) > 0.99
    assert fit([none] * 3, np.zeros(3)).scorer()(*none) < 0.01
    assert fit([], np.zeros(0)).scorer()(*none) > 0.99


@pytest.mark.parametrize("operator", [
    lambda d: simhash.near_duplicates(d), lambda d: privacy.sanitise(d), lambda d: substrings.remove_repeats(d),
    lambda d: suffix_index.remove_repeats(d), lambda d: mixing.mix(d),
    lambda d: tokens.count_tokens(d, public_tokenizers.path("piece_bpe_32k.model")),
])
def test_empty_tables(empty, operator):
    assert operator(empty).count() == 0
