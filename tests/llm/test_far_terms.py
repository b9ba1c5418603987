"""Terms that disclose an entity go wherever its documents have them."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from rollcast.llm import privacy


def test_terms_far_from_the_mention(spark):
    far = " ".join(["about the case and all the rest"] * 12)
    shared = [(i, f"quokka calls kim@park.org {far} Quokka, wombat {far} 李明 again") for i in range(4)]
    other = [(50 + i, f"{far} something else entirely {i}") for i in range(40)] + [(99, "quokka alone")]
    found = privacy.sanitise(spark.createDataFrame(shared + other, "doc_id long, text string"))
    rows = {r["doc_id"]: r for r in found.collect()}
    for i, text in shared:
        clean = rows[i]["clean_text"]
        assert "wombat" not in clean and "uokka" not in clean and "李明" not in clean
        assert far in clean and "[EMAIL]" in clean
        for s in rows[i]["spans"][1:]:
            assert text[s["start"] : s["end"]].lower() in ("quokka", "calls", "wombat", "李明", "again")
    assert all(rows[i]["clean_text"] == t for i, t in other)


def brute_terms(rows, support=3, generalise=0.75, remove=0.9):
    """Every pair of entity and term counted, over all rows; spans of the terms that disclose."""
    emails = [{m.lower() for m in re.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", t)} for _, t in rows]
    words = [[(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]{3,}", t)] for _, t in rows]
    entities, terms, pairs = Counter(), Counter(), Counter()
    for held, own in zip(emails, words):
        own = {w for w, _, _ in own}
        entities.update(held)
        terms.update(own)
        pairs.update((e, t) for e in held for t in own)
    n = len(rows)

    def disclosure(e, t):
        if pairs[e, t] < support or entities[e] == n:
            return 0.0
        return math.log(n * pairs[e, t] / entities[e] / terms[t]) / math.log(n / entities[e])

    out = []
    for (_, text), held, own in zip(rows, emails, words):
        base = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]
        found = []
        for word, a, b in own:
            d = max((disclosure(e, word) for e in held), default=0.0)
            if d >= generalise and not any(x < b and a < y for x, y in base):
                found.append((a, b, "remove" if d >= remove else "generalise"))
        out.append(found)
    return out


def test_terms_against_all_pairs(spark):
    draw = random.Random(11)
    people = [f"p{i}@park.org" for i in range(12)]
    hints = {p: [f"hint{i}of{k}" for k in range(3)] for i, p in enumerate(people)}
    rows = []
    for i in range(150):
        words = [f"common{draw.randrange(30)}" for _ in range(15)]
        for p in draw.sample(people, draw.choice([0, 0, 1, 2, 5])):
            words += [p, *[h for h in hints[p] if draw.random() < 0.9]]
        words += [h for p in people for h in hints[p] if draw.random() < draw.choice([0.01, 0.09])]
        draw.shuffle(words)
        rows.append((i, " ".join(words)))
    # A list that three documents share, and a repeated row.
    rows += [(200 + i, " ".join(f"m{k}@club.org Member{k} {1900 + k}" for k in range(40))) for i in range(3)]
    rows += [rows[0], (300, "")]
    expected = brute_terms(rows)
    found = privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_row = {(r["doc_id"], r["text"]): [(s["start"], s["end"], s["action"]) for s in r["spans"] if s["kind"] == 4] for r in found}
    assert len(found) == len(rows)
    for row, spans in zip(rows, expected):
        assert by_row[row] == spans
    assert {a for spans in expected for _, _, a in spans} == {"remove", "generalise"}


def test_classes_of_terms(spark):
    words = spark.createDataFrame([("1984",), ("47321",), ("7",), ("B52",), ("NATO",), ("Kim",), ("quokka",), ("李明",)], "w string")
    classes = [r[0] for r in words.select(privacy._general(F.col("w"))).collect()]
    assert classes == ["[1980s]", "[40000-49999]", "[7-7]", "[CODE]", "[ACRONYM]", "[NAME]", "[WORD]", "[WORD]"]


def test_long_member_lists_stay_linear(spark):
    """800 addresses and 2,000 words that always occur together are one class each."""
    text = " ".join([f"user{i}@club.org" for i in range(800)] + [f"term{i}" for i in range(2000)])
    docs = spark.createDataFrame([(i, text) for i in range(3)] + [(10 + i, f"filler {i}") for i in range(20)], "doc_id long, text string")
    rows = docs.selectExpr("CAST(doc_id AS STRING) AS id", "xxhash64(text) AS h", "text")
    mentions = privacy.find_mentions(rows, "text").where("size(mentions) > 0")
    found = privacy._evidence(mentions, rows, "text", 3, 0.75)
    assert found.pairs.count() == 1 and found.together.count() == 3
    clean = {r["doc_id"]: r["clean_text"] for r in privacy.sanitise(docs).collect()}
    assert "term" not in clean[0] and "user" not in clean[0] and clean[10] == "filler 0"
