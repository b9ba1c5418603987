"""Near copies by Jaccard similarity against brute force over all pairs."""

import os
import random

import numpy as np
import pytest

from rollcast.llm import nearcopies, simhash


def sets_of(rows, words=5):
    found = {}
    for i, text in rows:
        tokens = (text or "").lower().split()
        found[i] = {" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))} if tokens else set()
    return found


def brute_roots(rows):
    sets, root = sets_of(rows), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and (sets[a] == sets[b] or 5 * both >= 4 * len(sets[a] | sets[b])):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in root}


def planted():
    """Texts, edited copies of several degrees, and a crowd of copies of one text."""
    draw, rows = random.Random(11), []
    for _ in range(80):
        base = [f"w{draw.randrange(5000)}" for _ in range(draw.randint(30, 300))]
        rows.append(base)
        for edits in range(1, 5):
            copy = list(base)
            for at in draw.sample(range(len(copy)), edits):
                copy[at] = f"v{draw.randrange(10**6)}"
            rows.append(copy)
    crowd = [f"c{i}" for i in range(90)]
    rows += [[*crowd[:k], f"x{k}", *crowd[k + 1 :]] for k in range(60)]
    return [(i, " ".join(r)) for i, r in enumerate(rows)] + [(9000, ""), (9001, None), (9002, "two words"), (9003, "Two  words")]


@pytest.mark.parametrize("cell_rows", [2000, 7])
def test_recall_of_planted_copies(spark, cell_rows):
    rows = planted()
    found = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), cell_rows=cell_rows).collect()
    expected = brute_roots(rows)
    assert len(set(expected.values())) < 300
    assert {r["doc_id"]: r["component_id"] for r in found} == expected
    assert {r["doc_id"] for r in found if r["first"]} == set(expected.values())


def fingerprint(words):
    return simhash.fingerprint_of(nearcopies.shingles(" ".join(words).encode()))


def signed(number):
    return int(np.uint64(number).astype(np.int64))


def test_candidates_by_fingerprint(spark):
    base = [f"w{i}" for i in range(2000)]
    prints = [fingerprint(w) for w in (base, [*base[:-1], "x"], [f"v{i}" for i in range(2000)])]
    assert (prints[0] ^ prints[1]).bit_count() <= 3 < (prints[0] ^ prints[2]).bit_count()
    rows = [(i, signed(p)) for i, p in enumerate([*prints, prints[2]])]
    found = nearcopies.fingerprint_links(spark.createDataFrame(rows, "print long, fingerprint long"))
    assert {tuple(r) for r in found.collect()} == {(1, 0), (3, 2)}


def test_cells_compare_fingerprints():
    sketch = bytes(nearcopies.HASHES)
    far = nearcopies.most_different(0.8)
    loads = [p.to_bytes(8, "little") + sketch for p in (0, (1 << far) - 1, (1 << 64) - 1)]
    assert nearcopies._alike(loads, 0.8) == [(1, 0)]
    assert nearcopies._alike([loads[0], loads[2]], 0.8) == []


def test_embedding_is_that_of_the_join(spark):
    numbers = np.array([0, 1, 2, 3, 0x0123456789ABCDEF, (1 << 64) - 1, 1 << 63], np.uint64)
    rows = spark.createDataFrame([(signed(n),) for n in numbers], "print long")
    counts = [r[0] for r in rows.select(simhash._counts(rows["print"])).collect()]
    assert counts == simhash.embedding(numbers).astype(np.int64).tolist()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are missing")
def test_stage_removes_near_copies(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = brute_roots([tuple(r) for r in docs.select("doc_id", "text").collect()])
    found = corpus_pipeline.without_near_duplicates(spark, docs, "/root/testdata/sf0.001")
    assert {r["doc_id"] for r in found.collect()} == set(expected.values())
