"""Small sources of a large mix get all that their targets ask for."""

from collections import Counter

from pyspark.sql import functions as F

from rollcast.llm import mixing


def test_one_document_sources(spark):
    rows = [(i, "w " * 100_000, "big") for i in range(20)] + [(100 + i, "w " * (i + 1), f"s{i:03}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets, taken = {}, Counter()
    for r in mixing.mix(docs).collect():
        targets[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
    assert len(targets) == 151
    assert {s: taken[s] for s in targets} == {s: int(t) for s, t in targets.items()}

    pieces, _, _ = mixing.mix_blocks(docs)
    slots = pieces.groupBy("slot").agg(F.count_distinct("number").alias("sources"), F.sum("n_words").alias("words"))
    assert not slots.where("sources > 1 OR words > 64").count()


def test_schedule_decides_what_is_taken(spark):
    """Slots, taken words and digests against a schedule made by hand."""
    rows = [(i, " ".join(["w"] * n), s) for i, (n, s) in enumerate([(700, "a"), (90, "a"), (1, "a"), (300, "b"), (64, "b"), (5, None), (0, "c")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces, placed, targets = mixing.mix_blocks(docs, block_words=16)
    number = {r["number"]: (-(-int(r["target"]) // 16), int(r["target"]), r["source_size"]) for r in targets.collect()}
    total = sum(b for b, _, _ in number.values())
    step = mixing.step_of(total)
    # Slot after slot: the source its point falls on takes its next block.
    ends, at = [], 0
    for n in sorted(number):
        at += number[n][0]
        ends.append((at, n))
    blocks, taken_blocks = {}, Counter()
    for slot in range(total):
        point = slot * step % total
        n = next(n for end, n in ends if point < end)
        blocks[n, taken_blocks[n]] = slot
        taken_blocks[n] += 1
    assert {n: taken_blocks[n] for n in number} == {n: b for n, (b, _, _) in number.items()}
    # Words of each source's stream, by document and block.
    expected = Counter()
    for r in placed.where("size > 0").collect():
        _, target, size = number[r["number"]]
        for again in range(2):
            for word in range(r["start"] + again * size, min(r["start"] + r["size"] + again * size, target)):
                expected[r["id"], blocks[r["number"], word // 16]] += 1
    found = Counter()
    for r in pieces.collect():
        found[r["id"], r["slot"]] += r["n_words"]
    assert found == expected
    by_doc = Counter()
    for (i, _), n in expected.items():
        by_doc[i] += n
    for r in mixing.mix(docs, block_words=16).collect():
        assert r["taken"] == by_doc[r["id"]]
        assert r["first_slot"] == min((s for i, s in expected if i == r["id"]), default=None)


def test_points_are_spread_evenly():
    """Every run of slots gives each source its share, but for a few."""
    for total in (1, 2, 10, 997, 10_000):
        step = mixing.step_of(total)
        points = [slot * step % total for slot in range(total)]
        assert sorted(points) == list(range(total))
        mine, seen = total // 3, 0
        for slot, point in enumerate(points, 1):
            seen += point < mine
            assert abs(seen - slot * mine / total) < 6
