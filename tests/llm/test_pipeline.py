"""The pipeline against plain versions of its stages."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from rollcast.llm import quality  # noqa: E402
from tests.llm.test_corpus import brute_hits, brute_spans  # noqa: E402
from tests.llm.test_near_copies import brute_roots  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are missing")


def stage(spark, name, docs):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, FOLDER)


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = stage(spark, "quality classifier", docs)
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in quality.classify(docs, labels).where("kept").collect()}
    assert set(by_id(good)) == kept

    single = stage(spark, "SimHash near-duplicates", good)
    # The stage links by the exact Jaccard similarity of five-word shingles.
    roots = brute_roots([(i, r["text"]) for i, r in by_id(good).items()])
    assert set(by_id(single)) == set(roots.values())

    clean = stage(spark, "benchmark decontamination", single)
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    expected = {i for i, r in by_id(single).items() if not brute_hits(r["text"], items)[3]}
    assert set(by_id(clean)) == expected

    private = stage(spark, "personal data", clean)
    before, after = by_id(clean), by_id(private)
    assert set(before) == set(after) and private.columns == docs.columns
    for i, row in after.items():
        spans = brute_spans(before[i]["text"])
        assert not [s for s in brute_spans(row["text"]) if s[0] == 0]
        assert row["n_chars"] == len(row["text"])
        if not spans:
            assert row["text"] == before[i]["text"]

    mix = by_id(stage(spark, "mix of sources", private))
    assert set(mix) == set(after)


def test_awkward_documents(spark, awkward):
    docs = awkward.withColumn("kept", F.lit(1)).withColumn("spans", F.lit("s")).withColumn("first", F.lit(None).cast("int"))
    columns = docs.columns
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.store(function(spark, docs, FOLDER))
        assert docs.columns == columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count()


def test_empty_documents(spark, empty):
    docs = empty
    for _, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.store(function(spark, docs, FOLDER))
        assert docs.count() == 0
