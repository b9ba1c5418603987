"""A corpus from raw documents: five stages, each over all rows that the one before kept.

Quality classifier (rejected documents go), SimHash near-duplicates (one document of each
group stays, the one with the smallest id), benchmark decontamination (contaminated
documents go), personal data (texts are sanitised), and the mix of sources (how many
words it takes of every document).  Each stage's result is written as Parquet and read
again; files go to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcast.llm import decontamination, mixing, nearcopies, privacy, quality
from rollcast.llm.common import column
from rollcast.sources.scratch import store


# Document columns keep their values whatever names the operators give their results.
_MARK = "doc:"


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select(*[column(c).alias(f"{_MARK}{c}") for c in docs.columns])


def _unmarked(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[column(f"{_MARK}{c}").alias(c) for c in docs.columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", f"{_MARK}doc_id")
    found = quality.classify(_marked(docs), labels, host_column=f"{_MARK}source", path_column=f"{_MARK}lang",
                             text_column=f"{_MARK}text", id_column=f"{_MARK}doc_id", columns=_marked(docs).columns)
    return _unmarked(found.where("kept"), docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies by SimHash of five-word shingles, verified; one document of each component stays.

    Verified are a Jaccard similarity of 0.8 or more, over all candidates.
    """
    found = nearcopies.near_copies(_marked(docs), text_column=f"{_MARK}text", id_column=f"{_MARK}doc_id")
    return _unmarked(found.where("first"), docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.find_contamination(_marked(docs), benchmark, text_column=f"{_MARK}text")
    return _unmarked(found.where("NOT contaminated"), docs)


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data; a null text becomes empty, and n_chars follows the text."""
    found = privacy.sanitise(_marked(docs), text_column=f"{_MARK}text", id_column=f"{_MARK}doc_id")
    found = found.withColumn(f"{_MARK}text", F.col("clean_text"))
    if "n_chars" in docs.columns:
        size = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn(f"{_MARK}n_chars", size)
    return _unmarked(found, docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every document left."""
    return mixing.mix(docs).withColumnRenamed("id", "doc_id")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("SimHash near-duplicates", without_near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("personal data", sanitised),
    ("mix of sources", mixed),
]

# The first two stages train a model and hash with XXH64, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; every stage's result is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
