"""Quality classifier with hierarchical empirical Bayes over hosts and their paths.

Evidence of a document is the calibrated probability that it is good: that of quality
times that of no toxic words, from models trained on a bounded sample of labelled rows.  Grouped
sums of it give every host a posterior rate around the global one, and every path of a
host a posterior around its host's; how strongly sparse sites shrink is estimated from
how much sites differ.  A document's odds are multiplied by those of its path against the
global rate, without its own share in them.

``host`` and ``path`` are columns; for documents the source and the language stand for
them.  Null hosts are one host, null paths one path of their host.  Null and empty texts
are judged like other texts (the models see no word); repeated rows are judged alike but
count separately in the sums; without labels, all have the same evidence and nothing is
rejected; an empty table gives an empty result; other columns pass through, clashing ones
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcast.llm.common import annotate, column
from rollcast.llm.linear import SAMPLE_ROWS, features, fit_models
from rollcast.sources.scratch import store

EVIDENCE = T.StructType([T.StructField("p_doc", T.DoubleType())])
RESULTS = ("p_doc", "p_host", "p_path", "p_good", "kept")

# Prior strengths, in documents, stay between these.
WEAKEST, STRONGEST = 2.0, 1e6


def _odds(p: Column) -> Column:
    safe = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(safe / (1 - safe))


def _strength(sites: DataFrame, rate: Column, around: Column) -> float:
    """Prior strength by moments: how far site rates spread beyond what their sizes explain.

    ``sites`` has ``n`` documents, ``s`` their summed evidence and ``q`` their summed squares.
    """
    spread = F.sum(F.col("n") * (rate - around) ** 2)
    inside = F.sum(F.greatest(F.lit(0.0), F.col("q") - F.col("s") ** 2 / F.col("n")))
    row = sites.agg(
        spread.alias("spread"), inside.alias("inside"), F.sum("n").alias("n"), F.count("*").alias("sites"),
        F.sum(F.col("n").cast("double") ** 2).alias("n2"), (F.sum("s") / F.sum("n")).alias("mean"),
    ).first()
    if not row["sites"] or row["sites"] < 2 or row["n"] <= row["sites"]:
        return STRONGEST
    within = row["inside"] / (row["n"] - row["sites"])
    size = row["n"] - row["n2"] / row["n"]
    between = (row["spread"] - (row["sites"] - 1) * within) / max(size, 1e-9)
    if between <= 0:
        return STRONGEST
    return min(STRONGEST, max(WEAKEST, row["mean"] * (1 - row["mean"]) / between - 1))


def classify(
    docs: DataFrame, labels: DataFrame, *, text_column: str = "text", id_column: str = "doc_id",
    host_column: str = "source", path_column: str = "lang", quality_column: str = "quality",
    toxic_column: str = "toxic", sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``p_doc, p_host, p_path, p_good, kept``; ``columns`` limits what passes through."""
    good = {quality_column: lambda v: v > 0, toxic_column: lambda v: v <= 0}
    fitted = fit_models(docs, labels, good, id_column=id_column, text_column=text_column, sample_rows=sample_rows)
    models = docs.sparkSession.sparkContext.broadcast(fitted)

    def task():
        good, clean = (m.scorer() for m in models.value)

        def work(texts: Iterator[bytes]) -> dict:
            found = (features(t) for t in texts)
            return {"p_doc": [float(good(*f) * clean(*f)) for f in found]}

        return work

    kept = [c for c in (docs.columns if columns is None else columns) if c not in RESULTS]
    seen = docs.select(
        F.struct(*[column(c).alias(c) for c in kept]).alias("__kept"),
        column(host_column).cast("string").alias("__host"), column(path_column).cast("string").alias("__path"),
        column(text_column).cast("string").alias("__body"),
    )
    # Texts are scored once; later steps read the stored scores.
    scored = store(annotate(seen, "__body", EVIDENCE, task).drop("__body"))

    p = F.col("p_doc")
    paths = store(
        scored.groupBy("__host", "__path").agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q"))
    )
    total = paths.agg((F.sum("s") / F.sum("n")).alias("rate")).first()["rate"]
    mean = F.lit(0.5 if total is None else float(total))
    hosts = paths.groupBy("__host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    host_strength = _strength(hosts, F.col("s") / F.col("n"), mean)
    hosts = hosts.select(
        F.col("__host").alias("__h"), ((F.col("s") + mean * host_strength) / (F.col("n") + host_strength)).alias("p_host")
    )
    paths = store(paths.join(hosts, F.col("__host").eqNullSafe(F.col("__h"))).drop("__h"))
    path_strength = _strength(paths, F.col("s") / F.col("n"), F.col("p_host"))
    sites = paths.select(
        F.col("__host").alias("__h"), F.col("__path").alias("__p"), "p_host", F.col("n").alias("__n"), F.col("s").alias("__s")
    )
    # Sites are a stored table, so Spark broadcasts it only if it is small.
    same = F.col("__host").eqNullSafe(F.col("__h")) & F.col("__path").eqNullSafe(F.col("__p"))
    others = (F.col("__s") - p + F.col("p_host") * path_strength) / (F.col("__n") - 1 + path_strength)
    joined = scored.join(sites, same, "left").withColumn("p_path", others)
    log_odds = _odds(p) + _odds(F.col("p_path")) - _odds(mean)
    return joined.select(
        *[F.col("__kept").getField(c).alias(c) for c in kept], "p_doc", "p_host", "p_path",
        (1 / (1 + F.exp(-log_odds))).alias("p_good"), (log_odds >= _odds(F.lit(float(threshold)))).alias("kept"),
    )
