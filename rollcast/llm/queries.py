"""The corpus queries ``opN_<name>`` and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcast.llm import (
    decontamination, language, mixing, privacy, quality, ranking, resampling, rules, simhash, substrings, suffix_index, tokens, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    # Only what the result needs is kept beside the fingerprints.
    return simhash.near_duplicates(docs.select("doc_id", "text"), keep=["doc_id"]).drop("first")


@query()
def op2_privacy(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = privacy.sanitise(docs, keep=["doc_id"])
    kinds = F.array(*map(F.lit, (*privacy.KINDS, "term")))

    def joined(spans):
        named = F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"]))
        return F.array_join(named, ",")

    base = F.filter("spans", lambda s: s["action"] == "mask")

    def count(i: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(privacy.KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query(
    """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                      regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    x AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS s
          FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
    h AS (SELECT r, i FROM x JOIN (SELECT s FROM x GROUP BY s HAVING count(*) > 1) USING (s)),
    g AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM h),
    u AS (SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d),
    k AS (SELECT r, count(*) AS n, string_agg(w[j], ' ' ORDER BY j) AS s FROM u ANTI JOIN g USING (r, j) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
           sha256(coalesce(s, '')) AS kept_sha256
    FROM d LEFT JOIN k USING (r)
    """
)
def op3_substrings(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = substrings.remove_repeats(docs, keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    """
    WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
    f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
           CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
    FROM p LEFT JOIN f USING (d)
    """
)
def op4_warc_captures(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.page_captures(table(spark, folder, "pages"))
    return found.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.col("metadata.fields").getItem("refers_to").cast("long").alias("refers_to"),
    )


@query()
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    return quality.classify(docs, table(spark, folder, "labels"), columns=["doc_id", "source", "lang"])


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS6 = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS6} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS6} AS w FROM benchmark),
    p AS (SELECT DISTINCT item_id, least(len(w), 13) AS k,
                 array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s
          FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
    k AS (SELECT DISTINCT k FROM p),
    x AS (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS s
          FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
    h AS (SELECT r, i, x.k, item_id FROM x JOIN p ON x.k = p.k AND x.s = p.s),
    n AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM h) GROUP BY r),
    t AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256,
           coalesce(n.n, 0) > 0 AND 20 * coalesce(n.n, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
    """
)
def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query()
def op7_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mixing.mix(docs).withColumnRenamed("id", "doc_id")


@query()
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = tokens.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query()
def op9_suffix_index(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = suffix_index.remove_repeats(docs, keep=["doc_id"])
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query()
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return rules.judge(docs, table(spark, folder, "labels")).drop("text")


@query(
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS6} AS w FROM documents),
    q AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_WORDS6}) AS w FROM benchmark),
    t AS (SELECT q, unnest(w) AS term FROM q),
    g AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
    p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) SEMI JOIN t USING (term) GROUP BY ALL),
    f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
          FROM p, g GROUP BY term, n_docs),
    m AS (SELECT r, doc_id, 100 - 90 + ((90 * len(w) * n_docs) // n_terms) AS m FROM d, g WHERE len(w) > 0),
    s AS (SELECT q, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
          FROM t JOIN f USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY q, r),
    o AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank
          FROM s JOIN d USING (r) WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o JOIN q USING (q) WHERE rank <= 10
    """
)
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = ranking.search(docs, table(spark, folder, "benchmark"))
    return found.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


@query()
def op12_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    # Rows without an id have no remainder: nothing is learned from them.
    learn = F.col("doc_id").isNotNull() & ~held_out & F.col("lang").isNotNull()
    model = language.learn(docs.where(learn))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("language").alias("lang_pred"), "score")


@query(
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS6} AS w FROM documents),
    x AS (SELECT r, unnest(w) AS g FROM d),
    y AS (SELECT unnest({_WORDS6}) AS g FROM benchmark),
    k AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i:
                 CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS k),
    u AS (SELECT g, list_transform(range(len(hex(g)) // 2),
                                   lambda i: CAST('0x' || substr(hex(g), 2 * i + 1, 2) AS BIGINT)) AS bytes
          FROM (SELECT g FROM x UNION SELECT g FROM y)),
    b AS (SELECT g, xor(list_reduce(bytes, lambda c, v: xor(c // 256, k[xor(c, v) % 256 + 1]), 4294967295), 4294967295)
                    % 10000 AS bucket FROM u, k),
    s AS (SELECT bucket, count(*) AS s FROM x JOIN b USING (g) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM y JOIN b USING (g) GROUP BY bucket),
    a AS (SELECT (SELECT count(*) FROM x) AS s_all, (SELECT count(*) FROM y) AS t_all),
    v AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + 10000) /
                                              ((s + 1.0::DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain
          FROM s LEFT JOIN t USING (bucket), a),
    w AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS weight FROM x JOIN b USING (g) JOIN v USING (bucket) GROUP BY r),
    o AS (SELECT r, doc_id, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight,
                 CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
          FROM d LEFT JOIN w USING (r)),
    z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score,
                 10 * (SELECT count(*) FROM o WHERE n >= 20) // 100 AS drawn FROM o),
    e AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n >= 20)
    SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score,
           CAST(CASE WHEN rank <= drawn THEN rank END AS BIGINT) AS rank FROM z LEFT JOIN e USING (r)
    """
)
def op13_importance(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = resampling.resample(docs, table(spark, folder, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_features", "weight", "score", "rank")
