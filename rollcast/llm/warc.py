"""Web archives: pages written as WARC records, read back and assembled into captures.

Every page becomes three records: a request, a response (or a revisit of an equal
payload) and a metadata record.  Request and metadata name the response in
``WARC-Concurrent-To``.  The archives are gzipped WARC files written by Spark's
text writer, since each record ends with two line ends.  The reader splits files by
``Content-Length``, joins the three records of a transaction by those identifiers and
returns one nested row per capture; a revisit gets its payload's size from the
response that it refers to.

Defined results: null html is an empty payload; a null url or page_id is written as a
missing field and read back as null; repeated rows are captures of their own; among
records with equal payloads of ``least_bytes`` or more, those with the smallest page_id
(null counts as largest) are responses; an empty table gives no capture; other columns
are ignored.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcast.llm.common import column
from rollcast.sources.scratch import delete_at_end, shared_folder, store

SHARD_BYTES = 16 << 20
LEAST_BYTES = 100
DATE = "2024-01-01T00:00:00Z"  # pages carry no time

END = "\r\n"
RECORD_END = END + END

RECORDS = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("record_id", T.StringType()),
    T.StructField("concurrent_to", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("block", T.BinaryType()),
])


def _urn(*parts: Column) -> Column:
    digest = F.sha2(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("\x01")) for p in parts]), 256)
    shape = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(digest, a, n) for a, n in shape]), F.lit(">"))


def _record(kind: str | Column, record_id: Column, url: Column, headers: list[Column], block: Column, mime: str) -> Column:
    """Text of one record without the two line ends that close it."""
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind),
        F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        *headers,
        F.lit(f"Content-Type: {mime}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    # concat_ws leaves out null lines.
    return F.concat(F.concat_ws(END, *lines), F.lit(RECORD_END), block)


def write_archives(
    pages: DataFrame, path: str, *, id_column: str = "page_id", url_column: str = "url",
    html_column: str = "html", least_bytes: int = LEAST_BYTES, shard_bytes: int = SHARD_BYTES,
) -> None:
    """Write all pages as WARC files of about ``shard_bytes``."""
    html = F.coalesce(column(html_column).cast("string"), F.lit(""))
    rows = pages.select(
        column(id_column).alias("page_id"),
        F.regexp_replace(column(url_column), r"[\r\n]", "").alias("url"),
        html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size"),
    )
    total = rows.agg(F.sum(F.col("size") + 1000)).first()[0] or 0
    # One row per payload that occurs again; joined by whatever its size allows.
    big = rows.where(F.col("size") >= least_bytes)
    firsts = store(
        big.groupBy(F.col("digest").alias("__digest"))
        .agg(F.min(F.struct(F.isnull("page_id").alias("last"), "page_id", "url")).alias("first"), F.count("*").alias("n"))
        .where("n > 1").drop("n")
    )
    known = rows.join(firsts, F.col("digest") == F.col("__digest"), "left").drop("__digest")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))

    # The copy number tells repeated rows apart; the window needs no other shuffle.  Dealt by
    # all three, since very many pages may share an id (or have none).
    dealt = known.repartition(max(1, -(-total // shard_bytes)), "page_id", "url", "digest")
    same = Window.partitionBy("page_id", "url", "digest").orderBy(F.lit(1))
    dealt = dealt.withColumn("copy", F.row_number().over(same))
    url, digest, page = F.col("url"), F.col("digest"), F.col("page_id")
    response_id = _urn(F.lit("response"), page, url, digest, F.col("copy"))
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-z]+://([^/?#]*)", 1)
    get = F.concat(F.lit("GET / HTTP/1.1" + END + "Host: "), host, F.lit(RECORD_END))
    ok = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{RECORD_END}"
    fields = F.concat_ws(
        END, F.concat(F.lit("page_id: "), page.cast("string")),
        F.when(revisit, F.concat(F.lit("refers_to: "), F.col("first.page_id").cast("string"))), F.lit(""),
    )
    link = F.concat(F.lit("WARC-Concurrent-To: "), response_id)
    payload = F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest)
    first = _urn(F.lit("response"), F.col("first.page_id"), F.col("first.url"), digest, F.lit(1))
    refers = F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), first))
    profile = F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    records = F.array(
        _record("request", _urn(F.lit("request"), response_id), url, [link], get, "application/http; msgtype=request"),
        _record(
            F.when(revisit, "revisit").otherwise("response"), response_id, url, [payload, refers, profile],
            F.concat(F.lit(ok), F.when(revisit, F.lit("")).otherwise(F.col("html"))),
            "application/http; msgtype=response",
        ),
        _record("metadata", _urn(F.lit("metadata"), response_id), url, [link], fields, "application/warc-fields"),
    )
    text = dealt.select(F.explode(records).alias("value"))
    text.write.mode("errorifexists").option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def _split(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in a file."""
    at = 0
    while at < len(content):
        close = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:close].decode().split(END)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        start = close + 4
        stop = start + int(headers["Content-Length"])
        yield headers, content[start:stop]
        at = stop + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in a folder: kind, identifiers, url, digest, block."""
    schema = pa.schema([
        *[(f.name, pa.string()) for f in RECORDS.fields[:-1]], ("block", pa.binary()),
    ])
    names = ["WARC-Type", "WARC-Record-ID", "WARC-Concurrent-To", "WARC-Refers-To", "WARC-Target-URI", "WARC-Payload-Digest"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for headers, block in _split(gzip.decompress(content.as_py())):
                    rows.append((*map(headers.get, names), block))
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``page_id, url, request, response, metadata``."""
    digest = F.regexp_replace("payload_digest", "^sha256:", "")
    main = records.where(F.col("kind").isin("response", "revisit"))
    response = F.struct(
        "record_id", "kind", digest.alias("payload_digest"), "refers_to",
        (F.octet_length("block") - _header_bytes(F.col("block"))).cast("long").alias("payload_bytes"),
        F.col("block").alias("http"),
    )
    main = main.select(F.col("record_id").alias("id"), "url", response.alias("response"))
    request = records.where("kind = 'request'").select(
        F.col("concurrent_to").alias("request_of"), F.struct("record_id", F.col("block").alias("http")).alias("request")
    )
    fields = F.str_to_map(F.trim(F.col("block").cast("string")), F.lit(END), F.lit(": "))
    metadata = records.where("kind = 'metadata'").select(
        F.col("concurrent_to").alias("metadata_of"), F.struct("record_id", fields.alias("fields")).alias("metadata")
    )
    joined = (
        main.join(request, F.col("id") == F.col("request_of"), "left")
        .join(metadata, F.col("id") == F.col("metadata_of"), "left")
    )
    whole = joined.select(
        F.col("metadata.fields").getItem("page_id").alias("page_id"), "url", "request", "response", "metadata"
    )
    # A revisit has the size of the payload that it refers to.
    targets = main.where("response.kind = 'revisit'").select(F.col("response.refers_to").alias("id")).distinct()
    known = store(
        main.select("id", F.col("response.payload_bytes").alias("__bytes")).join(targets, "id", "left_semi").distinct()
    ).withColumnRenamed("id", "__of")
    return (
        whole.join(known, F.col("response.refers_to") == F.col("__of"), "left")
        .withColumn("response", F.col("response").withField("payload_bytes", F.coalesce("__bytes", "response.payload_bytes")))
        .drop("__of", "__bytes")
    )


def _header_bytes(block: Column) -> Column:
    """Bytes of the HTTP header and the empty line after it."""
    return F.expr("position(CAST('\\r\\n\\r\\n' AS BINARY), block)").cast("long") + 3


def page_captures(pages: DataFrame, **options) -> DataFrame:
    """Write the pages into new archives in the shared folder, read them back, assemble captures."""
    spark = pages.sparkSession
    path = shared_folder(spark)
    delete_at_end(spark, path)
    write_archives(pages, path, **options)
    return captures(read_records(spark, path))
