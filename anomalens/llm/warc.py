"""A content-addressed WARC archive.

``write_archive`` keeps every distinct payload once, under its SHA-256, and the exact
header block of every record apart. Of records with equal payloads the one with the
smallest id is the response, the others are revisits that refer to it; payloads below
``least`` bytes are always responses. ``read_archive`` joins headers and payloads to
the original records and verifies the digests; ``write_warc`` and ``read_warc`` put
records into WARC files and back.

Defined cases: a null payload is empty; a null id comes after all others; of records
that agree in id and payload exactly one is the response; a null URL is written
empty, and blanks and line ends in a URL are percent-escaped in the header; empty
tables give an archive without records.
"""

from __future__ import annotations

import base64
import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from anomalens.llm.common import text_of

_FILE_BYTES = 32 << 20
BROADCAST_ROWS = 1_000_000
_END = "\r\n\r\n"
# Fixed by the format: version line, field names and the revisit profile.
_VERSION = "WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
RECORD = ("record_id string, record_type string, uri string, date string, payload_digest string, refers_to string, "
          "payload_bytes bigint, payload binary")


@F.pandas_udf(T.StringType())
def base32_sha1(hexed):
    """Upper-case base32 of a hexadecimal digest."""
    return hexed.map(lambda h: base64.b32encode(bytes.fromhex(h)).decode(), na_action="ignore")


def _record_name(id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(id.cast("string"), F.lit("")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html",
                  least: int = 0) -> None:
    """Write ``path/headers`` and ``path/payloads`` (sha256, bytes, payload).

    Headers need digests only. Payloads then stay where they are read: the rows that
    repeat one are known, and up to ``BROADCAST_ROWS`` of them are sent to all tasks;
    beyond that payloads meet by digest. The row numbers behind this need a table that
    is scanned alike twice, as files are; a store without exactly one payload for each
    digest is refused."""
    body = text_of(payload).cast("binary")
    rows = pages.select(F.col(id).alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("payload"),
                        F.sha2(body, 256).alias("sha256"), F.sha1(body).alias("sha1"),
                        F.octet_length(body).cast("bigint").alias("bytes"),
                        F.monotonically_increasing_id().alias("rid"))
    narrow = rows.drop("payload")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("rid"))
    first = narrow.groupBy("sha256").agg(F.min(order).alias("first"))
    kind = F.when((F.col("bytes") < least) | (F.col("rid") == F.col("first.rid")), "response").otherwise("revisit")
    heads = narrow.join(first, "sha256").withColumn("kind", kind)
    revisit = F.col("kind") == "revisit"
    head = F.concat(
        F.lit(f"{_VERSION}\r\nWARC-Type: "), F.col("kind"),
        F.lit("\r\nWARC-Record-ID: "), _record_name(F.col("id")),
        F.lit("\r\nWARC-Target-URI: "), F.regexp_replace(F.regexp_replace("url", r"[\r\n]", "%0A"), " ", "%20"),
        F.lit(f"\r\nWARC-Date: {_DATE}\r\nWARC-Payload-Digest: sha1:"), base32_sha1(F.col("sha1")),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "),
                                 _record_name(F.col("first.id")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.lit("\r\nContent-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string")))
    heads.select("id", "rid", "kind", "sha256", "sha1", "bytes", (F.col("rid") == F.col("first.rid")).alias("first"),
                 head.alias("header")).write.mode("overwrite").parquet(f"{path}/headers")
    spark = pages.sparkSession
    heads = spark.read.parquet(f"{path}/headers")
    again = heads.filter("NOT first").select("rid")
    if again.count() <= BROADCAST_ROWS:
        store = rows.join(F.broadcast(again), "rid", "left_anti").select("sha256", "payload", "bytes")
    else:
        store = rows.groupBy("sha256").agg(F.first("payload").alias("payload"), F.first("bytes").alias("bytes"))
    store.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")
    kept = spark.read.parquet(f"{path}/payloads").select("sha256")
    one = kept.groupBy("sha256").count().filter("count > 1").isEmpty()
    if not one or kept.count() != heads.filter("first").count():
        raise ValueError("the table was not scanned alike twice; write it to files first")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The original records: ``id``, ``kind``, ``bytes``, ``header`` and ``payload``
    (of revisits too). Fails on a payload that does not have its digest."""
    store = spark.read.parquet(f"{path}/payloads")
    sound = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("bytes"))
    store = store.select("sha256", F.when(sound, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256")))).alias("payload"))
    return spark.read.parquet(f"{path}/headers").join(store, "sha256").select(
        "id", "kind", "bytes", "header", "payload")


def write_warc(spark: SparkSession, archive: str, path: str) -> None:
    """Write the archive's records as WARC files (gzip) of about 32 MB of records each.
    Only responses fetch their payload; the join deals them out by digest, and every
    task writes what it has joined."""
    heads = spark.read.parquet(f"{archive}/headers")
    store = spark.read.parquet(f"{archive}/payloads").select("sha256", "payload")
    answer = heads.filter("kind = 'response'").join(store, "sha256").select(
        "header", F.col("payload").cast("string").alias("body"))
    again = heads.filter("kind = 'revisit'").select("header", F.lit("").alias("body"))
    size = heads.agg(F.sum(F.when(F.col("kind") == "response", F.col("bytes")).otherwise(0)
                           + F.octet_length("header"))).first()[0] or 0
    each = max(1, int(_FILE_BYTES * heads.count() // max(size, 1)))
    records = answer.unionByName(again).select(F.concat("header", F.lit(_END), "body").alias("value"))
    (records.write.mode("overwrite").option("maxRecordsPerFile", each)
     .option("lineSep", _END).option("compression", "gzip").text(path))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the WARC files below ``path`` (schema ``RECORD``). Payloads of
    responses are checked against their digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")
    return files.mapInArrow(_parse_files, RECORD)


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "record_type", "uri", "date", "payload_digest", "refers_to", "payload_bytes", "payload"]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]
    for batch in batches:
        for content in batch.column(0):
            rows: list[tuple] = []
            size = 0
            for record in parse(gzip.open(io.BytesIO(content.as_py()))):
                rows.append(record)
                size += record[6]
                if size > _FILE_BYTES:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def parse(stream) -> Iterator[tuple]:
    """The records of one uncompressed WARC stream."""
    import hashlib

    while line := stream.readline():
        if line.strip() == b"":
            continue
        if line.strip().decode() != _VERSION:
            raise ValueError(f"no WARC record: {line[:80]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        body = stream.read(int(fields["content-length"]))
        digest = fields["warc-payload-digest"].partition(":")[2]
        if fields["warc-type"] == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
            raise ValueError(f"damaged record {fields['warc-record-id']}")
        yield (fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri", ""), fields["warc-date"],
               digest, fields.get("warc-refers-to"), int(fields["x-payload-length"]), body)
