"""A content-addressed WARC archive.

Payload bytes are stored once, by SHA-256; the exact header bytes of every record stand in a table of their own. A record is
rebuilt by a join of both, and its payload is checked against both digests. Payloads of at least ``least`` bytes that
several pages share are in the response of the largest ``page_id``; the others are revisit records, whose
bytes end with their headers.

Cases: a null html is an empty payload, a null url is written as ``urn:x-page:none``. Line breaks in a url are
percent-encoded in its header. A null ``page_id`` is written as an empty id and read back as null; it is never referred to.
Rows that repeat a ``page_id`` with equal payloads are records of their own of the same type. Of a tie in payloads the
largest id is the response. Extra columns of pages are not archived.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import release, shared_dir, stored

LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _uri(url: Column) -> Column:
    return F.coalesce(F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("urn:x-page:none"))


def _lines(*parts: Column) -> Column:
    """Header lines (null ones left out) and the empty line that ends them."""
    return F.concat(F.concat_ws("\r\n", *parts), F.lit("\r\n\r\n"))


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """One row for each record: digests, type and the page referred to; nothing of the payload is shuffled."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    facts = stored(pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha2(payload, 256).alias("sha256"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("bigint").alias("size")))
    owners = stored(facts.groupBy("sha256").agg(F.max("page_id").alias("owner")))
    revisit = (F.col("size") >= least) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    return facts.join(owners, "sha256").withColumn("refers_to", F.when(revisit, F.col("owner")))


def headers(records: DataFrame) -> DataFrame:
    """``sha256``, ``bare`` (a record without payload) and the exact bytes before the payload, of each record of ``plan``."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    bare = F.col("refers_to").isNotNull()
    http = _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), line("Content-Length", F.col("size").cast("string")))
    length = F.octet_length(http) + F.when(bare, 0).otherwise(F.col("size"))
    warc = _lines(
        F.lit("WARC/1.1"), line("WARC-Type", F.when(bare, "revisit").otherwise("response")), line("WARC-Record-ID", _name(F.col("page_id"))), F.lit(f"WARC-Date: {DATE}"),
        line("WARC-Target-URI", _uri(F.col("url"))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(bare, line("WARC-Refers-To", _name(F.col("refers_to")))), F.when(bare, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"), line("Content-Length", length.cast("string")),
    )
    return records.select("sha256", bare.alias("bare"), F.encode(F.concat(warc, http), "UTF-8").alias("head"))


def write_archive(pages: DataFrame, path: str, least: int = LEAST) -> str:
    """Writes ``path``/headers and ``path``/payloads; returns ``path``."""
    records = stored(plan(pages, least))
    headers(records).write.parquet(f"{path}/headers")
    holders = records.filter("page_id <=> owner").select("page_id", "sha256").distinct()
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    # without this digest a row that repeats an id with another payload would be taken for its holder
    own = own.withColumn("sha256", F.sha2("payload", 256))
    held = own.join(holders, ["page_id", "sha256"], "left_semi")
    nameless = own.filter("page_id is null").join(records.filter("owner is null").select("sha256").distinct(), "sha256", "left_semi")
    held = held.unionByName(nameless.select(*held.columns))
    once = held.withColumn("k", F.row_number().over(W.partitionBy("sha256").orderBy("page_id"))) if _repeats(records) else held.withColumn("k", F.lit(1))
    once.filter("k = 1").select("sha256", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def _repeats(records: DataFrame) -> bool:
    """Whether a payload has several rows of its largest id (or only rows without id), which must be stored once."""
    return bool(records.filter("page_id <=> owner").groupBy("sha256").count().filter("count > 1").limit(1).count())


def records_of(spark: SparkSession, path: str) -> DataFrame:
    """Each record's exact bytes, rebuilt: ``record``, and ``payload`` of the page, which a revisit's bytes do not hold."""
    heads, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    end = F.encode(F.lit("\r\n\r\n"), "UTF-8")
    body = F.when(F.col("bare"), F.lit(b"")).otherwise(F.col("payload"))
    return heads.join(payloads, "sha256", "left").select(F.concat("head", body, end).alias("record"), F.when(F.col("bare"), F.col("payload")).alias("apart"), "sha256")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """The named WARC fields (lower-case names, ``version`` first) and the block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {"version": version} | {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')} does not end after its {size} bytes")
    return fields, rest[:size]


def _id(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for b in batches:
        rows = []
        for record, apart, sha256 in zip(*(c.to_pylist() for c in b.columns), strict=True):
            fields, block = parse(record)
            _, _, payload = block.partition(b"\r\n\r\n")
            payload = apart if fields["warc-type"] == "revisit" else payload
            sha1 = hashlib.sha1(payload).hexdigest()
            if hashlib.sha256(payload).hexdigest() != sha256 or fields["warc-payload-digest"] != f"sha1:{sha1}":
                raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
            rows.append((_id(fields["warc-record-id"]), fields["warc-target-uri"], len(payload), sha1, fields["warc-type"], _id(fields.get("warc-refers-to"))))
        columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record, parsed from its rebuilt bytes, its payload checked."""
    return records_of(spark, path).mapInArrow(_read, READ)


def archived(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``pages`` written to an archive in the shared folder and read back."""
    spark = pages.sparkSession
    path = write_archive(pages, shared_dir(spark), least)
    release(spark)
    return read_archive(spark, path)
