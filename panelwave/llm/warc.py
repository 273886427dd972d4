"""WARC archives: write captures as request, response (or revisit) and metadata records, read and assemble them."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from panelwave.operators.sizing import ensure_checkpoint_dir, ship_package

EOL = "\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: an archive file holds one shuffle partition at most, and no more captures than this
FILE_CAPTURES = 20_000
BATCH_BYTES = 4 << 20

RECORD = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("record_id", T.StringType()),
    T.StructField("concurrent_to", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("uri", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("http", T.StringType()),
    T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("sound", T.BooleanType()),
])


def base32(sha1: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: five hex digits at a time make four base32 digits."""
    digits = []
    for i in range(8):
        value = F.conv(F.substring(sha1, 5 * i + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(ALPHABET), F.shiftright(value, s).bitwiseAND(31) + 1, 1) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def _urn(*parts: Column | str) -> Column:
    """urn:uuid made from the MD5 of the parts."""
    h = F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: Column | str, record_id: Column, fields: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """One record without the two line ends that follow it; a field without a value is left out."""
    head = [F.lit("WARC/1.1" + EOL), F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit(EOL)]
    for name, value in [("WARC-Record-ID", record_id), *fields, ("Content-Type", F.lit(content_type)),
                        ("Content-Length", F.octet_length(block).cast("string"))]:
        head.append(F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(EOL)), F.lit("")))
    return F.concat(*head, F.lit(EOL), block)


def roles(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (null as empty), payload_bytes, digest and first (the payload's smallest page_id).

    The digest and the smallest id are found on narrow rows first; then the pages join that table once by digest. One
    payload may hold a third of all rows: the first step combines before it shuffles, the join is one that Spark can
    split (one row on its other side).
    """
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "[\r\n]+", " ").alias("url"),
        F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumns({"sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    first = rows.groupBy("sha1").agg(F.min("page_id").alias("first"))
    out = rows.join(first, "sha1").withColumn("digest", base32(F.col("sha1")))
    return out.withColumn("first", F.when(F.col("payload_bytes") >= min_bytes, F.col("first")).otherwise(F.col("page_id")))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip", **names) -> None:
    """Write each page as three records of a gzipped WARC file under path: request, response or revisit, metadata.

    The row with the smallest page_id of a payload is its response, the others revisit it and carry no payload; rows
    that repeat that smallest id are responses too; where every id of a payload is null, all are responses. Line ends
    in a url become spaces. Every row has a request id of its own, to which its other records are concurrent.
    """
    rows = roles(pages, **names)
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    owner = F.coalesce(F.col("first").cast("string"), F.lit("null"))
    revisit = ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.withColumns({
        "revisit": revisit, "request_id": _urn("request", page, F.monotonically_increasing_id().cast("string")),
        "response_id": F.when(revisit, _urn("revisit", page, F.monotonically_increasing_id().cast("string")))
        .otherwise(_urn("response", page, F.col("digest"))),
        "refers": F.when(revisit, _urn("response", owner, F.col("digest"))),
    })
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    near = [*common, ("WARC-Concurrent-To", F.col("request_id"))]
    target = F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*([^#]*)", 1)
    get = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(f" HTTP/1.1{EOL}Host: "),
                   F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1), F.lit(EOL + EOL))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(EOL + EOL))
    body = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload").cast("string"))
    records = F.array(
        _record("request", F.col("request_id"), common, "application/http; msgtype=request", get),
        _record(F.when(F.col("revisit"), "revisit").otherwise("response"), F.col("response_id"), [
            *near, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), ("WARC-Refers-To", F.col("refers")),
            ("WARC-Profile", F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ], "application/http; msgtype=response", F.concat(http, body)),
        _record("metadata", _urn("metadata", F.col("request_id")), near, "application/warc-fields",
                F.concat(F.lit("page_id: "), page, F.lit(EOL))),
    )
    rows.select(F.explode(records).alias("value")).write.option("lineSep", EOL + EOL).option(
        "compression", compression).option("maxRecordsPerFile", 3 * FILE_CAPTURES).text(path)


class _Feed:
    """Bytes of an archive file, inflated as they are asked for; a gzipped file may have any number of members."""

    def __init__(self, content: bytes):
        self.raw, self.at, self.held, self.input = memoryview(content), 0, bytearray(), b""
        self.inflate = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None

    def more(self, want: int = 1 << 20) -> bool:
        """Add up to want bytes to held; False at the end."""
        while True:
            if not self.input:
                self.input = bytes(self.raw[self.at : self.at + (1 << 16)])
                self.at += len(self.input)
            ended = not self.input
            if self.inflate is None:
                piece, self.input = self.input, b""
            else:
                piece = self.inflate.decompress(self.input, want)
                if self.inflate.eof:
                    self.input, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
                else:
                    self.input = self.inflate.unconsumed_tail
            self.held += piece
            if piece or ended:
                return bool(piece)


def _headers(block: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in block.decode("utf-8", "replace").split(EOL)[1:]:
        name, _, value = line.partition(":")
        out.setdefault(name.strip().lower(), value.strip())
    return out


def parse(content: bytes) -> Iterator[dict]:
    """Records of one archive file, plain or gzipped (one member or many); a cut last record is left out."""
    feed, start = _Feed(content), 0
    while True:
        while (stop := feed.held.find(b"\r\n\r\n", start)) < 0:
            if not feed.more():
                return
        head = _headers(bytes(feed.held[start:stop]).lstrip(b"\r\n"))
        size = int(head.get("content-length") or 0)
        while len(feed.held) < stop + 4 + size:
            if not feed.more(max(1 << 20, size)):
                return
        block = bytes(feed.held[stop + 4 : stop + 4 + size])
        start = stop + 4 + size
        while len(feed.held) < start + 4 and feed.more():
            pass
        start += 4
        if start > 1 << 20:
            del feed.held[:start]
            start = 0
        kind = head.get("warc-type")
        digest = (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        http, payload, length, sound = None, block, len(block), None
        if head.get("content-type", "").startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            http = top.decode("utf-8", "replace")
            length = len(payload)
            if kind == "revisit":
                length = int(_headers(top).get("content-length") or 0)
            elif digest:
                sound = base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
        yield {
            "type": kind, "record_id": head.get("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to"),
            "refers_to": head.get("warc-refers-to"), "uri": head.get("warc-target-uri"), "date": head.get("warc-date"),
            "payload_digest": digest, "http": http, "payload": None if kind == "revisit" else payload,
            "payload_bytes": length, "sound": sound,
        }


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under path; a file is read by one task and inflated piece by piece."""
    ship_package(spark)
    arrow = to_arrow_schema(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for content in batch.column(0):
                for r in parse(content.as_py()):
                    rows.append(r)
                    size += 600 + len(r["payload"] or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: request, response (response or revisit) and metadata structs, joined by concurrent-to ids.

    A record without a concurrent-to id is its capture's anchor, the others name that anchor, so all records of a
    capture share one key and meet in one shuffle. A capture that lacks a record has null there; of records of one kind
    in a capture that with the smallest id is taken. page_id comes from the metadata record. Payloads nobody asks for
    are not shuffled: they are columns of their own until the last projection.
    """
    head = F.struct("type", "record_id", "refers_to", "uri", "date", "payload_digest", "http", "payload_bytes", "sound")
    kind = F.when(F.col("type") == "revisit", "response").otherwise(F.col("type"))
    keyed = records.select(F.coalesce("concurrent_to", "record_id").alias("capture"), kind.alias("kind"), head.alias("head"),
                           "record_id", "payload")
    kinds = ("request", "response", "metadata")
    own = lambda k: F.when(F.col("kind") == k, F.col("record_id"))
    wide = keyed.groupBy("capture").agg(
        *[F.min_by("head", own(k)).alias(k) for k in kinds], *[F.min_by("payload", own(k)).alias(f"{k}_payload") for k in kinds])
    page = F.regexp_extract(F.col("metadata_payload").cast("string"), "^page_id: (-?[0-9]+)", 1)
    nested = [F.when(F.col(k).isNotNull(), F.col(k).withField("payload", F.col(f"{k}_payload"))).alias(k) for k in kinds]
    return wide.select("capture", F.when(page != "", page.cast("long")).alias("page_id"),
                       F.col("response.type").alias("record_type"), *nested)


def resolve(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page_id of the response a revisit names), sound."""
    flat = captures.select(
        "page_id", F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), "record_type",
        F.col("response.record_id").alias("record_id"), F.col("response.refers_to").alias("refers"),
        F.coalesce("response.sound", F.col("record_type") == "revisit").alias("sound"),
    )
    target = flat.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers")).agg(
        F.min("page_id").alias("refers_to"))
    return flat.join(target, "refers", "left").drop("refers", "record_id")


def archive_path(spark: SparkSession) -> str:
    """A new folder for archives in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages, read the archives back, assemble captures. Null html is an empty payload; null url is empty."""
    path = archive_path(spark)
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return resolve(assemble(read_records(spark, path))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS hex FROM p),
digits AS (SELECT page_id, n, hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
       ((CAST('0x' || substr(hex, 5 * (k // 4) + 1, 5) AS INTEGER) >> (15 - 5 * (k % 4))) & 31) + 1, 1), '' ORDER BY k) AS d
  FROM h, unnest(range(0, 32)) AS u(k) GROUP BY page_id, n, hex),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM digits)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
