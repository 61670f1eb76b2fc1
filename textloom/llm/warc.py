"""WARC archives: writing, reading, and resolving repeated payloads into revisit records.

Archives are gzip files that Spark's text writer makes (a record ends in an empty
line pair, which is its line separator), so they go to whatever store Spark can
write. Reading streams each file through zlib, one record at a time.

``dedup_archives`` shuffles record headers only by payload digest, picks the original
of each group of equal payloads, joins the revisit verdicts back to the records
by record id, and writes new archives: originals as ``response`` records, the rest as
``revisit`` records without payload whose fresh headers name the original.
Revisit records that are already in the input keep their digest and length and
point to the original chosen now, if the input has one.

Null payloads are empty, null URLs an empty target, null identifiers the id ``null``.
Rows with the same identifier are records of one id; the larger (id, URL) wins a tie.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
MIN_REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = ("record_id string, record_type string, target_uri string, date string, payload_digest string, "
                 "payload_bytes long, refers_to string, refers_to_uri string, refers_to_date string, payload binary")
_PARSE_BYTES, _BATCH_BYTES = 1 << 20, 8 << 20


def write_archives(records: DataFrame, path: str, max_records: int = 20_000) -> None:
    """Write rows of RECORD_SCHEMA as gzip WARC/1.1 files (``max_records`` per file bounds what a reader opens)."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit(CRLF))
    has = lambda c: F.coalesce(F.col(c), F.lit(""))
    # The length of the full payload stays in the HTTP header, in revisits too.
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit("").cast("binary")).otherwise(F.coalesce("payload", F.lit("").cast("binary")))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.concat(F.lit("<"), has("record_id"), F.lit(">"))),
        line("WARC-Date", F.coalesce(F.col("date"), F.lit(DATE))), line("WARC-Target-URI", F.regexp_replace(has("target_uri"), r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<"), has("refers_to"), F.lit(">"))),
            line("WARC-Refers-To-Target-URI", F.regexp_replace(has("refers_to_uri"), r"[\r\n]", "")),
            line("WARC-Refers-To-Date", F.coalesce(F.col("refers_to_date"), F.lit(DATE))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.length(http) + F.length(body)).cast("string")), F.lit(CRLF))
    (records.select(F.concat(head.cast("binary"), http.cast("binary"), body).cast("string").alias("value"))
     .write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", max_records).text(path))


def _records(raw: Iterator[bytes]) -> Iterator[tuple[dict, bytes]]:
    """Header fields and block of each record of a byte stream."""
    buf, more = bytearray(), True

    def fill(n: int) -> bool:
        nonlocal more
        while more and len(buf) < n:
            piece = next(raw, None)
            if piece is None:
                more = False
            else:
                buf.extend(piece)
        return len(buf) >= n

    while fill(1):
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if not fill(len(buf) + 1):
                raise ValueError("WARC record without the end of its header")
        lines = bytes(buf[:end]).decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size, at = int(fields["content-length"]), end + 4
        if not fill(at + size):
            raise ValueError("WARC record cut short")
        block = bytes(buf[at:at + size])
        fill(at + size + 4)
        del buf[:at + size + 4]
        yield fields, block


def _unzip(content: bytes) -> Iterator[bytes]:
    """Decompressed pieces of a gzip file of any number of members."""
    z, at = zlib.decompressobj(31), 0
    while at < len(content):
        piece = z.decompress(content[at:at + _PARSE_BYTES])
        at = min(at + _PARSE_BYTES, len(content))
        if piece:
            yield piece
        if z.eof:
            at -= len(z.unused_data)
            z = zlib.decompressobj(31)


def _row(fields: dict, block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split(CRLF)[1:])}
    digest = fields.get("warc-payload-digest")
    bare = lambda k: fields[k].strip("<>") if k in fields else None
    return (bare("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-date"),
            digest and digest.removeprefix("sha1:"), int(http.get("content-length", len(payload))), bare("warc-refers-to"),
            fields.get("warc-refers-to-target-uri"), fields.get("warc-refers-to-date"),
            None if fields.get("warc-type") == "revisit" else payload)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all gzip WARC files under ``path`` as RECORD_SCHEMA (payload null where not asked for)."""
    types = [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
             ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()),
             ("refers_to_uri", pa.string()), ("refers_to_date", pa.string()), ("payload", pa.binary())]
    schema = pa.schema(types)

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in _records(_unzip(content.as_py())):
                    row = _row(fields, block)
                    size += len(block) + 500
                    rows.append(row if payloads else (*row[:-1], None))
                    if size > _BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parse, RECORD_SCHEMA)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A response record per page; the payload is the page in UTF-8."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    none = F.lit(None).cast("string")
    return pages.select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("record_id"), F.lit("response").alias("record_type"),
        F.col(url_col).cast("string").alias("target_uri"), F.lit(DATE).alias("date"), F.sha1(payload).alias("payload_digest"),
        F.length(payload).cast("long").alias("payload_bytes"), none.alias("refers_to"), none.alias("refers_to_uri"),
        none.alias("refers_to_date"), payload.alias("payload"))


def record_rank(record_id: str = "record_id"):
    """Order of record ids: their trailing number, then the id itself."""
    return F.struct(F.regexp_extract(record_id, r"(-?\d+)$", 1).try_cast("decimal(38,0)").alias("number"), F.col(record_id).alias("id"),
                    F.coalesce("target_uri", F.lit("")).alias("uri"), F.coalesce("date", F.lit(DATE)).alias("date"))


def resolve_revisits(headers: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(record_id, uri, at, payload_digest, payload_bytes, to_id, to_uri, to_date) for the records that become
    revisits; one record id may come with several payloads or dates. Headers meet by (digest, length); the response with the largest record id is the original."""
    key = ["payload_digest", "payload_bytes"]
    large = headers.where(F.col("payload_bytes") >= min_bytes).select(*key, "record_id", "target_uri", "record_type",
                                                                      record_rank().alias("rank"))
    best = (large.where("record_type = 'response'").groupBy(*key).agg(F.max("rank").alias("best"), F.count("*").alias("n")))
    # Lone responses need no verdict; only groups with something to point elsewhere are joined back.
    return (large.join(best, key).where((F.col("rank") != F.col("best")) | (F.col("record_type") == "revisit"))
            .select("record_id", F.col("rank")["uri"].alias("uri"), F.col("rank")["date"].alias("at"), *key, F.col("best")["id"].alias("to_id"), F.col("best")["uri"].alias("to_uri"),
                    F.col("best")["date"].alias("to_date")).distinct())


def dedup_archives(spark: SparkSession, source: str, target: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Read the archives in ``source``, write their records to ``target`` with repeated payloads as revisits."""
    verdict = resolve_revisits(read_archives(spark, source, payloads=False), min_bytes)
    records = read_archives(spark, source).withColumn("uri", F.coalesce("target_uri", F.lit(""))).withColumn("at", F.coalesce("date", F.lit(DATE)))
    moved = F.col("to_id").isNotNull()
    old = records.columns
    fresh = {"record_type": F.when(moved, F.lit("revisit")).otherwise(F.col("record_type")),
             "refers_to": F.coalesce("to_id", "refers_to"), "refers_to_uri": F.coalesce("to_uri", "refers_to_uri"),
             "refers_to_date": F.coalesce("to_date", "refers_to_date"),
             "payload": F.when(~moved, F.col("payload"))}
    joined = records.join(verdict, ["record_id", "uri", "at", "payload_digest", "payload_bytes"], "left")
    write_archives(joined.select(*[fresh.get(c, F.col(c)).alias(c) for c in old if c not in ("uri", "at")]), target)
