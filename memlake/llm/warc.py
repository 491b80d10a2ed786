"""Content-addressed WARC archive: payload bytes once by a verified digest, exact record heads apart, records by joins."""

from __future__ import annotations

import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memlake.llm.common import saved, shared_dir, small_batches, stored

CRLF = "\r\n"
#: What ends a record in a WARC file.
END = CRLF * 2
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = "2024-01-31T00:00:00Z"
#: Of equal payloads of at least so many bytes one is kept as a response, the others revisit it.
LEAST = 0
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of bytes in upper-case base32, as WARC headers have it: 10 hexadecimal digits are 8 of base 32."""
    return F.concat(*[F.translate(F.lpad(F.conv(F.substring(F.sha1(data), i, 10), 16, 32), 8, "0"), DIGITS, BASE32) for i in range(1, 41, 10)])


def address(data: Column) -> Column:
    """Where bytes are kept: their SHA-256. The SHA-1 of the headers would not do, as two payloads can be made to share one."""
    return F.sha2(data, 256)


def _safe(uri: Column) -> Column:
    """A URI that cannot end its header line: control signs, white space and angle brackets are percent-encoded."""
    odd, safe = uri.rlike(r"[\x00-\x20<>\x7f]"), uri
    for sign in (*range(0x21), 0x3C, 0x3E, 0x7F):
        safe = F.replace(safe, F.lit(chr(sign)), F.lit(f"%{sign:02X}"))
    return F.when(odd, safe).otherwise(uri)


def heads(pages: DataFrame, least: int = LEAST, captured: str = CAPTURED) -> DataFrame:
    """(place, page_id, head, address, size): the head of each page's record, which is all of the record before its payload.

    Of pages with equal payloads of at least ``least`` bytes the one with the smallest page_id is a response (of equal
    ids the first row; a null id comes last), the others are revisits that name it and have no payload of their own.
    Payloads are hashed where they are read and only hashes are stored and shuffled; the join with the few first pages
    is an outer one on a key of its own, so that adaptive execution can split a payload that a third of the pages share."""
    data = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    page = pages.select(F.monotonically_increasing_id().alias("place"), F.col("page_id").cast("long").alias("page_id"), _safe(F.col("url")).alias("uri"), address(data).alias("address"), base32_sha1(data).alias("digest"), F.octet_length(data).cast("long").alias("size"))
    page = stored(page, "warc-pages")
    first = page.where(F.col("size") >= least).groupBy("address").agg(F.min(F.struct(F.col("page_id").isNull().alias("blank"), "page_id", "place", "uri")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1").select(F.reverse("address").alias("key"), "first")
    page = page.withColumn("key", F.reverse("address")).join(first, "key", "left")
    again = F.col("first").isNotNull() & (F.col("place") != F.col("first.place"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    urn = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.octet_length(http) + F.when(again, 0).otherwise(F.col("size"))
    head = F.concat(
        F.lit(VERSION + CRLF), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", F.lit(captured)),
        line("WARC-Target-URI", F.col("uri")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.when(again, PROFILE)), line("WARC-Refers-To", F.when(again, urn(F.col("first.page_id")))), line("WARC-Refers-To-Target-URI", F.when(again, F.col("first.uri"))), line("WARC-Refers-To-Date", F.when(again, F.lit(captured))),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", block.cast("string")), F.lit(CRLF), http,
    )
    return page.select("place", "page_id", head.cast("binary").alias("head"), "address", "size")


def write_payloads(payloads: DataFrame, root: str) -> None:
    """Each of the bytes of ``payloads`` (payload) once, by address. Copies meet as partial aggregates, one from a task."""
    saved(payloads.select(address(F.col("payload")).alias("address"), "payload").dropDuplicates(["address"]), f"{root}/payloads")


def archive_pages(pages: DataFrame, root: str, least: int = LEAST, captured: str = CAPTURED) -> None:
    """Archive pages (page_id, url, html) under ``root``: records' heads and, each once, their payloads. A null html is
    empty, a null url has no header; other columns of the pages play no part. An empty table gives an empty archive."""
    saved(heads(pages, least, captured), f"{root}/heads")
    write_payloads(pages.select(F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")), root)


def archive_records(records: DataFrame, root: str) -> None:
    """Archive records as ``read_files`` gives them, whatever their kind: head and payload as they are. A record without
    a payload (null) has none; an address is given to every other, the empty one too."""
    kept = F.when(F.col("payload").isNotNull(), address(F.col("payload")))
    saved(records.select(F.monotonically_increasing_id().alias("place"), "head", kept.alias("address"), F.octet_length("payload").cast("long").alias("size")), f"{root}/heads")
    write_payloads(records.where("payload is not null"), root)


def restore(spark: SparkSession, root: str) -> DataFrame:
    """(every column of the heads, payload): the archive's records, heads joined with the payloads they name. Bytes are
    hashed again: a payload that is missing or not what its address says fails the query, so none is returned wrong.
    A revisit comes with the payload of the response it names, which is not part of its record."""
    found = spark.read.parquet(f"{root}/heads").join(spark.read.parquet(f"{root}/payloads"), "address", "left")
    sound = F.col("address").isNull() | (F.col("payload").isNotNull() & (address(F.col("payload")) == F.col("address")))
    checked = F.when(F.coalesce(sound, F.lit(False)), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.coalesce("address", F.lit("")))).cast("binary"))
    return found.withColumn("payload", checked)


def header(head: Column, name: str) -> Column:
    """The value of a header line of a record's WARC headers, which end at the first empty line; null where there is none."""
    lines = F.substring_index(head.cast("string"), END, 1)
    return F.nullif(F.regexp_extract(lines, f"(?i)\r\n{re.escape(name)}:[ \t]*([^\r]*)", 1), F.lit(""))


def record(restored: DataFrame) -> Column:
    """The exact bytes of a restored record, without what ends it in a file."""
    own = F.coalesce(header(F.col("head"), "WARC-Type") != "revisit", F.lit(True)) & F.col("payload").isNotNull()
    return F.when(own, F.concat("head", "payload")).otherwise(F.col("head"))


def write_files(restored: DataFrame, path: str, records: int = 20_000, compression: str = "gzip") -> None:
    """The restored records as WARC files of at most so many records, in order of ``place`` within each. The text writer
    puts bytes down as they are, and its line end is the record's."""
    rows = restored.select("place", record(restored).cast("string").alias("value")).sortWithinPartitions("place")
    rows.select("value").write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", records).text(path)


def _members(data: bytes) -> bytes:
    """Gzip members one after another, or the bytes as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        machine = zlib.decompressobj(31)
        out.append(machine.decompress(data))
        data = machine.unused_data
    return b"".join(out)


def _split(data: bytes):
    """(head, payload) of each record; lengths, not line ends, say where a block stops. In an HTTP block the payload is
    what follows its header, unless the record is a revisit, which has none; elsewhere it is the whole block."""
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        stop = data.find(b"\r\n\r\n", start)
        if stop < 0:
            raise ValueError("a record's headers do not end")
        lines = data[start:stop].decode("utf-8", "replace").split("\r\n")[1:]
        named = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        begin = stop + 4
        at = begin + int(named["content-length"])
        if at > len(data):
            raise ValueError("a record's block is cut off")
        if named.get("warc-type") == "revisit":
            yield data[start:at], None
            continue
        if named.get("content-type", "").startswith("application/http"):
            inner = data.find(b"\r\n\r\n", begin, at)
            begin = inner + 4 if inner >= 0 else at
        yield data[start:begin], data[begin:at]


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, nth, head, payload) of the records of WARC files, plain or compressed by gzip, whole or a member a record.
    A file is read by one task and held in it, so files should be of some hundred megabytes at most, as ``write_files``
    makes them; a damaged one fails the query."""
    small_batches(spark, 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    schema = pa.schema([("path", pa.string()), ("nth", pa.int64()), ("head", pa.binary()), ("payload", pa.binary())])

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for nth, (head, payload) in enumerate(_split(_members(content.as_py()))):
                    rows.append({"path": name, "nth": nth, "head": head, "payload": payload})
                    size += len(head) + len(payload or b"")
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(run, "path string, nth long, head binary, payload binary")


def digests(restored: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of restored page records: what their heads say,
    and length and digest of the payload that was read back."""
    head, page = F.col("head"), lambda c: F.nullif(F.regexp_extract(c, "<urn:page:(-?[0-9]*)>", 1), F.lit("")).cast("long")
    return restored.select(
        page(header(head, "WARC-Record-ID")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"),
        header(head, "WARC-Type").alias("record_type"), page(F.coalesce(header(head, "WARC-Refers-To"), F.lit(""))).alias("refers_to"),
    )


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    root = f"{shared_dir(spark)}/memlake/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    archive_pages(pages, root)
    return digests(restore(spark, root))


OP11_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, html FROM p),
d AS (SELECT *, translate(list_aggregate(list_transform([1, 11, 21, 31], lambda i: to_base(('0x' || hex[i:i + 9])::UBIGINT::BIGINT, 32, 8)), 'string_agg', ''), '{DIGITS}', '{BASE32}') AS payload_digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f
"""
