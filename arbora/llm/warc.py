"""WARC archives: writing with segments, chunked framing and revisits; reading with segment reassembly.

Archives are written by Spark's text writer, whose line separator is the blank lines that end a WARC record, so any file
system that Spark knows will do, and a lost task is written again as a whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.common import Scratch, field, mapped, text_bytes

#: Bytes of a segment's block, of a chunk of the transfer framing, and records of a file (so a file has some 64 MB at most).
SEGMENT, CHUNK, FILE_RECORDS = 32 << 10, 8 << 10, 2_000
#: Payloads of so many bytes or more are written once and revisited.
LEAST = 0
#: Groups of equal payloads that are broadcast, about 100 bytes each; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

RECORD = T.StructType(
    [field(x, T.StringType()) for x in ("record_id", "record_type", "url", "refers_id", "payload_digest", "origin")]
    + [field(x, T.LongType()) for x in ("page_id", "refers_to", "payload_bytes", "segment", "total")]
    + [field("block", T.BinaryType()), field("status", T.StringType())]
)


def sha1(payload: bytes) -> str:
    """A payload digest: bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def framed(payload: bytes, chunk: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), chunk):
        piece = payload[at : at + chunk]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unframed(body: bytes) -> bytes | None:
    """What chunked framing holds, without extensions and trailers; None if it is broken off or malformed."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        if size <= 0:
            return b"".join(parts) if size == 0 else None
        piece = body[end + 2 : end + 2 + size]
        if len(piece) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        parts.append(piece)
        at = end + 4 + size


def payload_of(block: bytes) -> tuple[bytes | None, int | None, str]:
    """The payload of an HTTP response, its Content-Length, and a status: ok, no_http, bad_chunks or length_mismatch."""
    head, blank, body = block.partition(END)
    if not blank:
        return None, None, "no_http"
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    length = int(fields[b"content-length"]) if fields.get(b"content-length", b"").isdigit() else None
    if b"chunked" in fields.get(b"transfer-encoding", b"").lower():
        found = unframed(body)
        return found, length, "ok" if found is not None else "bad_chunks"
    return body, length, "ok" if length in (None, len(body)) else "length_mismatch"


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the blank lines after it. Fields that are None are left out."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def records_of(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of a page: a revisit, or a response with its continuations."""
    digest, name = sha1(payload), lambda x: f"<urn:x-page:{'' if x is None else x}:{digest}>"
    url = None if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    common = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("X-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        block = HEAD + b"Content-Length: %d" % len(payload) + END
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", name(page_id)), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to)), ("X-Refers-To-Page-ID", refers_to)], block)
        return
    block = HEAD + b"Transfer-Encoding: chunked" + END + framed(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for n, part in enumerate(parts, 1):
        own = [("WARC-Segment-Number", n if len(parts) > 1 else None), ("WARC-Segment-Total-Length", len(block) if 1 < len(parts) == n else None)]
        if n == 1:
            yield record([("WARC-Type", "response"), ("WARC-Record-ID", name(page_id)), *common, ("Content-Type", "application/http;msgtype=response"), *own], part)
        else:
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name(page_id)[:-1]}:{n}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", name(page_id)), *own], part)


def with_revisits(pages: DataFrame, least: int = LEAST, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """page_id, url, payload, refers_to: null for responses, else the largest page_id among the rows with an equal payload.

    Rows that share that page_id and the payload are all responses; so are those of a group without any page_id.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("_key", F.unhex(F.sha2("payload", 256)))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("_key").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("_key", "_last")
    few = groups.limit(broadcast_groups + 1).count() <= broadcast_groups
    joined = rows.join(F.broadcast(groups) if few else groups, "_key", "left")
    refers = F.when(F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT) -> None:
    """Writes pages (page_id, url, html) as WARC files. A null html is an empty payload; other columns are ignored.

    Long payloads are cut in segments, so records are short; null page_ids and urls are left out of a record's fields. Rows that
    repeat are records of their own. An empty table gives no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, refers = (batch.column(i).to_pylist() for i in (0, 1, 3))
            data, at, _ = text_bytes(batch.column(2))
            out, held = [], 0
            for i in range(batch.num_rows):
                for x in records_of(ids[i], urls[i], bytes(data[at[i] : at[i + 1]]), refers[i], segment):
                    out.append(x)
                    held += len(x)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines = mapped(with_revisits(pages, least), run, T.StructType([field("value", T.BinaryType())]))
    lines.select(F.col("value").cast("string")).write.options(lineSep=END.decode(), maxRecordsPerFile=FILE_RECORDS).text(path)


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of each record of an archive."""
    at = 0
    while (end := content.find(END, at)) >= 0:
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in content[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
        size = int(fields.get("content-length", "0") or 0)
        yield fields, content[end + 4 : end + 4 + size]
        at = end + 4 + size + len(END)


def _row(fields: dict[str, str], block: bytes, whole: bool) -> dict:
    number = lambda x: int(fields[x]) if fields.get(x, "").lstrip("-").isdigit() else None
    out = {"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "url": fields.get("warc-target-uri"), "refers_id": fields.get("warc-refers-to"), "origin": fields.get("warc-segment-origin-id")}
    out |= {"page_id": number("x-page-id"), "refers_to": number("x-refers-to-page-id"), "segment": number("warc-segment-number"), "total": number("warc-segment-total-length"), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None}
    if out["segment"] is not None:
        return out | {"block": block, "origin": out["origin"] or out["record_id"], "status": "segment"}
    return out | decoded(block, out["payload_digest"], out["record_type"], whole)


def decoded(block: bytes, digest: str | None, kind: str | None, whole: bool) -> dict:
    """payload_bytes, payload_digest and status of a complete block; whole: block is the payload, else null."""
    payload, length, status = payload_of(block)
    if kind == "revisit":  # no body: its length and digest stand in the headers
        return {"payload_bytes": length, "payload_digest": digest, "status": "ok" if digest else "no_digest", "block": None}
    if payload is None:
        return {"payload_bytes": None, "payload_digest": None, "status": status, "block": None}
    own = sha1(payload)
    return {"payload_bytes": len(payload), "payload_digest": own, "status": "digest_mismatch" if digest not in (None, own) else status, "block": payload if whole else None}


def read_records(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """The records of all archives under path; blocks only of segments, and with `whole` the decoded payloads of complete ones.

    Archives are plain or gzip files. A task holds one file at a time, plain ones of less than 2 GB; write_archives() bounds
    its files by their number of records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x.name, pa.binary() if x.name == "block" else pa.int64() if isinstance(x.dataType, T.LongType) else pa.string()) for x in RECORD])
        for batch in batches:
            for file in batch.column(0):
                content = file.as_py()
                content = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                rows, held = [], 0
                for fields, block in parsed(content):
                    rows.append(_row(fields, block, whole))
                    held += len(rows[-1]["block"] or b"") + 300
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return mapped(spark.read.format("binaryFile").load(path).select("content"), run, RECORD)


def reassemble(records: DataFrame, whole: bool = False) -> DataFrame:
    """Segmented records made whole: rows like those of complete records.

    Continuations are grouped by the origin's identifier and joined in the order of their segment numbers. The numbers must
    run from 1 without a gap, and the length must be the total that the last one tells; else status is missing_segment,
    conflicting_segment (one number, different blocks) or length_mismatch, and the payload is null. Repeated segments count
    once, but an origin record that occurs several times gives as many rows. A group holds one payload, however often its
    records repeat, since equal segments are merged before they meet.
    """
    parts = records.where("segment IS NOT NULL")
    head = F.struct("record_id", "record_type", "url", "page_id", "payload_digest")
    single = parts.groupBy("origin", "segment").agg(F.min("block").alias("_block"), F.max("block").alias("_other"), F.max("total").alias("total"), F.max(F.when(F.col("segment") == 1, head)).alias("_head"), F.sum((F.col("segment") == 1).cast("long")).alias("_copies"))
    single = single.withColumn("_clash", F.col("_block") != F.col("_other"))
    group = single.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("segment", F.col("_block").cast("string").alias("block")))).alias("_parts"),
        F.max("total").alias("total"), F.sum(F.octet_length("_block")).alias("_length"), F.max("segment").alias("_last"), F.count(F.lit(1)).alias("_n"),
        F.max("_head").alias("_head"), F.max("_copies").alias("_copies"), F.max("_clash").alias("_clash"),
    )
    broken = F.when(F.col("_clash"), "conflicting_segment").when((F.col("_last") != F.col("_n")) | F.col("_head").isNull() | F.col("total").isNull(), "missing_segment").when(F.col("total") != F.col("_length"), "length_mismatch")
    joined = group.select("_head.*", "origin", "total", F.array_join(F.col("_parts.block"), "").cast("binary").alias("block"), broken.alias("status"), F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("_copies"), F.lit(1)))).alias("_copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x.name, pa.binary() if x.name == "block" else pa.int64() if isinstance(x.dataType, T.LongType) else pa.string()) for x in RECORD])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64).to_pylist()
                rows = [x | (decoded(x["block"], x["payload_digest"], x["record_type"], whole) if x["status"] is None else {"block": None, "payload_digest": None}) for x in rows]
                yield pa.RecordBatch.from_pylist([{k: x.get(k) for k in schema.names} for x in rows], schema=schema)

    return mapped(joined, run, RECORD)


def read_archives(spark: SparkSession, path: str, scratch: Scratch, whole: bool = False) -> DataFrame:
    """All records of the archives, segmented ones reassembled; with `whole`, block holds the payload."""
    table = scratch.table(read_records(spark, path, whole), "records")
    return table.where("segment IS NULL").unionByName(reassemble(table, whole))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, status for each page, read back from the archives."""
    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = read_archives(spark, path, scratch)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload)::BIGINT AS n, sha1(payload) AS hex, sha256(payload) AS key FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS bits FROM h),
d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS digest, max(page_id) OVER (PARTITION BY key) AS last FROM b)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to, 'ok' AS status FROM d
"""
