"""WARC: archives written per record, and read back as a table of chunks.

A payload of any size is written and read as rows of record identifier and chunk number; those read carry the digest of
the payload up to and including them. So no Python task holds more than a batch of chunks, however large a record is.
Archives are gzip files with a member per record.
Of records with equal payloads the one with the smallest page_id is a response and the others revisit it.

Defined results: a null html is an empty payload. Payloads under min_revisit bytes are always responses. If the smallest
page_id of equal payloads stands in several rows, all of those are responses. A null page_id is never the smallest; rows
of equal payloads that all lack a page_id are all responses. A null url is written as the record's own identifier. An
empty table has no archives and no rows. Other columns are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm._common import small_batches, materialise, open_shared, parallelism, scratch

CHUNK_BYTES = 256 << 10
#: A task starts another archive after so many payload bytes.
ARCHIVE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
_RAW = re.compile(r"[^\x21-\x7e]")
CHUNK_DDL = "record_id string, chunk_no int, page_id bigint, record_type string, target_uri string, refers_to bigint, chunk_start bigint, chunk_bytes int, payload binary, digest_so_far string, is_last boolean, payload_bytes bigint, payload_digest string"


def base32_sha1(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def plan_revisits(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """page_id, url, html, sha1 (of html, in hex) and refers_to: the page of each revisit, null for responses.

    Only digests that occur twice or more are joined; the join's skewed partitions can be split by Spark.
    """
    page = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha1", F.sha1("html"))
    big = page.where(F.octet_length("html") >= min_revisit)
    first = materialise(big.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL").drop("n"), "warc-first")
    joined = page.join(first, "sha1", "left")
    revisit = F.when((F.octet_length("html") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return joined.select("page_id", "url", "html", "sha1", revisit.alias("refers_to"))


def _record_id(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def _page_id(record_id: str) -> int | None:
    name = record_id.rpartition(":")[2]
    return None if name == "null" else int(name)


def record_head(page_id: int | None, url: str | None, size: int, sha1: str, refers_to: int | None) -> bytes:
    """The headers of a WARC record and of its HTTP message, from the size and the SHA-1 of the payload."""
    own = _record_id(page_id)
    uri = _RAW.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else own
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if refers_to is None else 0)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_record_id(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http


def record_parts(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> Iterator[bytes]:
    """The bytes of a WARC record; a revisit has the HTTP headers only."""
    yield record_head(page_id, url, len(payload), hashlib.sha1(payload).hexdigest(), refers_to)
    if refers_to is None:
        for a in range(0, len(payload), CHUNK_BYTES):
            yield payload[a : a + CHUNK_BYTES]
    yield b"\r\n\r\n"


def payload_chunks(planned: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each chunk of a payload, in order, a record's rows one after another; a revisit has one row without payload."""
    body = planned.select("page_id", "url", "refers_to", "sha1", F.encode("html", "utf-8").alias("body"))
    sized = body.withColumn("size", F.octet_length("body").cast("long"))
    last = F.when(F.col("refers_to").isNotNull() | (F.col("size") == 0), F.lit(0)).otherwise(F.call_function("div", F.col("size") - 1, F.lit(chunk_bytes)))
    rows = sized.withColumn("last", last.cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("chunk_no"))
    chunk = F.when(F.col("refers_to").isNull(), F.substring(F.col("body"), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)))
    return rows.select("page_id", "url", "refers_to", "sha1", "size", "chunk_no", (F.col("chunk_no") == F.col("last")).alias("is_last"), chunk.alias("chunk"))


def write_archives(planned: DataFrame, folder: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write the records, chunk by chunk; returns the committed manifest: file, n_records.

    A retried task writes under another name.
    """
    spark = planned.sparkSession
    folder = folder or scratch(spark, "warc")
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, member, file, n, size = None, None, "", 0, 0
        for batch in batches:
            for page_id, url, refers_to, sha1, whole, chunk_no, is_last, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    file, n, size = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = open_shared(file, "wb")
                if chunk_no == 0:
                    member = zlib.compressobj(3, zlib.DEFLATED, 31)
                    out.write(member.compress(record_head(page_id, url, whole, sha1, refers_to)))
                out.write(member.compress(chunk or b""))
                if not is_last:
                    continue
                out.write(member.compress(b"\r\n\r\n") + member.flush())
                n, size = n + 1, size + whole
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pa.record_batch({"file": [file], "n_records": pa.array([n], pa.int64())})
        if out is not None:
            out.close()
            yield pa.record_batch({"file": [file], "n_records": pa.array([n], pa.int64())})

    return materialise(payload_chunks(planned, chunk_bytes).mapInArrow(run, "file string, n_records bigint"), "warc-manifest")


def _headers(stream: io.BufferedIOBase) -> tuple[str, dict[str, str], int]:
    """(first line, headers by lower-case name, bytes read); an empty first line at the end of the file."""
    first, out, size = stream.readline(), {}, 0
    while first in (b"\r\n", b"\n"):
        first = stream.readline()
    size += len(first)
    while line := stream.readline() if first else b"":
        size += len(line)
        if line in (b"\r\n", b"\n"):
            break
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return first.decode("latin-1").strip(), out, size


def read_records(stream: io.BufferedIOBase, chunk_bytes: int = CHUNK_BYTES, with_payload: bool = True) -> Iterator[tuple]:
    """Rows of CHUNK_DDL of every record of a stream; at most one chunk is in memory. A wrong digest raises an error."""
    while True:
        version, head, _ = _headers(stream)
        if not version:
            return
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record: {version[:40]!r}")
        left = int(head["content-length"])
        status, http, size = _headers(stream)
        if not status.startswith("HTTP/"):
            raise ValueError("no HTTP message in the record")
        left -= size
        record_id, kind = head["warc-record-id"].strip("<>"), head["warc-type"]
        told = head["warc-payload-digest"].removeprefix("sha1:")
        refers_to = _page_id(head["warc-refers-to"].strip("<>")) if "warc-refers-to" in head else None
        whole = int(http["content-length"])
        fixed = (_page_id(record_id), kind, head.get("warc-target-uri"), refers_to)
        if kind == "revisit":
            yield (record_id, 0, *fixed, 0, 0, None, told, True, whole, told)
            continue
        digest, at, k = hashlib.sha1(), 0, 0
        while True:
            chunk = stream.read(min(chunk_bytes, left))
            if len(chunk) < min(chunk_bytes, left):
                raise ValueError(f"{record_id} is cut short")
            left -= len(chunk)
            digest.update(chunk)
            so_far = base32_sha1(digest)
            if not left and (so_far != told or at + len(chunk) != whole):
                raise ValueError(f"{record_id} has another digest or length than its header says")
            yield (record_id, k, *fixed, at, len(chunk), chunk if with_payload else None, so_far, not left, whole, told)
            at, k = at + len(chunk), k + 1
            if not left:
                break


def read_chunks(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_payload: bool = True) -> DataFrame:
    """The chunk table of the archives that a manifest names."""
    spark = manifest.sparkSession
    small_batches(spark)
    names = [c.split()[0] for c in CHUNK_DDL.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    kinds = [types[c.split()[1]] for c in CHUNK_DDL.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, size = [], 0
                with open_shared(file, "rb") as raw, gzip.GzipFile(fileobj=raw) as unpacked, io.BufferedReader(unpacked, 1 << 16) as stream:
                    for row in read_records(stream, chunk_bytes, with_payload):
                        rows.append(row)
                        size += row[7] if with_payload else 0
                        if len(rows) >= 2048 or size >= 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return manifest.select("file").repartition(parallelism(spark)).mapInArrow(run, CHUNK_DDL)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives of pages, store their chunk table, and return a row per record from its last stored chunk."""
    chunks = materialise(read_chunks(write_archives(plan_revisits(pages))), "warc-chunks")
    size = F.when(F.col("record_type") == "response", F.col("chunk_start") + F.col("chunk_bytes")).otherwise(F.col("payload_bytes"))
    return chunks.where("is_last").select("page_id", size.alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


_GROUPS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) // {32 ** (3 - k)}) % 32 + 1 AS INTEGER), 1)" for g in range(8) for k in range(4))
#: DuckDB: the rows that op2 returns.
ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_GROUPS} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (h)
"""
