"""Web archives: one gzip member per record, written in parallel and read back sequentially.

Writing: rows with equal payloads are found by their SHA-1; the row with the smallest id
becomes a response record, every other a revisit record that names it and carries no
payload, only the digest and the payload's length.  Each partition writes archives of
bounded size into a shared folder, under names of its attempt; those of the attempts that count
are listed in a table.  Rows of a frequent digest are spread by Spark's handling of skewed joins.

Reading: each task reads whole archives from front to end through an incremental zlib
decompressor, one gzip member at a time, frames the block by its Content-Length, and
verifies block and payload digests; damage raises ValueError.

Nulls count as empty payloads.  Rows that share the smallest id of a group are all responses;
a null id sorts last, so it is a response only where all ids of a group are null.  Payloads
under ``min_bytes`` are never made revisits.  A very long payload is one record, held in memory
whole.  An empty table gives no archive and no row.  Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import shared_dir, slices, stored
from plumbline.llm.media import filesystem

ARCHIVE_BYTES = 64 << 20
READ_BYTES = 64 << 10  # what follows a member is copied for each member, so blocks are small
LEVEL = 1
DATE = "2000-01-01T00:00:00Z"  # a parameter of the writer, so that repeated tasks write equal bytes


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


NO_ID = "<urn:page>"


def urn(page_id) -> str:
    return NO_ID if page_id is None else f"<urn:page:{urllib.parse.quote(str(page_id), safe='')}>"


def from_urn(name: str) -> str | None:
    return None if name == NO_ID else urllib.parse.unquote(name.removeprefix("<urn:page:").removesuffix(">"))


def record(kind: str, page_id, uri: str | None, payload: bytes, refers_to=None, date: str = DATE) -> bytes:
    """One record as a gzip member.  A revisit keeps the response's header, but not its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((uri or '').split())}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head[5:5] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def gzip_members(f, size: int = READ_BYTES) -> Iterator[bytes]:
    """The decompressed bytes of each gzip member of a stream, one after the other; holds one record and one block at a time."""
    z, parts, rest = None, [], b""
    while True:
        data = rest or f.read(size)
        if not data:
            break
        z = z or zlib.decompressobj(31)
        parts.append(z.decompress(data))
        rest = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = None, []
    if z is not None:
        raise ValueError("a gzip member is cut off")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record, framed by its Content-Length."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the block isn't as long as the header says")
    return headers, rest[:n]


def read_record(raw: bytes) -> dict:
    """A verified record: type, ids, digest, payload length, payload (None for a revisit)."""
    headers, block = parse(raw)
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    if headers.get("warc-block-digest", "").removeprefix("sha1:") != sha1_base32(block):
        raise ValueError("the block's digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    if kind == "response" and (len(payload) != n or sha1_base32(payload) != digest):
        raise ValueError("the payload's digest differs")
    return {"page_id": from_urn(headers["warc-record-id"]), "url": headers["warc-target-uri"], "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": from_urn(headers.get("warc-refers-to", NO_ID)), "payload": payload if kind == "response" else None}


def classify(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, first_id): first_id is the smallest id among equal payloads, found by digest without moving payloads twice."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    # the digests' side is one short row each, so it is hashed; payloads stream past it unsorted
    return rows.join(first.hint("shuffle_hash"), "digest").select("page_id", "url", "html", F.when(F.octet_length("html") >= min_bytes, F.col("first_id")).alias("first_id"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages to archives in ``folder``; a table of (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        part, out, made, size, path = TaskContext.get().partitionId(), None, [], 0, ""

        attempt = uuid.uuid4().hex  # other attempts write archives of other names, and only those of the one that counts are listed
        for b in (x for batch in batches for x in slices(batch, "html")):
            for page, url, html, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "first_id")), strict=True):
                if out is None:
                    path = os.path.join(base, f"part-{part:06d}-{attempt}-{len(made):04d}.warc.gz")
                    out, size = fs.open_output_stream(path, compression=None), 0
                    made.append([path, 0])
                again = first is not None and page != first
                raw = record("revisit" if again else "response", page, url, html.encode(), first)
                out.write(raw)
                size, made[-1][1] = size + len(raw), made[-1][1] + 1
                if size >= archive_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.record_batch([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["path", "records"])

    return stored(classify(pages, min_bytes).mapInArrow(run, "path string, records long"), "warc-list")


def read_archives(paths: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the archives that ``paths`` names; each archive is read by one task, front to end."""
    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads
    names = [x.split(" ")[0] for x in schema.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split(" ")[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            rows, size = [], 0
            with fs.open_input_stream(path, compression=None) as f:
                for raw in gzip_members(f):
                    r = read_record(raw)
                    rows.append([r[n] for n in names])
                    size += 200 + len(raw) * payloads
                    if size >= 4 << 20:
                        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return paths.select("path").mapInArrow(run, schema)


def roundtrip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages, read the archives back, and describe each record read."""
    folder = shared_dir(pages.sparkSession, "warc")
    paths = write_archives(pages, folder, min_bytes)
    kind = pages.schema["page_id"].dataType.simpleString()
    back = read_archives(paths, folder, payloads=False)
    return back.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))
