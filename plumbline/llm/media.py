"""Media columns: payloads stored losslessly as 8-bit grey images in archives, and a data source that reads them back.

Writing: each partition streams its members into ZIP archives of bounded size in a shared
folder (members stored, since the images inside are already deflated).  Every attempt of a task
writes archives of its own names; those of the attempts that count are listed in the folder's
manifest, so what lost or repeated attempts leave behind is never read.

Reading: the ``media_archive`` data source plans byte ranges over the archives of a folder's
manifest (all its archives if it has none) from their sizes alone.  A task reads the central directory of its archive, takes the members
whose records begin in its range, reads each by its offset, verifies it, and streams
batches of bounded bytes through Arrow.  A member that fails is opened and read again by
its offset without the others; after the last attempt the task fails (whole results) unless
``on_error`` is ``null``, which yields the member with a null payload.

Nulls count as empty payloads, and empty payloads are padded like any other.  Repeated rows
and repeated or null ids are members of their own; ids of any kind come back as they were.
A very long text is one member, held in memory whole.  No ties arise.  An empty table gives no
archive and no row.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.llm.common import shared_dir, slices

WIDTH = 64  # samples a row; payloads are padded to a multiple of it
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS = 3
LEVEL = 1  # deflate

MANIFEST = "manifest.txt"

_PNG = b"\x89PNG\r\n\x1a\n"


def pad(data: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of WIDTH."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """8-bit greyscale PNG, WIDTH samples a row, filter 0; a text chunk holds the length before padding."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\x00%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(raw, LEVEL)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """The payload and its length before padding; raises ValueError where a checksum or the layout is wrong."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, n, data, size = 8, 0, [], None
    while at < len(media):
        (k,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + k]
        if struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))) != media[at + 8 + k : at + 12 + k]:
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"tEXt":
            n = int(body.split(b"\x00")[1])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + k
    if not size:
        raise ValueError("no header chunk")
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    return raw[:, 1:].tobytes(), n


def feature(payload: bytes) -> str:
    """Integer features of the samples: mean and deviation in thousandths, distinct values, most frequent value, share of zeros in thousandths."""
    x = np.frombuffer(payload, np.uint8)
    h = np.bincount(x, minlength=256).astype(object)
    n, v = len(x), np.arange(256).astype(object)
    s1, s2 = int((h * v).sum()), int((h * v * v).sum())
    dev = int((1000 * 1000 * (n * s2 - s1 * s1) // (n * n)) ** 0.5)
    return f"mean={1000 * s1 // n};dev={dev};distinct={sum(1 for c in h if c)};mode={int(np.argmax(h.astype(np.int64)))};zeros={1000 * int(h[0]) // n}"


# -- archives ------------------------------------------------------------------------------
def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file:///{uri.removeprefix('file:/')}")


class ArchiveWriter:
    """A ZIP file of stored members, written in order through any Arrow file system; ZIP64 is avoided by bounded sizes."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.path, self.at, self.entries = path, 0, []
        self.out = fs.open_output_stream(path)

    def add(self, name: str, data: bytes) -> None:
        raw = name.encode()
        crc = zlib.crc32(data)
        common = struct.pack("<HHHHHIIIHH", 20, 0x800, 0, 0, 33, crc, len(data), len(data), len(raw), 0)
        self.out.write(b"PK\x03\x04" + common + raw)
        self.out.write(data)
        self.entries.append(b"PK\x01\x02" + struct.pack("<H", 20) + common + struct.pack("<HHHII", 0, 0, 0, 0, self.at) + raw)
        self.at += 30 + len(raw) + len(data)

    def close(self) -> int:
        """Ends the archive; its size."""
        directory, n = b"".join(self.entries), len(self.entries)
        # an archive holds at most 65,535 members: see write_members
        self.out.write(directory + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, n, n, len(directory), self.at, 0))
        self.out.close()
        return self.at + len(directory) + 22


def members(fs: pafs.FileSystem, path: str, start: int, end: int) -> list[tuple[str, int, int, int]]:
    """(name, offset, size, crc) of the members whose records begin in [start, end), from the central directory."""
    with fs.open_input_file(path) as f:
        size = f.size()
        f.seek(max(0, size - 22))
        tail = f.read(22)
        if tail[:4] != b"PK\x05\x06":
            raise ValueError(f"{path}: no end of central directory")
        n, length, at = struct.unpack_from("<HII", tail, 10)
        f.seek(at)
        directory = f.read(length)
    out, at = [], 0
    for _ in range(n):
        crc, size, _, k = struct.unpack_from("<IIIH", directory, at + 16)
        extra, comment = struct.unpack_from("<HH", directory, at + 30)
        (offset,) = struct.unpack_from("<I", directory, at + 42)
        if start <= offset < end:
            out.append((directory[at + 46 : at + 46 + k].decode(), offset, size, crc))
        at += 46 + k + extra + comment
    return out


def read_member(fs: pafs.FileSystem, path: str, f, offset: int, size: int, crc: int) -> bytes:
    """One member by its offset, verified; each further attempt opens the archive anew."""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            with f if attempt == 1 and not f.closed else fs.open_input_file(path) as g:
                g.seek(offset)
                head = g.read(30)
                name, extra = struct.unpack_from("<HH", head, 26)
                g.seek(offset + 30 + name + extra)
                data = g.read(size)
            if head[:4] != b"PK\x03\x04" or len(data) != size or zlib.crc32(data) != crc:
                raise ValueError(f"{path}@{offset}: member is damaged")
            return data
        except (OSError, ValueError):
            if attempt == ATTEMPTS:
                raise
    raise AssertionError


class MediaArchives(DataSource):
    """``spark.read.format("media_archive").load(folder)``: (name, archive, offset, media) of all archives in a folder."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "name string, archive string, offset long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.on_error = options.get("on_error", "fail")

    def partitions(self) -> list[ByteRange]:
        fs, folder = filesystem(self.folder)
        manifest = f"{folder.rstrip('/')}/{MANIFEST}"
        if fs.get_file_info(manifest).is_file:
            with fs.open_input_stream(manifest) as f:
                files = [(f"{folder.rstrip('/')}/{name}", int(size)) for name, size in (x.split("\t") for x in f.read().decode().splitlines())]
        else:
            files = sorted((x.path, x.size) for x in fs.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True)) if x.is_file and x.path.endswith(".zip"))
        return [ByteRange(p, a, min(a + self.range_bytes, n)) for p, n in files for a in range(0, n, self.range_bytes)] or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = filesystem(self.folder)
        rows, size = [], 0
        for name, offset, n, crc in members(fs, part.path, part.start, part.end):
            try:
                data = read_member(fs, part.path, fs.open_input_file(part.path), offset, n, crc)
            except (OSError, ValueError):
                if self.on_error != "null":
                    raise
                data = None
            rows.append((name, part.path, offset, data))
            size += n
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["name", "archive", "offset", "media"])


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Store every row's payload as a member of an archive in ``folder``; returns the number of members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        stem, total, writer, made = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, None, []

        def close() -> None:
            made.append((os.path.basename(writer.path), writer.close(), len(writer.entries)))

        for b in (x for batch in batches for x in slices(batch)):
            for doc, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                data = (text or "").encode()
                if writer is None:
                    writer = ArchiveWriter(fs, os.path.join(base, f"{stem}-{len(made):04d}.zip"))
                writer.add(f"{member_id(doc)}/{total}.png", to_png(pad(data), len(data)))
                total += 1
                if writer.at >= archive_bytes or len(writer.entries) >= 65_000:
                    close()
                    writer = None
        if writer is not None:
            close()
        columns = zip(*made, strict=True) if made else [()] * 3
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["name", "size", "members"])

    # a row for each archive, of some tens of megabytes
    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "name string, size long, members long").collect()
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base.rstrip('/')}/{MANIFEST}", compression=None) as f:
        f.write("".join(f"{r.name}\t{r['size']}\n" for r in sorted(made)).encode())
    return sum(r.members for r in made)


def member_id(doc) -> str:
    """An id as the first part of a member's name; a null has no letter before it."""
    return "" if doc is None else "i" + urllib.parse.quote(str(doc), safe="")


def read_archives(spark, folder: str) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archive").load(folder)


def digests(media: DataFrame, id_type: str = "long") -> DataFrame:
    """Per member: lengths, digests and features of the payload decoded from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, m in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist(), strict=True):
                payload, n = from_png(m)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(payload)))
            columns = zip(*rows, strict=True) if rows else [()] * 8
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, [b.column("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    first = F.split_part("name", F.lit("/"), F.lit(1))
    ids = F.when(first != "", F.url_decode(F.substring(first, F.lit(2), F.length(first)))).cast(id_type).alias("doc_id")
    return media.select(ids, "media").mapInArrow(run, f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def roundtrip(docs: DataFrame) -> DataFrame:
    """Store all documents in archives of the shared folder, read them back, and describe what was read."""
    folder = shared_dir(docs.sparkSession, "media")
    write_archives(docs, folder)
    return digests(read_archives(docs.sparkSession, folder), docs.schema["doc_id"].dataType.simpleString())
