"""Packing documents into token sequences of bounded length, online with bounded space.

Each partition keeps a fixed number of open windows.  A piece goes to the window it fits
best; when it fits none and no slot is free, its head fills the fullest window, which is
emitted, and its rest goes on.  Pieces left in open windows at a partition's end are
gathered by groups of neighbouring partitions and packed again; what is then still open is
chained and cut into full windows and, at the very end, windows whose lengths are powers
of two.  So no sequence carries padding.

Nulls count as empty texts: such a document is its end mark alone.  Rows with the same or
a null id are packed as documents of their own.  Texts of any length are cut into as many
pieces as they need.  Ties go to the window opened first.  An empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices, stored

CAPACITY = 2048
OPEN_WINDOWS = 16
#: Neighbouring partitions whose leftovers are packed together.
MERGE_PARTITIONS = 32
_MERGED = 1 << 61


@lru_cache(2)
def tokenizer(path: str):
    """The byte-level BPE of a ``.tiktoken`` file: the ids the tokenizers library gives with the ``.json`` beside it."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


#: Texts with a run of white space this long go to the tokenizers library: the other one steps back over each run, which takes memory in proportion.
LONG_RUN = 1 << 14
_LONG_RUN = re.compile(r"\s{%d}" % LONG_RUN)


@lru_cache(2)
def _library(path: str):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(path.removesuffix(".tiktoken") + ".json")
    t.no_truncation()
    t.no_padding()
    return t


def encode(text: str, path: str) -> np.ndarray:
    """Ids of a whole text, as the tokenizers library gives them without special tokens."""
    if len(text) >= LONG_RUN and _LONG_RUN.search(text):
        return np.array(_library(path).encode(text, add_special_tokens=False).ids, "<u4")
    return tokenizer(path).encode_to_numpy(text, allowed_special="all").astype("<u4")


class Packer:
    """Bounded-space best-fit over pieces ``(doc, start, ids, doc_tokens)``; ``out`` gets finished windows."""

    def __init__(self, capacity: int = CAPACITY, windows: int = OPEN_WINDOWS):
        self.capacity, self.windows = capacity, windows
        self.open: list[tuple[int, list]] = []  # (free room, pieces)
        self.out: list[list] = []

    def add(self, doc, ids: np.ndarray, start: int, total: int) -> None:
        cap, opened = self.capacity, self.open
        while len(ids) >= cap:
            self.out.append([(doc, start, ids[:cap], total)])
            ids, start = ids[cap:], start + cap
        while (n := len(ids)) > 0:
            best = min(((room, i) for i, (room, _) in enumerate(opened) if room >= n), default=None)
            if best is None and len(opened) < self.windows:
                opened.append((cap - n, [(doc, start, ids, total)]))
                return
            i = best[1] if best else min(range(len(opened)), key=lambda i: opened[i][0])
            room, pieces = opened[i]
            head = min(room, n)
            pieces.append((doc, start, ids[:head], total))
            if head == room:
                self.out.append(pieces)
                del opened[i]
            else:
                opened[i] = (room - head, pieces)
            ids, start = ids[head:], start + head

    def leftovers(self) -> list[tuple]:
        rest = [p for _, pieces in self.open for p in pieces]
        self.open = []
        return rest

    def finish(self) -> None:
        """Chain what is open into full windows, then into windows of descending powers of two."""
        rest = self.leftovers()
        left = sum(len(p[2]) for p in rest)
        room, window = 0, []
        for doc, start, ids, total in rest:
            while len(ids):
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                    window = []
                    self.out.append(window)
                head = min(room, len(ids))
                window.append((doc, start, ids[:head], total))
                ids, start, room, left = ids[head:], start + head, room - head, left - head


def _rows(windows: list[list], first: int) -> Iterator[tuple]:
    for k, pieces in enumerate(windows, first):
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, ids.tobytes(), total, k, at
            at += len(ids)


_NAMES = ("doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "part")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, windows: int = OPEN_WINDOWS, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, ids, doc_tokens, sequence_id, offset) of all documents; ids little-endian unsigned 32-bit."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, ids binary, doc_tokens long, sequence_id long, offset long, part long"
    types = [docs.sparkSession.range(0).select(F.lit(None).cast(kind)).toArrow().schema.types[0], pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def table(rows: list[tuple], part: int) -> pa.RecordBatch:
        columns = [*zip(*rows, strict=True)] if rows else [()] * 6
        return pa.record_batch([pa.array(list(c), t) for c, t in zip([*columns, [part] * len(rows)], types, strict=True)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, first = Packer(capacity, windows), part << 32
        end = np.array([end_id], "<u4")
        for b in (x for batch in batches for x in slices(batch)):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.concatenate([encode(text or "", path), end])
                packer.add(doc, ids, 0, len(ids))
            done, packer.out = packer.out, []
            yield table([*_rows(done, first)], part)
            first += len(done)
        # leftovers have no sequence yet
        yield table([(doc, start, ids.tobytes(), total, None, None) for doc, start, ids, total in packer.leftovers()], part)

    first_pass = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema), "pack")

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        packer = Packer(capacity, windows)
        rows = rows.sort_by([("part", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")])
        for r in rows.to_pylist():
            packer.add(r["doc_id"], np.frombuffer(r["ids"], "<u4"), r["start"], r["doc_tokens"])
        packer.finish()
        return pa.Table.from_batches([table([*_rows(packer.out, _MERGED + (key[0].as_py() << 32))], 0)]).drop_columns("part")

    done = first_pass.filter(F.col("sequence_id").isNotNull()).drop("part")
    left = first_pass.filter(F.col("sequence_id").isNull()).drop("sequence_id", "offset")
    merged = left.groupBy(F.floor(F.col("part") / MERGE_PARTITIONS).alias("merge_group")).applyInArrow(merge, schema.rsplit(",", 1)[0])
    return done.unionByName(stored(merged, "pack-merged"))


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
