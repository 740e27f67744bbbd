"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes: rotations learned by iterative quantisation on a bounded sample; a code has BITS bits
cut into substrings of eight.  Every vector is indexed: each segment of a partition keeps,
for each substring, the list of its vectors by value.  Two codes within Hamming radius r
agree in some substring up to r // m differing bits, so probing every value that near in
every substring retrieves every code within r; candidates beyond r are dropped and the rest
reranked on the original vectors in double precision.  The radius is the one that holds
RADIUS_QUANTILE of the true neighbours of sampled queries.  A segment with fewer than k other
ids within the radius is searched up to the distance, ties included, at which its codes hold k
other ids, so no query goes short.

Queries are written in blocks to the shared folder; each task streams all blocks past its
segments, and keeps k rows for each query.  Nothing grows on the driver.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a
null id, take no part.  Vectors of different lengths are never compared.  Rows that repeat an
id count as one candidate at their least distance.  Ties go to the smaller id.  Vectors may be
as long as they like; a segment of them is held in memory.  An empty table gives an empty
result.  Extra columns are not read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import drawn, shared_dir, stored
from plumbline.llm.media import filesystem

BITS = 256
#: Rows the codes are learned from, at most about this many (chosen by a hash of the id).
SAMPLE = 16_384
SAMPLE_QUERIES = 256
RADIUS_QUANTILE = 0.985
SEGMENT = 65_536
BLOCK = 2_048

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_BALL = _POP[np.arange(256)[:, None] ^ np.arange(256)[None, :]]  # Hamming distance of two bytes


def nearest_ids(ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k ids with the least distances, the nearest row of each, in order; ties go to the smaller id."""
    order, n = np.lexsort([ids, d]), k
    while True:
        first = np.unique(ids[order[:n]], return_index=True)[1]
        if len(first) >= k or n >= len(order):
            return order[np.sort(first)[:k]]
        n *= 4


class Codes:
    """Centre and rotations of vectors of one length, with the search radius."""

    def __init__(self, x: np.ndarray, k: int, bits: int = BITS, seed: int = 7, ids: np.ndarray | None = None):
        ids = np.arange(len(x)) if ids is None else ids
        rng = np.random.default_rng(seed)
        self.mean = x.mean(0)
        v, dim = (x - self.mean).astype(np.float64), x.shape[1]
        blocks, left = [], bits
        while left > 0:
            n = min(dim, left)
            basis = np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :n]
            p = v @ basis
            r = np.linalg.qr(rng.standard_normal((n, n)))[0]
            for _ in range(15):  # iterative quantisation: signs, then the rotation that fits them best
                u, _, w = np.linalg.svd(np.where(p @ r > 0, 1.0, -1.0).T @ p)
                r = (u @ w).T
            blocks.append(basis @ r)
            left -= n
        self.rotation = np.concatenate(blocks, 1).astype(np.float32)
        self.m = self.rotation.shape[1] // 8
        self.radius = bits
        codes = self.encode(x)
        near = []
        for i in rng.permutation(len(x))[:SAMPLE_QUERIES]:
            d = ((x - x[i]) ** 2).sum(1)
            other = np.flatnonzero(ids != ids[i])
            top = other[nearest_ids(ids[other], d[other], k)]
            near += _POP[codes[top] ^ codes[i]].sum(1, dtype=np.int64).tolist()
        if near:
            self.radius = int(np.quantile(near, RADIUS_QUANTILE, method="higher"))

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes as bytes, one substring a byte."""
        return np.packbits((x - self.mean).astype(np.float32) @ self.rotation > 0, axis=1)


class Index:
    """The inverted lists of one segment."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: Codes | None):
        self.ids, self.x, self.codes = ids, x.astype(np.float64), codes
        self.repeats = len(np.unique(ids)) < len(ids)
        if codes is not None:
            self.code = codes.encode(x)
            self.lists, self.bounds = [], []
            for j in range(codes.m):
                order = np.argsort(self.code[:, j], kind="stable")
                self.lists.append(order.astype(np.int32))
                self.bounds.append(np.searchsorted(self.code[order, j], np.arange(257)))

    def candidates(self, qid: int, q: np.ndarray, k: int) -> np.ndarray:
        """Rows of other ids within the radius of a code: probe every substring's values up to radius // m bits away."""
        reach, hit = self.codes.radius // self.codes.m, np.zeros(len(self.ids), bool)
        for j, value in enumerate(q.tolist()):
            order, at = self.lists[j], self.bounds[j]
            for v in np.flatnonzero(_BALL[value] <= reach).tolist():
                hit[order[at[v] : at[v + 1]]] = True
        rows = np.flatnonzero(hit)
        near = _POP[self.code[rows] ^ q].sum(1, dtype=np.int16)
        rows = rows[(near <= self.codes.radius) & (self.ids[rows] != qid)]
        if len(rows) < k or (self.repeats and len(np.unique(self.ids[rows])) < k):
            rows = np.flatnonzero(self.ids != qid)
            far = _POP[self.code[rows] ^ q].sum(1, dtype=np.int64)
            if len(kept := nearest_ids(self.ids[rows], far, k)):
                rows = rows[far <= far[kept[-1]]]
        return rows

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
        codes = self.codes.encode(queries) if self.codes is not None else None
        for i, (qid, q) in enumerate(zip(query_ids.tolist(), queries.astype(np.float64), strict=True)):
            rows = self.candidates(qid, codes[i], k) if codes is not None else np.flatnonzero(self.ids != qid)
            d = np.sqrt(((self.x[rows] - q) ** 2).sum(1))
            ids = self.ids[rows]
            for j in nearest_ids(ids, d, k).tolist():
                yield qid, int(ids[j]), float(d[j])


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x) of the vectors that take part, in single or, if they are given so, in double precision."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    return vectors.select(F.col(id_col).cast("long").alias("id"), x.cast(kind).alias("x")).filter(x.isNotNull() & F.col(id_col).isNotNull() & ~bad & F.exists(x, lambda c: c != 0))


def fit(rows: DataFrame, k: int, sample: int = SAMPLE) -> dict[int, Codes]:
    """Codes by vector length, learned from about ``sample`` rows chosen by a hash of the id; copies of a row count once.

    Every length gets an equal share of the sample, of 8 k rows at least; lengths should be few.  One with
    no more than k other ids in its sample has no codes, and its rows are compared one by one.
    """
    counts = {r.d: r.n for r in rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.coalesce(*[F.when(F.size("x") == d, F.lit(min(1.0, max(sample / len(counts), 8 * k) / n))) for d, n in sorted(counts.items())])
    picked = rows.filter(drawn("id", 11) < share).distinct().toArrow()
    by: dict[int, list] = {}
    for i, x in sorted(zip(picked["id"].to_pylist(), picked["x"].to_pylist(), strict=True)):
        by.setdefault(len(x), []).append((i, x))
    parts = {d: (np.array([i for i, _ in v]), np.asarray([x for _, x in v], np.float64)) for d, v in by.items()}
    return {d: Codes(x, k, ids=ids) for d, (ids, x) in parts.items() if len(np.unique(ids)) > k + 1}


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the rows of each vector length."""
    ids, x = np.asarray(batch.column("id")), batch.column("x")
    lens = np.asarray(x.value_lengths())
    for d in np.unique(lens).tolist():
        at = np.flatnonzero(lens == d)
        yield ids[at], np.asarray(x.take(pa.array(at)).flatten()).reshape(-1, d)


def nearest(queries: DataFrame, rows: DataFrame, k: int = 10, models: dict[int, Codes] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest rows with another id; both frames are (id, x)."""
    models = fit(rows, k) if models is None else models
    folder = shared_dir(rows.sparkSession, "queries")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        names = []
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                for ids, x in _matrices(b.slice(at, BLOCK)):
                    path = os.path.join(base, f"{uuid.uuid4().hex}.block")
                    with fs.open_output_stream(path) as f:
                        f.write(np.int64([len(ids), x.shape[1]]).tobytes() + ids.astype("<i8").tobytes() + x.astype("<f8").tobytes())
                    names.append(path)
        yield pa.record_batch([pa.array(names, pa.string())], names=["path"])

    # only blocks of the attempts that count are listed; others lie unused
    blocks = stored(queries.mapInArrow(write, "path string").agg(F.sort_array(F.collect_list("path")).alias("paths")), "blocks")
    paths = blocks.first()[0]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        held: dict[int, list] = {}

        def run(d: int) -> Iterator[pa.RecordBatch]:
            ids, x = (np.concatenate(c) for c in zip(*held.pop(d), strict=True))
            index = Index(ids, x, models.get(d))
            for path in paths:
                with fs.open_input_stream(path) as f:
                    data = f.read()
                n, dim = np.frombuffer(data, "<i8", 2).tolist()
                if dim == d:
                    found = [*index.search(np.frombuffer(data, "<i8", n, 16), np.frombuffer(data, "<f8", n * dim, 16 + 8 * n).reshape(n, dim), k)]
                    columns = zip(*found, strict=True) if found else [()] * 3
                    yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

        for b in batches:
            for ids, x in _matrices(b):
                held.setdefault(x.shape[1], []).append((ids, x))
                if sum(len(i) for i, _ in held[x.shape[1]]) >= SEGMENT:
                    yield from run(x.shape[1])
        for d in list(held):
            yield from run(d)

    found = rows.mapInArrow(search, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
