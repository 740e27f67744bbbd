"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch: in round i each shingle falls into a hashed bin of the sketch with a hashed value;
a bin keeps the least (round, value).  Rounds 0 to t-1 place freely and stop once all bins
are full; rounds t to 2t-1 would place every shingle into bin i-t, so every coordinate is
filled for certain.  Two sets agree in a coordinate with probability equal to their Jaccard
similarity, with the concentration of t independent draws or better.

Banding: BANDS bands of ROWS coordinates; at similarity 0.8 all bands differ with
probability (1 - 0.8^4)^32 < 5e-8.  Documents with equal sets form one class, and only
classes are compared; a class that shares no bucket is compared with nothing.

Cells: in each bucket, pairs whose sizes and sketches (four bits of each coordinate) allow the
threshold are joined, within a task, to trees; only the trees' edges leave the task.  A pair
at the threshold falls under the sketches' limit with probability 1e-10.  The components of
those edges are cells, and every link lies within one.  Buckets with equal members count once.

Verification: the full shingle sets of the documents in cells are sent once to the task of their
cell, where pairs that the sketches allow are confirmed exactly, unless they are joined
already; where very many must be, by products of matrices.  Only trees of confirmed links
leave the task.

Large groups: a bucket or cell of over BLOCK_ROWS rows (or BLOCK_SHINGLES shingles) is dealt to
blocks, and each pair of blocks meets in a group of its own, so no task gets it whole and no
table holds its pairs.  No pair is left out.

Null or empty texts and texts without words have an empty set and are linked with nothing.
A row with a null id is linked with nothing: its component is null and it is kept.  Rows
that share an id count as one document (linked if any of their texts is); each is kept if
the id is its component's smallest.  Ties do not arise: the smallest id is unique.  Very long
texts are read whole, in parts of PART bytes; their sets are as large as they are and are
held in memory one cell block at a time.  An empty table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import mix, seeds, slices, stored

COORDINATES, BANDS, ROWS = 128, 32, 4
#: Groups of more rows, or of more shingles, are dealt to blocks of about this size.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 22
#: Very large buckets, whose rows are short, have larger blocks, so that their rows are copied to fewer groups: from BLOCKS blocks on, up to WIDEST times the size.
BLOCKS, WIDEST = 64, 16
#: Texts are hashed in parts of about this many bytes; a longer word is hashed by itself.
PART = 1 << 18
#: Groups of more rows are compared one by one, smaller ones many at a time.
ALONE = 256
#: Standard deviations under the expected agreement at which two sketches no longer allow the threshold.
SIGMAS = 6.5

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = seeds(256, 1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BIN, _VALUE = seeds(2 * COORDINATES, 2), np.uint64((1 << 56) - 1)
_C = np.uint64(0xD6E8FEB86659FD93)

_powers: list[np.ndarray] = []


def _power() -> list[np.ndarray]:
    """Powers of the hash's base and of its inverse, as many as a part has bytes."""
    if not _powers:
        for base in (_BASE, _INVERSE):
            x = np.full(2 * PART, base, np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words (runs without ASCII white space, A-Z lower-cased) of a text, in order."""
    a = np.frombuffer((text or "").encode().translate(_LOWER), np.uint8)
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(a):
        end = min(at + PART, len(a))
        while end < len(a) and not _SPACE[a[end]]:  # a part ends at a border of words
            more = np.flatnonzero(_SPACE[a[end : end + PART]])
            end = end + int(more[0]) if len(more) else min(end + PART, len(a))
        out.append(_hashes(a[at:end]))
        at = end
    return np.concatenate(out)


def _hashes(a: np.ndarray) -> np.ndarray:
    space = np.concatenate([[True], _SPACE[a], [True]])
    starts, ends = np.flatnonzero(space[:-2] & ~space[1:-1]), np.flatnonzero(~space[1:-1] & space[2:]) + 1
    long = ends - starts >= PART
    if long.any():  # at most the last word of a part
        whole = [int.from_bytes(hashlib.blake2b(a[i:j].tobytes(), digest_size=8).digest(), "little") for i, j in zip(starts[long], ends[long], strict=True)]
        return np.concatenate([_hashes(a[: starts[long][0]]), np.array(whole, np.uint64)])
    power, inverse = _power()
    h = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * power[: len(a)], dtype=np.uint64)])
    return mix((h[ends] - h[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _C)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; all words as one where there are fewer; none without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        h = mix(h * _C + w[j : j + len(h)])
    return np.unique(h)


def sketch(s: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit hashes; the coordinate's upper byte is the round that filled it."""
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    step, i = max(1, min(t, 256 // len(s))), 0  # several rounds at a time for small sets; later rounds never replace earlier ones
    while i < t and (out == np.iinfo(np.uint64).max).any():
        j = min(i + step, t)
        h = mix(s[None, :] ^ _BIN[i:j, None])
        v = (np.arange(i, j, dtype=np.uint64)[:, None] << np.uint64(56)) | (h & _VALUE)
        np.minimum.at(out, ((h >> np.uint64(56)) % np.uint64(t)).astype(np.int64).ravel(), v.ravel())
        i = j
    for b in np.flatnonzero(out == np.iinfo(np.uint64).max).tolist():
        out[b] = (np.uint64(t) << np.uint64(56)) | (mix(s ^ _BIN[t + b]) & _VALUE).min()
    return out


def band_keys(sk: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    h = np.arange(bands, dtype=np.uint64)
    for j in range(rows):
        h = mix(h * _C + sk.reshape(bands, rows)[:, j])
    return h.view(np.int64)


def packed(sk: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate of a sketch, sixteen to an unsigned 64-bit word."""
    nibbles = (mix(sk) >> np.uint64(60)).reshape(-1, 16)
    return np.bitwise_or.reduce(nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Coordinates in which packed sketches (rows of a and b) differ."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64)


def most_differing(num: int, den: int) -> int:
    """Coordinates in which the packed sketches of sets at the threshold may differ; a sixteenth of those that differ agree by chance."""
    p = num / den + (1 - num / den) / 16
    return COORDINATES - int(COORDINATES * p - SIGMAS * (COORDINATES * p * (1 - p)) ** 0.5)


def signatures(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_id, bands, sketch): set_id is a 128-bit digest of the shingle set; all but the first two are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch)):
            rows = []
            for text in b.column("text").to_pylist():
                if len(s := shingles(text, k)):
                    sk = sketch(s)
                    rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), band_keys(sk).tolist(), packed(sk).tobytes()))
                else:
                    rows.append((0, None, None, None))
            n, ids, bands, sketches = zip(*rows, strict=True)
            columns = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.record_batch(columns, names=["doc_id", "n_shingles", "set_id", "bands", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_shingles long, set_id binary, bands array<long>, sketch binary")


# -- groups and their blocks -------------------------------------------------------------------
def meetings(rows: DataFrame, key: str, blocks) -> DataFrame:
    """``rows`` dealt to groups (key, lo, hi) in which every two rows of a key meet.

    A key of one block is one group.  Of more blocks each pair is a group, to which the rows of both
    are copied; two rows of the same block need only be compared in the one group where ``own`` holds.
    """
    b = F.greatest(blocks.cast("int"), F.lit(1))
    rows = rows.withColumn("blocks", b).withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    partners = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block")))
    rows = rows.withColumn("partner", F.explode(partners))
    own = (F.col("blocks") == 1) | (F.col("partner") == F.pmod(F.col("block") + 1, F.col("blocks")))
    rows = rows.withColumns({"own": own, "lo": F.least("block", "partner"), "hi": F.greatest("block", "partner")}).drop("blocks", "partner")
    return rows.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of whole groups of sorted rows with the numbers of their groups: large groups alone, small ones together."""
    rest: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        part = part.combine_chunks()
        at = _borders(part, key)
        yield from _runs(part.slice(0, at[-1]), at)
        rest = part.slice(at[-1])
        if rest.num_rows == 0:
            rest = None
    if rest is not None:
        yield from _runs(rest, np.concatenate([_borders(rest, key), [rest.num_rows]]))


def _borders(t: pa.Table, key: str) -> np.ndarray:
    """Where groups begin."""
    new = np.ones(t.num_rows, bool)
    if t.num_rows:
        new[1:] = False
        for c in (key, "lo", "hi"):
            codes = t.column(c).combine_chunks().dictionary_encode()
            codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
            x = np.asarray(codes.indices)
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _runs(t: pa.Table, at: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """``at``: where the groups of t begin, and the end of t."""
    i = 0
    while i < len(at) - 1:
        j = i + 1
        while j < len(at) - 1 and at[j + 1] - at[i] <= ALONE:
            j += 1
        if at[j] - at[i] > 1:
            yield t.slice(at[i], at[j] - at[i]), np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
        i = j


def allowed(t: pa.Table, group: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of a group whose sizes and sketches allow the threshold, and in how many coordinates they differ."""
    n, block, own = (np.asarray(t.column(c).combine_chunks()) for c in ("n_shingles", "block", "own"))
    sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(n), -1)
    most, found, d = most_differing(num, den), [], 1
    a = np.arange(len(n) - 1)
    while len(a := a[a + d < len(n)]) and len(a := a[group[a] == group[a + d]]):
        b = a + d
        fits = (den * np.minimum(n[a], n[b]) >= num * np.maximum(n[a], n[b])) & ((block[a] != block[b]) | own[a])
        x, y = a[fits], b[fits]
        apart = differing(sk[x], sk[y])
        near = apart <= most
        found.append((x[near], y[near], apart[near]))
        d += 1
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def roots_of(n: int, a: np.ndarray, b: np.ndarray, roots: np.ndarray | None = None) -> np.ndarray:
    """The least row of each row's component, given pairs of rows."""
    r = np.arange(n) if roots is None else roots.copy()
    while len(a):
        x, y = r[a], r[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(r, np.maximum(x, y), np.minimum(x, y))
        while (r != (up := r[r])).any():
            r = up
    return r


def edges(ids: pa.Array, roots: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(roots != np.arange(len(roots)))
    return pa.record_batch([ids.take(pa.array(roots[at])), ids.take(pa.array(at))], names=["a", "b"])


def confirmed(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, apart: np.ndarray, num: int, den: int) -> np.ndarray:
    """Roots of the components of those pairs (a, b) that have den * intersection >= num * union."""
    n = len(sets)

    def linked(i: int, j: int) -> bool:
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return den * both >= num * (len(sets[i]) + len(sets[j]) - both)

    # every row with its most similar one first
    order = np.lexsort([a, apart, b])
    first = order[np.unique(b[order], return_index=True)[1]]
    ok = np.array([linked(i, j) for i, j in zip(a[first].tolist(), b[first].tolist(), strict=True)], bool)
    roots = roots_of(n, a[first[ok]], b[first[ok]])
    left = np.ones(len(a), bool)
    left[first] = False
    left &= roots[a] != roots[b]
    a, b, apart = a[left], b[left], apart[left]
    if not len(a):
        return roots
    lens = np.array([len(s) for s in sets])
    one_by_one = (2e-5 + 2e-8 * (lens[a] + lens[b])).sum()
    rows = np.unique(np.concatenate([a, b]))
    words, column, count = np.unique(np.concatenate([sets[i] for i in rows]), return_inverse=True, return_counts=True)
    common = count > 1  # others are in no intersection
    if len(a) > 8 * n and 1e-10 * len(rows) ** 2 * common.sum() < one_by_one:
        place = np.cumsum(common) - 1
        row = np.repeat(np.arange(len(rows)), lens[rows])[common[column]]
        column = place[column[common[column]]]
        both = np.zeros((len(rows), len(rows)))
        step = min(1 << 23, max(256, (1 << 23) // len(rows)))  # single precision is exact up to 2^24
        for c in range(0, int(common.sum()), step):
            m = np.zeros((len(rows), step), np.float32)
            here = (column >= c) & (column < c + step)
            m[row[here], column[here] - c] = 1
            both += m @ m.T
        i, j = np.searchsorted(rows, a), np.searchsorted(rows, b)
        shared = both[i, j].astype(np.int64)
        ok = den * shared >= num * (lens[a] + lens[b] - shared)
        return roots_of(n, a[ok], b[ok], roots)
    parent = roots.tolist()

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = np.argsort(apart, kind="stable")
    for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y and linked(i, j):
            parent[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(n)])


def trees(groups: DataFrame, key: str, num: int, den: int, exact: bool) -> DataFrame:
    """Edges (a, b) of trees that join, in each group, the rows whose pairs the sketches allow or, if ``exact``, whose sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in grouped(batches, key):
            a, b, apart = allowed(t, group, num, den)
            if len(a):
                sets = [np.frombuffer(x, np.uint64) for x in t.column("words").to_pylist()] if exact else []
                roots = confirmed(sets, a, b, apart, num, den) if exact else roots_of(len(group), a, b)
                yield edges(t.column("id").combine_chunks(), roots)

    kind = groups.schema["id"].dataType.simpleString()
    return groups.mapInArrow(run, f"a {kind}, b {kind}")


def with_sets(texts: DataFrame, k: int) -> DataFrame:
    """``texts`` with the shingle set (words) in place of the text."""
    names = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch)):
            words = [shingles(t, k).tobytes() for t in b.column("text").to_pylist()]
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(words, pa.binary())], names=[*names, "words"])

    return texts.mapInArrow(run, ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in names) + ", words binary")


def components(links: DataFrame) -> DataFrame:
    """(id, root) of all ids in ``links`` (a, b): contraction by the least neighbour, on the cluster alone.

    The first round takes the least id, which settles stars about their smallest member; later
    rounds take a hashed order, so that long chains shrink by a constant factor a round.
    """
    steps: list[DataFrame] = []
    edges = links.filter("a <> b")
    while True:
        order = F.col if not steps else F.xxhash64
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("id")).agg(F.min(F.struct(order("b").alias("h"), F.col("b").alias("id"))).alias("near"))
        own = F.struct(order("id").alias("h"), F.col("id").alias("id"))
        to = stored(near.select("id", F.least("near", own)["id"].alias("root")), "contract")
        steps.append(to)
        edges = edges.join(to.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(to.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
        edges = stored(edges.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        if edges.isEmpty():
            break
    out = steps[0]
    for to in steps[1:]:
        out = follow(out, to)
    return out


def follow(roots: DataFrame, further: DataFrame) -> DataFrame:
    """(id, root) with each root replaced by its own root, where it has one."""
    return roots.join(further.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left").select("id", F.coalesce("next", "root").alias("root"))


def cells_of(classes: DataFrame, num: int, den: int) -> DataFrame | None:
    """(id, root) of the classes that share a bucket with one that the sketches allow."""
    rows = classes.select("id", "set_id", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(rows.select("id", F.xxhash64("set_id").alias("h1"), F.xxhash64("set_id", F.lit(1)).alias("h2"), "key").join(buckets.select("key"), "key"), "buckets")
    # buckets with equal members count once
    buckets = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h1").alias("x"), F.bit_xor("h2").alias("y"))
    buckets = buckets.groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    members = shared.select("id", "key", "h1").join(buckets.select("key", "n"), "key")
    sketches = classes.select("id", F.xxhash64("set_id").alias("h1"), "n_shingles", "sketch")
    members = members.join(sketches, ["id", "h1"]).select("key", "id", "n", "n_shingles", "sketch")
    size = F.greatest(F.lit(float(BLOCK_ROWS)), F.least(F.col("n") / BLOCKS, F.lit(float(BLOCK_ROWS * WIDEST))))
    links = stored(trees(meetings(members, "key", F.ceil(F.col("n") / size)), "key", num, den, exact=False), "allowed")
    return components(links)


def near_duplicates(docs: DataFrame, k: int, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    sig = stored(signatures(docs, k, id_col, text_col), "signatures")
    named = sig.filter("set_id is not null and doc_id is not null")
    classes = stored(named.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    cells = stored(cells_of(classes, num, den).withColumnRenamed("root", "cell"), "cells")
    cells = cells.join(classes.select("id", "n_shingles", "sketch"), "id")
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"))
    sizes = sizes.select("cell", F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.least("n", F.ceil(F.col("total") / BLOCK_SHINGLES))).alias("n_blocks"))
    cells = cells.join(sizes, "cell")
    # whole texts stream past the rows of the cells, which are hashed
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(cells.hint("shuffle_hash"), "id")
    met = meetings(with_sets(texts, k), "cell", F.col("n_blocks"))
    links = trees(met, "cell", num, den, exact=True)
    # an id with several texts joins their classes
    several = named.groupBy("doc_id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).filter("lo <> hi").select("doc_id")
    own = named.join(several, "doc_id", "left_semi").join(classes.select("set_id", "id"), "set_id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    roots = components(stored(links.unionByName(own), "links"))
    least = roots.groupBy("root").agg(F.min("id").alias("component_id"))
    comp = roots.join(least, "root").select(F.col("id").alias("rep"), "component_id")
    out = sig.select("doc_id", "n_shingles", "set_id").join(classes.select("set_id", F.col("id").alias("rep")), "set_id", "left")
    out = out.withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    out = out.join(comp, "rep", "left").withColumn("component_id", F.coalesce("component_id", "rep"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
