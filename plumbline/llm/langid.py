"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: hashed 1- to 3-grams of letters (lower-cased; anything else is a gap), with
logarithmic counts, inverse document frequencies over all rows to learn from, and unit
length.  Training: follow-the-regularised-leader with an elastic-net penalty on a bounded
sample of labelled rows, equal shares for each language; a part of the sample is set aside
to calibrate the temperature of the class probabilities.

Texts that are null or have no letter get ``und`` with score 0; so does every text if there
is nothing to learn from.  Rows are scored one by one from their text alone, so repeated rows
get equal results and ids or extra columns do not matter; earlier columns lang_pred and score
are replaced.  Of equally likely languages the first in order is given.  Long texts are read
whole.  An empty table gives an empty result.  The languages learned should be few: there is a
row of weights and a branch of a condition for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from plumbline.llm.common import drawn, slices

FEATURES = 1 << 16
#: Labelled rows the classifier is fitted on, at most about this many.
SAMPLE = 6_000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.05, 0.02
CALIBRATION_SHARE = 5  # every fifth row of the sample


def _letters() -> np.ndarray:
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_LETTER: list[np.ndarray] = []


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their counts; both empty if there is no letter."""
    if not _LETTER:
        _LETTER.append(_letters())
    c = _LETTER[0][np.frombuffer((text or "").encode("utf-32-le", "replace"), "<u4")]
    if not c.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.concatenate([[0], c, [0]]).astype(np.uint32)
    some = c > 0
    h, seen, out = np.zeros(len(c), np.uint32), np.zeros(len(c), bool), []
    for n in range(1, 4):
        m = len(c) - n + 1
        h = (h[:m] * np.uint32(0x9E3779B1)) ^ (c[n - 1 :] * np.uint32(0x85EBCA6B) + np.uint32(n))
        seen = seen[:m] | some[n - 1 :]
        x = h[seen]
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out.append((x >> np.uint32(16)).astype(np.int64))
    counts = np.bincount(np.concatenate(out), minlength=FEATURES)
    f = np.flatnonzero(counts)
    return f, counts[f]


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray):
        self.langs, self.idf = langs, idf
        self.w = np.zeros((FEATURES, len(langs)))
        self.bias = np.zeros(len(langs))
        self.temperature = 1.0

    def vector(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The vector of a text's features and their counts."""
        f, n = found
        v = np.log1p(n) * self.idf[f]
        return f, v / max(float(np.sqrt((v * v).sum())), 1e-12)

    def logits(self, x: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return x[1] @ self.w[x[0]] + self.bias

    def fit(self, found: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> None:
        """Follow the regularised leader, one row at a time, then calibrate on the rows set aside."""
        data = [(self.vector(x), y) for x, y in zip(found, labels, strict=True)]
        held, data = data[::CALIBRATION_SHARE], [d for i, d in enumerate(data) if i % CALIBRATION_SHARE] or data
        z, s = np.zeros_like(self.w), np.zeros_like(self.w)
        rng = np.random.default_rng(0)
        for _ in range(EPOCHS):
            for i in rng.permutation(len(data)):
                ((f, v), y) = data[i]
                zf, sf = z[f], s[f]
                w = np.where(np.abs(zf) <= L1, 0.0, -(zf - np.sign(zf) * L1) / ((BETA + np.sqrt(sf)) / ALPHA + L2))
                p = softmax(v @ w)
                p[y] -= 1
                g = v[:, None] * p
                new = sf + g * g
                z[f] = zf + g - (np.sqrt(new) - np.sqrt(sf)) / ALPHA * w
                s[f] = new
        self.w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(s)) / ALPHA + L2))
        scores = np.array([self.logits(x) for x, _ in held]).reshape(-1, len(self.langs))
        ys = np.array([y for _, y in held], int)

        def loss(t: float) -> float:
            p = softmax(scores / t)
            return -float(np.log(np.maximum(p[np.arange(len(ys)), ys], 1e-12)).mean()) if len(ys) else 0.0

        self.temperature = min(np.geomspace(0.05, 4, 60), key=loss)
        self.w = self.w.astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        x = self.vector(grams(text))
        if not len(x[0]) or not self.langs:
            return "und", 0.0
        p = softmax(self.logits(x).astype(np.float64) / self.temperature)
        k = int(np.argmax(p))
        return self.langs[k], float(min(1.0, p[k]))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def frequencies(texts: DataFrame) -> np.ndarray:
    """Number of rows that hold each feature, over all rows of (text): summed within partitions, then across them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(FEATURES, np.int64)
        for b in batches:
            for t in b.column("text").to_pylist():
                df[grams(t)[0]] += 1
        f = np.flatnonzero(df)
        yield pa.record_batch([pa.array(f), pa.array(df[f])], names=["feature", "n"])

    out = np.zeros(FEATURES, np.int64)
    got = texts.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out[got["feature"].to_numpy()] = got["n"].to_numpy()
    return out


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from the rows for which ``learn`` holds; document frequencies from all of them, weights from a bounded sample."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    n = sum(counts.values())
    idf = np.log((1 + n) / (1 + frequencies(rows.select("text")))) + 1
    model = Model(langs, idf.astype(np.float32))
    if not langs:
        return model
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, sample / len(langs) / counts[x]))) for x in langs])
    kind = rows.schema["doc_id"].dataType.simpleString()
    picked = rows.filter(drawn("doc_id", 3) < share).mapInArrow(_features, f"doc_id {kind}, digest binary, lang string, features binary, counts binary").toArrow()
    got = sorted(zip(*(picked[c].to_pylist() for c in ("doc_id", "digest", "lang", "features", "counts")), strict=True), key=lambda r: (str(r[0]), r[1:3]))
    model.fit([(np.frombuffer(f, np.uint16).astype(np.int64), np.frombuffer(n, np.int32)) for *_, f, n in got], [langs.index(r[2]) for r in got])
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the driver needs of each sampled row: its features, of which there are FEATURES at most, however long the text is."""
    for b in (x for batch in batches for x in slices(batch)):
        texts = b.column("text").to_pylist()
        got = [grams(t) for t in texts]
        digests = [hashlib.blake2b(t.encode(), digest_size=8).digest() for t in texts]
        columns = [b.column("doc_id"), pa.array(digests, pa.binary()), b.column("lang"), pa.array([f.astype(np.uint16).tobytes() for f, _ in got], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in got], pa.binary())]
        yield pa.record_batch(columns, names=["doc_id", "digest", "lang", "features", "counts"])


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` (but own earlier ones of these names), and lang_pred and score."""
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch, text_col)):
            got = [shared.value.predict(t) for t in b.column(text_col).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
