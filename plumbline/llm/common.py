"""Helpers shared by the training-data operators: tables, the shared folder, Arrow batches, hashing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sub-batches handed to the vectorised kernels hold about this many bytes of text.
BATCH_BYTES = 4 << 20
#: Bytes of a Parquet row group that a task fills before it writes it, and rows that a task decodes at once.
ROW_GROUP, READ_ROWS = 16 << 20, 512

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_buffers(spark: SparkSession) -> None:
    """From now on, tasks of this session that read and write whole texts hold little of them, where the session has no such settings of its own.

    By Spark's defaults a task holds a row group of up to 128 MB that it reads, one as large that it
    writes, and 4,096 decoded rows; eight such tasks do not fit a heap of 1 GB, Spark's default.
    A plan takes these settings when it runs, so they can't be put back before the caller has written the rows.
    """
    if spark.conf.get("parquet.block.size", None) is None and spark.sparkContext._jsc.hadoopConfiguration().get("parquet.block.size") is None:
        spark.conf.set("parquet.block.size", str(ROW_GROUP))
    if spark.conf.get("spark.sql.parquet.columnarReaderBatchSize", None) is None:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which driver and executors share.

    Where that is unset, as in tests, a session on one machine gets a temporary folder; on a
    cluster, where executors would not see it, that is an error.  The folders of a session are deleted when the driver's Python ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _made:
        try:
            jvm, jsc = spark._jvm, spark.sparkContext._jsc
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone by now; leftovers are then the cluster's to sweep
            return


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold_of(doc_id, k: int):
    """crc32 of the id as text, modulo k; the rule by which rows are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def drawn(column: str, seed: int):
    """A hashed number from 0 up to 1 for each value of a column, to draw shares of rows, however small, by."""
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def slices(batch: pa.RecordBatch, column: str = "text", size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into runs of rows of about ``size`` text bytes; a longer text forms a run alone."""
    n = batch.num_rows
    if not n:
        return
    text = batch.column(column)
    lens = np.asarray(pc.fill_null(pc.binary_length(text), 0)).astype(np.int64)
    at, total = 0, 0
    for i, x in enumerate(lens.tolist()):
        if i > at and total + x > size:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += x
    yield batch.slice(at)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser over an array of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
