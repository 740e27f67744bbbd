"""Queries that write files' texts and read them back, each with SQL from what was written."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import fixtures
from plumbline.operators import stereo
from plumbline.plans.geometry import NATIONS, _r, _round, nations
from plumbline.sources import models, tables

_NUMBERS = ["1000 + 10 * k", "1010 + 10 * k", "500 + k", "400 - k", "0.01 * k", "-0.002 * k", "0.001", "-0.001"]
_POSE = ["0.01 * k", "0.02", "-0.03", "k", "2", "-3"]


def _models(spark, d, lensmodel: str, numbers: list[str]) -> DataFrame:
    one = lambda xs: F.array(*[F.expr(f"CAST({x} AS DOUBLE)") for x in xs])
    return nations(spark, d).select(F.format_string("m%02d", "k").alias("name"), F.lit(lensmodel).alias("lensmodel"), one(numbers).alias("intrinsics"), F.array(F.col("k") + 640, F.lit(480)).alias("imagersize"), one(_POSE).alias("rt_cam_ref"))


def _described(rows: DataFrame, n: int) -> DataFrame:
    return rows.select("name", "lensmodel", *[F.col("imagersize")[i].alias(s) for i, s in enumerate(("width", "height"))], *[(F.round(F.col("intrinsics")[i], 6) + 0.0).alias(f"i{i}") for i in range(n)], *[(F.round(F.col("rt_cam_ref")[i], 6) + 0.0).alias(f"o{i}") for i in range(6)])


def _described_sql(lensmodel: str, numbers: list[str], pose: list[str], name: str = "'m' || lpad(CAST(k AS VARCHAR), 2, '0')", source: str = NATIONS, width: str = "k + 640") -> str:
    parts = {f"i{i}": f"CAST({x} AS DOUBLE)" for i, x in enumerate(numbers)} | {f"o{i}": f"CAST({x} AS DOUBLE)" for i, x in enumerate(pose)}
    return f"SELECT {name} AS name, '{lensmodel}' AS lensmodel, CAST({width} AS INTEGER) AS width, 480 AS height, {_round(parts)} FROM {source}"


def _again(rows: DataFrame, form: str) -> DataFrame:
    return models.parse_table(models.format_table(rows, form), form, "name")


def native_models(spark, d) -> DataFrame:
    return _described(_again(_models(spark, d, "LENSMODEL_OPENCV4", _NUMBERS), "native"), 8)


_CAHVOR = [*_NUMBERS[:4], "0.01", "-0.02", "0.001 * k + 0.001", "0.002", "0.003"]


def cahvor_models(spark, d) -> DataFrame:
    return _described(_again(_models(spark, d, "LENSMODEL_CAHVOR", _CAHVOR), "cahvor"), 9)


def cahvore_models(spark, d) -> DataFrame:
    return _described(_again(_models(spark, d, "LENSMODEL_CAHVORE_linearity=0.37", [*_CAHVOR, "0.01", "0.02", "0.001 * k"]), "cahvor"), 12)


def kalibr_models(spark, d) -> DataFrame:
    """Chains of two cameras: the second stands by the first."""
    text = """concat('cam0:\\n  camera_model: pinhole\\n  intrinsics: [', 1000 + 10 * k, ', 1010.5, 500, 400]\\n  distortion_model: radtan\\n  distortion_coeffs: [0.1, 0.2, ', 0.001 * k, ', 0.01]\\n  resolution: [', k + 640, ', 480]\\n',
        'cam1:\\n  camera_model: pinhole\\n  intrinsics: [', 1000 + 10 * k, ', 1010.5, 500, 400]\\n  distortion_model: radtan\\n  distortion_coeffs: [0.1, 0.2, ', 0.001 * k, ', 0.01]\\n  resolution: [', k + 640, ', 480]\\n  T_cn_cnm1:\\n  - [1.0, 0.0, 0.0, ', -0.5 - k, ']\\n  - [0.0, 1.0, 0.0, 0.25]\\n  - [0.0, 0.0, 1.0, 0.125]\\n  - [0.0, 0.0, 0.0, 1.0]\\n')"""
    rows = models.parse_table(nations(spark, d).select(F.format_string("m%02d.yaml", "k").alias("path"), F.expr(text).alias("value")), "kalibr")
    return _described(rows.withColumn("name", F.concat(F.substring("path", 1, 3), F.lit("-"), "name")), 8)


def kalibr_written(spark, d) -> DataFrame:
    return _described(_again(_models(spark, d, "LENSMODEL_OPENCV4", _NUMBERS), "kalibr"), 8)


def ros_models(spark, d) -> DataFrame:
    text = """concat('image_width: ', k + 640, '\\nimage_height: 480\\ncamera_name: c\\ncamera_matrix:\\n  rows: 3\\n  cols: 3\\n  data: [', 1000 + 10 * k, ', 0, 500.5, 0, 1010, 400, 0, 0, 1]\\ndistortion_model: plumb_bob\\n',
        'distortion_coefficients:\\n  rows: 1\\n  cols: 5\\n  data: [0.1, 0.2, ', 0.001 * k, ', 0.01, 0.02]\\nrectification_matrix:\\n  rows: 3\\n  cols: 3\\n  data: [1, 0, 0, 0, 1, 0, 0, 0, 1]\\n')"""
    return _described(models.parse_table(nations(spark, d).select(F.format_string("m%02d", "k").alias("path"), F.expr(text).alias("value")), "ros"), 9)


def transforms(spark, d) -> DataFrame:
    """Poses of a vehicle and of two cameras: turns about z by unit quaternions of whole numbers over 5."""
    text = F.expr("concat('# poses\\n\\nins2veh = (', k, ' 2 3.5) (0.8 0 0 0.6)\\ncam2ins[1] = (1 ', 0.5 * k, ' -3) (0.6 0 0 0.8)\\ncam2ins[', k + 2, '] = (0 0 0) (1 0 0 0)\\n')")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, t in zip(b.column("k").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = models.parse_transforms(t)
                out.append([k, *found["veh_from_ins"].ravel(), *found["ins_from_camera"][1].ravel(), float(max(found["ins_from_camera"]))])
            columns = zip(*out, strict=True)
            yield pa.record_batch([pa.array(list(c), pa.int32() if i == 0 else pa.float64()) for i, c in enumerate(columns)], names=["k", *[f"o{i}" for i in range(25)]])

    names = [f"o{i}" for i in range(25)]
    rows = nations(spark, d).select("k", text.alias("text")).mapInArrow(run, ", ".join(["k int", *[f"{n} double" for n in names]]))
    return _r(rows, ["k"], names)


def corner_file(spark, d) -> DataFrame:
    """Lines of a corner table with levels, missing corners and comments."""
    rows = fixtures.corners(spark, d).withColumn("n", F.col("idx") % 4)
    cents = F.round(F.col("x") * 100).cast("long")
    text = F.when(F.col("n") == 3, F.lit("# a comment")).otherwise(F.concat_ws(" ", F.format_string("frame%d-cam%d.png", "frame", "cam"), F.when(F.col("n") == 2, "-").otherwise(cents.cast("string")), F.when(F.col("n") == 2, "-").otherwise(F.col("y").cast("long").cast("string")), F.when(F.col("n") == 0, "0").when(F.col("n") == 1, "2").otherwise("-")))
    parsed = tables.parse_corners(rows.select(F.lit("f").alias("file"), F.col("idx").alias("line"), text.alias("text")))
    return tables.assign_cameras(parsed, ["*-cam0.png", "frame*-cam1.png", "*-cam[23].png"]).select("filename", "line", "x", "y", "w", "cam")


def png_images(spark, d) -> DataFrame:
    """Images of vectors, grey and in colour, written as PNG, PGM and PPM and read back."""
    v = fixtures.vectors(spark, d).select("vec_id", F.transform("e", lambda c: F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)) + 1) * 127).cast("int")).alias("px"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, px in zip(b.column("vec_id").to_pylist(), b.column("px").to_pylist(), strict=True):
                a = np.array(px[:64], np.uint8).reshape(8, 8)
                deep, color = a.astype(np.uint16) * 257, np.stack([a, a.T, 255 - a], -1)
                read = [tables.decode_image(tables.encode_image(x, end)) for x, end in ((a, "png"), (deep, "png"), (color, "png"), (deep, "pgm"), (color, "ppm"))]
                w = np.arange(1, 65)
                out.append([i, *[int((x.astype(np.int64).reshape(64, -1).sum(1) * w).sum()) for x in read]])
            yield pa.record_batch([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], names=["vec_id", "grey", "deep", "color", "pgm", "ppm"])

    return v.mapInArrow(run, "vec_id long, grey long, deep long, color long, pgm long, ppm long")


def point_cloud(spark, d) -> DataFrame:
    """Sizes of binary PLY texts of the points of each label, and their last coordinate."""
    e = fixtures.read(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("e"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        p = np.array([x[:3] for x in rows.column("e").to_pylist()])
        data = tables.ply_bytes(p, np.zeros(len(p), np.uint8))
        body = data.index(b"end_header\n") + 11
        return pa.table({"label": pa.array([key[0].as_py()], key[0].type), "vertices": [int(data.split(b"element vertex ")[1].split(b"\n")[0])], "body": [len(data) - body], "last_z": [float(np.frombuffer(data[-7:-3], "<f4")[0])]})

    kind = e.schema["label"].dataType.simpleString()
    out = e.groupBy("label").applyInArrow(run, f"label {kind}, vertices long, body long, last_z double")
    return _r(out, ["label", "vertices", "body"], ["last_z"])


def match_feature(spark, d) -> DataFrame:
    """A patch that was moved by whole pixels, found again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in b.column("k").to_pylist():
                image = np.random.default_rng(k).uniform(0, 255, (60, 70))
                y, x = np.mgrid[:60, :70]
                image = image * 0.1 + 255 * np.exp(-((x - 30) ** 2 + (y - 28) ** 2) / 60)
                moved = np.roll(image, (k % 4 - 1, k % 5 - 2), (0, 1))
                q, _ = stereo.match_feature(image, moved, np.array([30.0, 28.0]), 6, (13, 13))
                out.append([k, *np.rint(q)])
            yield pa.record_batch([pa.array([int(v) for v in c], pa.int32()) for c in zip(*out, strict=True)], names=["k", "x", "y"])

    return nations(spark, d).mapInArrow(run, "k int, x int, y int")


QUERIES = (native_models, cahvor_models, cahvore_models, kalibr_models, kalibr_written, ros_models, transforms, corner_file, png_images, point_cloud, match_feature)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_PX = "(SELECT vec_id, i, CAST(floor((greatest(-1, least(1, CAST(embedding[i] AS DOUBLE))) + 1) * 127) AS BIGINT) AS v, CAST(floor((greatest(-1, least(1, CAST(embedding[((i - 1) % 8) * 8 + (i - 1) // 8 + 1] AS DOUBLE))) + 1) * 127) AS BIGINT) AS t FROM embeddings, range(1, 65) r(i)) p"
_TURN = "[0.28, -0.96, 0, 0.96, 0.28, 0, 0, 0, 1]", "[-0.28, -0.96, 0, 0.96, -0.28, 0, 0, 0, 1]"

SQL: dict[str, str] = {
    "native_models": _described_sql("LENSMODEL_OPENCV4", _NUMBERS, _POSE),
    "cahvor_models": _described_sql("LENSMODEL_CAHVOR", _CAHVOR, _POSE),
    "cahvore_models": _described_sql("LENSMODEL_CAHVORE_linearity=0.37", [*_CAHVOR, "0.01", "0.02", "0.001 * k"], _POSE),
    "kalibr_models": _described_sql("LENSMODEL_OPENCV4", ["1000 + 10 * k", "1010.5", "500", "400", "0.1", "0.2", "0.001 * k", "0.01"], ["0", "0", "0", "c * (-0.5 - k)", "c * 0.25", "c * 0.125"], "'m' || lpad(CAST(k AS VARCHAR), 2, '0') || '-cam' || c", f"{NATIONS}, (SELECT unnest([0, 1]) AS c) c"),
    "kalibr_written": _described_sql("LENSMODEL_OPENCV4", _NUMBERS, ["0"] * 6, "'cam0'"),
    "ros_models": _described_sql("LENSMODEL_OPENCV5", ["1000 + 10 * k", "1010", "500.5", "400", "0.1", "0.2", "0.001 * k", "0.01", "0.02"], ["0"] * 6),
    # a quaternion (c, 0, 0, s) turns by cos = c c - s s and sin = 2 c s
    "transforms": f"SELECT k, {_round({f'o{i}': f'CAST({x} AS DOUBLE)' for i, x in enumerate([0.28, -0.96, 0, 0.96, 0.28, 0, 0, 0, 1, 'k', 2, 3.5, -0.28, -0.96, 0, 0.96, -0.28, 0, 0, 0, 1, 1, '0.5 * k', -3, 'k + 2'])})} FROM {NATIONS}",
    "corner_file": f"SELECT 'frame' || frame || '-cam' || cam || '.png' AS filename, idx AS line, CASE WHEN idx % 4 < 2 THEN CAST(CAST(round(x * 100) AS BIGINT) AS DOUBLE) END AS x, CASE WHEN idx % 4 < 2 THEN floor(y) END AS y, CAST(CASE idx % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 ELSE -1.0 END AS DOUBLE) AS w, CASE WHEN cam > 1 THEN 2 ELSE cam END AS cam FROM ({fixtures.CORNER_SQL}) c WHERE idx % 4 < 3",
    "png_images": f"SELECT vec_id, CAST(sum(v * i) AS BIGINT) AS grey, CAST(sum(257 * v * i) AS BIGINT) AS deep, CAST(sum((255 + t) * i) AS BIGINT) AS color, CAST(sum(257 * v * i) AS BIGINT) AS pgm, CAST(sum((255 + t) * i) AS BIGINT) AS ppm FROM {_PX} GROUP BY vec_id",
    "point_cloud": "SELECT label, count(*) AS vertices, CAST(15 * count(*) AS BIGINT) AS body, round(CAST(arg_max(embedding[3], vec_id) AS DOUBLE), 6) + 0.0 AS last_z FROM embeddings GROUP BY label",
    "match_feature": f"SELECT k, CAST(30 + k % 5 - 2 AS INTEGER) AS x, CAST(28 + k % 4 - 1 AS INTEGER) AS y FROM {NATIONS}",
}


def oracle_sql() -> dict[str, str]:
    return SQL
