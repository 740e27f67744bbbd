"""Calibration-shaped tables, derived by plain arithmetic from the test tables; the same rules as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"]

CORNER_SQL = f"""
SELECT l_orderkey AS frame, CAST(l_suppkey % 4 AS INTEGER) AS cam,
       CAST(row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 4 ORDER BY {", ".join(ORDER)}) - 1 AS INTEGER) AS idx,
       CAST(l_extendedprice AS DOUBLE) - 4000 * floor(CAST(l_extendedprice AS DOUBLE) / 4000) AS x,
       CAST(l_quantity AS DOUBLE) * 40 AS y,
       (10 - CAST(round(l_discount * 100) AS INTEGER)) / 10.0 AS w
FROM lineitem"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, cam, idx, x, y, w): a corner a line item; weight 0 is an outlier."""
    rows = read(spark, sf_dir, "lineitem").select(*ORDER, "l_discount").withColumn("cam", (F.col("l_suppkey") % 4).cast("int"))
    price = F.col("l_extendedprice").cast("double")
    order = Window.partitionBy("l_orderkey", "cam").orderBy(*ORDER)
    return rows.select(
        F.col("l_orderkey").alias("frame"),
        "cam",
        (F.row_number().over(order) - 1).alias("idx"),
        (price - 4000 * F.floor(price / 4000)).alias("x"),
        (F.col("l_quantity").cast("double") * 40).alias("y"),
        ((10 - F.round(F.col("l_discount") * 100).cast("int")) / 10.0).alias("w"),
    )


#: For each corner, a board of 100 mm pitch at 2 m to 5 m, seen by a camera with fixed intrinsics.
CAMERA = {"f": 1800.0, "cx": 1999.5, "cy": 999.5}
RESIDUAL_SQL = f"""
SELECT frame, cam, idx, x, y, w,
       CASE WHEN w >= 0 THEN w * (px - x) ELSE 0 END AS dx,
       CASE WHEN w >= 0 THEN w * (py - y) ELSE 0 END AS dy
FROM (SELECT *, {CAMERA["f"]} * ((idx % 3) * 0.1 + (cam - 1.5) * 0.2) / (2.0 + (frame % 7) * 0.5) + {CAMERA["cx"]} AS px,
             {CAMERA["f"]} * (floor(idx / 3) * 0.1) / (2.0 + (frame % 7) * 0.5) + {CAMERA["cy"]} AS py FROM ({CORNER_SQL}) c) p"""


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners with weighted residuals (dx, dy): observations joined with frame and camera tables, projected, less what was seen.

    Offsets and order of operations give the pixels of RESIDUAL_SQL to the last bit, as residuals at the border of a bin need.
    """
    from plumbline.functions.lens import project_pinhole_late
    from plumbline.operators.observations import board_residuals

    seen = corners(spark, sf_dir)
    frames = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame")).distinct()
    frames = frames.select("frame", F.array(*[F.lit(0.0)] * 5, 2.0 + (F.col("frame") % 7) * 0.5).alias("rt_ref_frame"))
    # four rows
    cams = spark.range(4).select(
        F.col("id").cast("int").alias("cam"),
        F.array(F.lit(CAMERA["f"]), F.lit(CAMERA["f"]), F.lit(CAMERA["cx"]), F.lit(CAMERA["cy"])).alias("intrinsics"),
        F.array(*[F.lit(0.0)] * 3, (2 * F.col("id") - 3) / 10.0, F.lit(0.0), F.lit(0.0)).alias("rt_cam_ref"),
    )
    return board_residuals(seen, frames, cams, spacing=0.1, width_n=3, lensmodel="LENSMODEL_PINHOLE", project=project_pinhole_late)


VEC_SQL = "SELECT vec_id, embedding AS e FROM embeddings"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
