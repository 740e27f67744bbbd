"""Where states and measurements of a solve stand, as column arithmetic over a table with one problem a row.

Columns of such a table: cameras, n_intrinsics, is_splined, poses (cameras not at the reference), frames, points,
fixed (points), boards (observations), width_n, height_n, point_views, pair_count (of triangulated
rays), and the flags core, distortions, extrinsics, frames_too, warp, regularize, unity.
States: intrinsics, extrinsics, frames, points, warp.  Measurements: boards, points, triangulated,
regularisation.  An index is null where there is no such block or item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _if(flag: str, n: Column) -> Column:
    return F.when(F.col(flag), n).otherwise(F.lit(0)).cast("long")


def states_per_camera() -> Column:
    return _if("core", F.lit(4)) + _if("distortions", F.col("n_intrinsics") - 4)


STATES = {
    "intrinsics": (lambda: states_per_camera() * F.col("cameras"), states_per_camera),
    "extrinsics": (lambda: _if("extrinsics", 6 * F.col("poses")), lambda: F.lit(6)),
    "frames": (lambda: _if("frames_too", 6 * F.col("frames")), lambda: F.lit(6)),
    "points": (lambda: _if("frames_too", 3 * (F.col("points") - F.col("fixed"))), lambda: F.lit(3)),
    "warp": (lambda: F.when(F.col("warp") & (F.col("boards") > 0), 2).otherwise(0).cast("long"), lambda: F.lit(2)),
}


def _corners() -> Column:
    return 2 * F.col("width_n") * F.col("height_n")


MEASUREMENTS = {
    "boards": (lambda: (_corners() * F.col("boards")).cast("long"), _corners),
    "points": (lambda: (2 * F.col("point_views")).cast("long"), lambda: F.lit(2)),
    "triangulated": (lambda: F.col("pair_count").cast("long"), lambda: F.lit(1)),
    "regularization": (
        lambda: _if("regularize", F.col("cameras") * (_if("distortions", F.col("n_intrinsics") - 4) + _if("core", F.lit(2)))) + F.when(F.col("unity") & F.col("extrinsics") & (F.col("poses") > 0), 1).otherwise(0),
        lambda: F.lit(1),
    ),
}


def _placed(df: DataFrame, blocks: dict, prefix: str, of: dict[str, Column]) -> DataFrame:
    start = F.lit(0).cast("long")
    out = {}
    for name, (count, width) in blocks.items():
        n = count()
        out[f"num_{prefix}_{name}"] = n
        at = of.get(name, F.lit(0))
        first = start + at * width()
        out[f"{prefix}_index_{name}"] = F.when((at >= 0) & (at * width() < n), first)
        start = start + n
    return df.withColumns({**out, f"num_{prefix}s": start})


def with_states(df: DataFrame, **item: Column) -> DataFrame:
    """Adds num_state_* and state_index_* of each block (of its given item: camera, pose, frame, point), and num_states."""
    return _placed(df, STATES, "state", item)


def with_measurements(df: DataFrame, **item: Column) -> DataFrame:
    """Adds num_measurement_* and measurement_index_* of each block, and num_measurements."""
    return _placed(df, MEASUREMENTS, "measurement", item)


def pair_count(rays: DataFrame, keys: list[str], point: str) -> DataFrame:
    """(keys, pair_count) of a table of rays: n (n - 1) / 2 for a point of n rays."""
    n = rays.groupBy(*keys, point).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pair_count"))


def decode_pairs(rays: DataFrame, keys: list[str], point: str, seq: str) -> DataFrame:
    """(keys, point, measurement, seq0, seq1): the number of each triangulated measurement and its two rays.

    Points follow one another by their first ray.  A measurement's number is that of those of the points before,
    plus those of the point's earlier first rays, plus the second ray's place; so only a running sum over
    points is needed, and pairs are made within a point alone.
    """
    from pyspark.sql import Window

    of_point = Window.partitionBy(*keys, point)
    rows = rays.withColumn("__k", F.row_number().over(of_point.orderBy(seq)) - 1).withColumn("__n", F.count(F.lit(1)).over(of_point))
    first = rows.filter("__k = 0").select(*keys, point, "__n", F.col(seq).alias("__first"))
    before = Window.partitionBy(*keys).orderBy("__first").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)
    start = first.select(*keys, point, F.coalesce(F.sum(F.expr("__n * (__n - 1) div 2")).over(before), F.lit(0)).alias("__start"))
    a = rows.select(*keys, point, "__n", F.col("__k").alias("__i"), F.col(seq).alias("seq0"))
    b = rows.select(*keys, point, F.col("__k").alias("__j"), F.col(seq).alias("seq1"))
    pairs = a.join(b, [*keys, point]).filter("__i < __j").join(start, [*keys, point])
    number = F.expr("__start + __i * __n - __i * (__i + 1) div 2 + __j - __i - 1")
    return pairs.select(*keys, point, number.alias("measurement"), "seq0", "seq1")
