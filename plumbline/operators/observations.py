"""Observation tables: residuals by a star join, culling, outliers, statistics, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import lens, pose
from plumbline.functions.scalars import on_frame

def corner_weight(field: Column, kind: str | None = "level") -> Column:
    """The weight of a corner from its fourth field: level n is 1/2^n; -1 marks an invalid one."""
    if kind is None:
        return F.lit(1.0)
    x = F.when(field == "-", None).otherwise(field).try_cast("double")
    if kind == "weight":
        return F.when(x > 0, x).otherwise(-1.0)
    return F.when(x >= 0, 1 / F.pow(F.lit(2.0), F.floor(x))).otherwise(-1.0)


def board_point(width_n: int, spacing: float, warp: tuple[float, float] | None = None, height_n: int | None = None):
    """Board coordinates of a corner's running index: x fastest; a warp adds z on the board's own unit square."""
    ix, iy = F.col("idx") % width_n, F.floor(F.col("idx") / width_n)
    z = F.lit(0.0)
    if warp:
        u, v = ix / float(width_n - 1), iy / float((height_n or width_n) - 1)
        z = warp[0] * 4 * u * (1 - u) + warp[1] * 4 * v * (1 - v)
    return [ix * spacing, iy * spacing, z]


def board_residuals(seen: DataFrame, frames: DataFrame, cameras: DataFrame, spacing: float, width_n: int, lensmodel: str, warp=None, project=None) -> DataFrame:
    """Corners with dx, dy = weight (predicted - seen), 0 where the weight is negative: seen joined with frames and cameras, projected.

    ``project`` is another form of the lens model's formula, for results that depend on the last bit.
    """
    n = lens.lensmodel(lensmodel).num_params
    rows = seen.join(frames, "frame").join(cameras, "cam")
    zeros = F.array(*[F.lit(0.0)] * 6)
    rows = rows.withColumn("rt_cam_ref", F.coalesce("rt_cam_ref", zeros))
    project = project or lens.CLOSED[lensmodel][0]

    def predicted(m, i, cam, frame, p):
        return project(m, i, pose.transform_point_rt(m, cam, pose.transform_point_rt(m, frame, p)))

    arguments = [[F.col("intrinsics")[k] for k in range(n)], [F.col("rt_cam_ref")[k] for k in range(6)], [F.col("rt_ref_frame")[k] for k in range(6)], board_point(width_n, spacing, warp)]
    rows = on_frame(rows, predicted, arguments, names=["px", "py"])
    valid = F.col("w") >= 0
    return rows.select(*seen.columns, F.when(valid, F.col("w") * (F.col("px") - F.col("x"))).otherwise(0.0).alias("dx"), F.when(valid, F.col("w") * (F.col("py") - F.col("y"))).otherwise(0.0).alias("dy"))


def predicted_corners(seen: DataFrame, frames: DataFrame, cameras: DataFrame, spacing: float, width_n: int, lensmodel: str, warp=None) -> DataFrame:
    """Corners put where their boards and cameras say: observations without noise, weights kept."""
    unweighted = board_residuals(seen.select("*", F.col("w").alias("__w")).withColumn("w", F.lit(1.0)), frames, cameras, spacing, width_n, lensmodel, warp)
    return unweighted.withColumns({"x": F.col("x") + F.col("dx"), "y": F.col("y") + F.col("dy"), "w": F.col("__w")}).select(*seen.columns)


def point_residuals(seen: DataFrame, points: DataFrame, cameras: DataFrame, lensmodel: str) -> DataFrame:
    """Point observations (point, cam, x, y, w, ...) with dx, dy = weight (predicted - seen), 0 where the weight is not positive; points are (point, p)."""
    n = lens.lensmodel(lensmodel).num_params
    rows = seen.join(points, "point").join(cameras, "cam")
    rows = rows.withColumn("rt_cam_ref", F.coalesce("rt_cam_ref", F.array(*[F.lit(0.0)] * 6)))
    project = lens.CLOSED[lensmodel][0]
    arguments = [[F.col("intrinsics")[k] for k in range(n)], [F.col("rt_cam_ref")[k] for k in range(6)], [F.col("p")[k] for k in range(3)]]
    rows = on_frame(rows, lambda m, i, cam, p: project(m, i, pose.transform_point_rt(m, cam, p)), arguments, names=["px", "py"])
    used = F.col("w") > 0
    return rows.select(*seen.columns, *[F.when(used, F.col("w") * (F.col(f"p{c}") - F.col(c))).otherwise(0.0).alias(f"d{c}") for c in "xy"])


def measurements_board(residuals: DataFrame, cam: int | None = None) -> DataFrame:
    """Residuals of corners in use, of one camera if asked."""
    rows = residuals.filter("w > 0")
    return rows if cam is None else rows.filter(F.col("cam") == cam)


def observed_pixel_uncertainty(residuals: DataFrame, n_state: int) -> DataFrame:
    """sqrt(sum x^2 / N) / sqrt(1 - Nstate / N) over all measurements in use."""
    n = 2 * F.count(F.lit(1))
    total = F.sum(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return residuals.filter("w > 0").agg((F.sqrt(F.try_divide(total, n)) / F.sqrt(1 - F.try_divide(F.lit(float(n_state)), n))).alias("sigma"))


# -- culling -------------------------------------------------------------------------------------
def cull_left_of(corners: DataFrame, x: float, flag: str = "w") -> DataFrame:
    """Corners at x or left of it lose their weight; rows stay."""
    return corners.withColumn(flag, F.when(F.col("x") > x, F.col(flag)))


def cull_off_center(corners: DataFrame, radius: float, width: int, height: int, flag: str = "w") -> DataFrame:
    dx, dy = F.col("x") - (width - 1) / 2, F.col("y") - (height - 1) / 2
    return corners.withColumn(flag, F.when(dx * dx + dy * dy < radius * radius, F.col(flag)))


def cull_off_board_center(corners: DataFrame, radius: float, width_n: int, height_n: int, flag: str = "w") -> DataFrame:
    """The same in units of corners on the board."""
    dx, dy = F.col("idx") % width_n - (width_n - 1) / 2, F.floor(F.col("idx") / width_n) - (height_n - 1) / 2
    return corners.withColumn(flag, F.when(dx * dx + dy * dy < radius * radius, F.col(flag)))


def cull_random_boards(corners: DataFrame, ratio: float, seed: int, keys: list[str], flag: str = "w") -> DataFrame:
    """Exactly round(ratio * boards) boards, chosen by a seeded hash, lose their weights."""
    boards = corners.select(*keys).distinct()
    n = round(ratio * boards.count())
    # a global rank without a single-partition window: the n least hashes
    gone = boards.withColumn("h", F.xxhash64(*keys, F.lit(seed))).orderBy("h", *keys).limit(n).select(*keys, F.lit(True).alias("__gone"))
    return corners.join(gone, keys, "left").withColumn(flag, F.when(F.col("__gone").isNull(), F.col(flag))).drop("__gone")


def rotate_corners(corners: DataFrame, nx: int, ny: int, turns: int, keys: list[str], where: Column | None = None) -> DataFrame:
    """Corner numbers of boards turned by quarter turns; a board must have nx * ny corners or none.  Rows of other boards are kept."""
    ix, iy = F.col("idx") % nx, F.floor(F.col("idx") / nx).cast("int")
    new = {0: F.col("idx"), 1: (nx - 1 - ix) * ny + iy, 2: nx * ny - 1 - F.col("idx"), 3: ix * ny + (ny - 1 - iy)}[turns % 4]
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = corners.withColumn("__n", n)
    fits = F.when(F.col("__n").isin(1, nx * ny), new).otherwise(F.raise_error(F.lit("a board has a wrong number of corners")).cast("int"))
    return rows.withColumn("idx", (F.when(where, fits).otherwise(F.col("idx")) if where is not None else fits).cast("int")).drop("__n")


def images_with_points(corners: DataFrame, keys: list[str], more_than: int, flag: str = "w") -> DataFrame:
    """All rows of the images with more valid corners than asked."""
    enough = corners.filter(F.col(flag) > 0).groupBy(*keys).count().filter(F.col("count") > more_than).select(*keys)
    return corners.join(enough, keys, "left_semi")


def exclude_images(corners: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    return corners.join(names, keys, "left_anti")


def boards(corners: DataFrame, width_n: int, height_n: int, more_than: int | None = None, on_wrong_size: str = "drop") -> DataFrame:
    """(iframe, frame, cam, corners): whole boards with enough valid corners, corners in order; frames renumbered densely from 0.

    Boards of a wrong number of corners are dropped, or raise an error with ``on_wrong_size="raise"``; a single row, as of
    an image without a board, is always dropped.  Sizes are counted first, so no board of a wrong size is gathered.
    """
    least, whole = 2 * min(width_n, height_n) if more_than is None else more_than, width_n * height_n
    sizes = corners.groupBy("frame", "cam").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("w") > 0).alias("valid"))
    if on_wrong_size == "raise":
        wrong = F.concat(F.lit("a board has a wrong number of corners: frame "), F.col("frame").cast("string"))
        sizes = sizes.withColumn("n", F.when(F.col("n").isin(1, whole), F.col("n")).otherwise(F.raise_error(wrong).cast("long")))
    fits = sizes.filter((F.col("n") == whole) & (F.col("valid") > least)).select("frame", "cam")
    kept = corners.join(fits, ["frame", "cam"]).groupBy("frame", "cam").agg(F.sort_array(F.collect_list(F.struct("idx", "x", "y", "w"))).alias("corners"))
    return renumber(kept, "frame").select("iframe", "frame", "cam", "corners")


def renumber(df: DataFrame, key: str, out: str | None = None) -> DataFrame:
    """Keys numbered densely from 0 in their order: ranks within ranges of keys plus the ranges' offsets, so no task sees all keys."""
    keys = df.select(key).distinct()
    ranged = keys.repartitionByRange(key).withColumn("part", F.spark_partition_id())
    from plumbline.storage import stored

    ranged = stored(ranged, "ranges")
    sizes = ranged.groupBy("part").count()
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("offset"))  # one row a partition
    rank = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    numbered = ranged.withColumn("r", rank).join(offsets, "part").select(key, (F.col("offset") + F.col("r")).alias(out or f"i{key}"))
    return df.join(numbered, key)


# -- outliers ----------------------------------------------------------------------------------
K0, K1 = 4.0, 5.0


def mark_outliers(residuals: DataFrame, k0: float = K0, k1: float = K1) -> DataFrame:
    """Weights of outliers negated.  With mean 0 and one deviation for all, if any residual passes k1 sigma, all corners beyond k0 sigma go."""
    used = F.col("w") > 0
    big = F.greatest(F.abs("dx"), F.abs("dy"))
    stats = residuals.filter(used).agg(F.try_divide(F.sum(F.col("dx") ** 2 + F.col("dy") ** 2), 2 * F.count(F.lit(1))).alias("var"), F.max(big).alias("most"))
    rows = residuals.crossJoin(F.broadcast(stats))  # one row
    sigma = F.sqrt("var")
    out = used & (F.col("most") > k1 * sigma) & (big > k0 * sigma)
    return rows.withColumn("outlier", F.coalesce(out, F.lit(False))).withColumn("w", F.when(F.col("outlier"), -F.col("w")).otherwise(F.col("w"))).drop("var", "most")


# -- statistics ----------------------------------------------------------------------------------
def regional_statistics(residuals: DataFrame, cell_x: Column, cell_y: Column, grid: DataFrame, least: int = 5) -> DataFrame:
    """(ix, iy, mean, stdev, count) of residual components by cell; cells with too few have mean and deviation 0."""
    rows = residuals.filter("w > 0").select(cell_x.alias("ix"), cell_y.alias("iy"), "dx", "dy").filter("ix is not null and iy is not null")
    sums = rows.groupBy("ix", "iy").agg((2 * F.count(F.lit(1))).alias("n"), F.sum(F.col("dx") + F.col("dy")).alias("s"), F.sum(F.col("dx") ** 2 + F.col("dy") ** 2).alias("s2"))
    n = F.coalesce("n", F.lit(0))
    mean = F.col("s") / F.col("n")
    return grid.join(sums, ["ix", "iy"], "left").select(
        "ix", "iy", F.when(n > least, mean).otherwise(0.0).alias("mean"), F.when(n > least, F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean))).otherwise(0.0).alias("stdev"), n.alias("count")
    )


def cell_of(x: Column, n: int, size: int) -> Column:
    """The grid cell that holds a coordinate strictly inside; null on a border or off the grid."""
    at = x * ((n - 1) / (size - 1)) + 0.5
    return F.when((at > F.floor(at)) & (at > 0) & (at < n), F.floor(at).cast("int"))


def histogram(residuals: DataFrame, width: float) -> DataFrame:
    """(bin, count) of the components of residuals in use; bin k holds [k width, (k + 1) width)."""
    both = residuals.filter("w > 0").select(F.explode(F.array("dx", "dy")).alias("v"))
    return both.groupBy(F.floor(F.col("v") / width).alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def gaussian_fit(residuals: DataFrame, width: float) -> DataFrame:
    """Mean, population deviation, number, and the height of the fitted curve over bins of a width."""
    both = residuals.filter("w > 0").select(F.explode(F.array("dx", "dy")).alias("v"))
    out = both.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sigma"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("height", F.try_divide(F.col("n") * width, F.col("sigma") * (2 * 3.141592653589793) ** 0.5))


def per_observation(residuals: DataFrame) -> DataFrame:
    """Per board observation: corners in use, RMS over them, sum of squares over all."""
    e2 = F.col("dx") ** 2 + F.col("dy") ** 2
    return residuals.groupBy("frame", "cam").agg(F.count_if(F.col("w") > 0).alias("inliers"), F.sqrt(F.try_divide(F.sum(F.when(F.col("w") > 0, e2)), F.count_if(F.col("w") > 0))).alias("rms"), F.sum(e2).alias("sum2"))


def worst_observations(residuals: DataFrame, k: int, by: str = "sum2") -> DataFrame:
    """The k worst observations, worst first, ties to smaller keys: a bounded top-k."""
    top = per_observation(residuals).orderBy(F.col(by).desc(), "frame", "cam").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col(by).desc(), "frame", "cam")) - 1)  # k rows


def solve_report(residuals: DataFrame) -> DataFrame:
    """One row: measurements, RMS over all measurements, worst residual, share of outliers."""
    e2 = F.col("dx") ** 2 + F.col("dy") ** 2
    n = F.count(F.lit(1))
    return residuals.agg((2 * n).alias("measurements"), F.sqrt(F.sum(e2) / (2 * n)).alias("rms"), F.sqrt(F.max(e2)).alias("worst"), (F.count_if(F.col("w") <= 0) / n).alias("outlier_ratio"))


def worst_direction_stdev(x: Column, y: Column) -> Column:
    """The deviation along the worst direction of grouped 2-D points."""
    a, b, c = F.var_pop(x), F.covar_pop(x, y), F.var_pop(y)
    return F.sqrt((a + c) / 2 + F.sqrt((a - c) * (a - c) / 4 + b * b))


def covariance_ellipse(x: Column, y: Column) -> list[Column]:
    """Centre, semi-axes and the angle of the major axis of grouped 2-D points."""
    a, b, c = F.var_pop(x), F.covar_pop(x, y), F.var_pop(y)
    d = F.sqrt((a - c) * (a - c) / 4 + b * b)
    return [F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.sqrt((a + c) / 2 + d).alias("major"), F.sqrt(F.greatest(F.lit(0.0), (a + c) / 2 - d)).alias("minor"), (F.atan2(2 * b, a - c) / 2).alias("angle")]
