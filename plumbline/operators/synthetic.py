"""Synthetic boards, observations and tracks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import lens, pose
from plumbline.functions.scalars import NUMPY, on_frame, values
from plumbline.operators import grids, relations
from plumbline.operators.observations import renumber
from plumbline.storage import stored


def ref_calibration_object(spark: SparkSession, width_n: int, height_n: int, spacing: float, warp: tuple[float, float] | None = None) -> DataFrame:
    """(iy, ix, x, y, z): points of a board; a warp adds z = w0 4u(1-u) + w1 4v(1-v) on the board's unit square."""
    rows = spark.range(width_n * height_n).select(F.floor(F.col("id") / width_n).cast("int").alias("iy"), (F.col("id") % width_n).cast("int").alias("ix"))
    u, v = F.col("ix") / (width_n - 1), F.col("iy") / (height_n - 1)
    w = warp or (0.0, 0.0)
    return rows.select("iy", "ix", (F.col("ix") * spacing).alias("x"), (F.col("iy") * spacing).alias("y"), (w[0] * 4 * u * (1 - u) + w[1] * 4 * v * (1 - v)).alias("z"))


def synthesize_boards(models: list[dict], width_n: int, height_n: int, spacing: float, n_frames: int, center: np.ndarray, noise: np.ndarray, which: str = "all-cameras-must-see-full-board", max_oblique_deg: float | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(rt_ref_board (F, 6), pixels (F, C, H, W, 2)) of random boards that the cameras see as asked: all or some cameras, full or more than half boards."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:height_n, :width_n].astype(float)
    board = np.stack([(x - (width_n - 1) / 2) * spacing, (y - (height_n - 1) / 2) * spacing, 0 * x], -1).reshape(-1, 3)
    poses, pixels = [], []
    while len(poses) < n_frames:
        rt = center + rng.uniform(-1, 1, 6) * noise
        ref = values(pose.transform_point_rt(NUMPY, list(rt), [board[:, k] for k in range(3)]))
        seen, qs = [], []
        for m in models:
            p = values(pose.transform_point_rt(NUMPY, list(np.asarray(m["rt_cam_ref"], float)), [ref[:, k] for k in range(3)]))
            q = lens.project(p, m["lensmodel"], np.asarray(m["intrinsics"]))
            w, h = m["imagersize"]
            inside = np.isfinite(q).all(1) & (q >= 0).all(1) & (q[:, 0] <= w - 1) & (q[:, 1] <= h - 1) & (p[:, 2] > 0)
            if max_oblique_deg is not None:
                R = np.array(values(pose.R_from_r(NUMPY, list(rt[:3])))).reshape(3, 3)
                n = values(pose.rotate_point_r(NUMPY, list(np.asarray(m["rt_cam_ref"], float)[:3]), list(R[:, 2])))
                view = p.mean(0) / np.linalg.norm(p.mean(0))
                inside &= abs(float(n @ view)) >= np.cos(np.radians(max_oblique_deg))
            seen.append(inside.sum())
            qs.append(q.reshape(height_n, width_n, 2))
        need = width_n * height_n if which.endswith("full-board") else width_n * height_n // 2 + 1
        ok = [s >= need for s in seen]
        if all(ok) if which.startswith("all") else any(ok):
            poses.append(rt)
            pixels.append(qs)
    return np.array(poses), np.array(pixels)


def uniform(seed: int, k: int, *columns: str):
    """A number from 0 up to 1 that hangs on the columns' values alone, so it is the same however rows are dealt."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed), F.lit(k)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def board_views(spark: SparkSession, models: list[dict], width_n: int, height_n: int, spacing: float, n_frames: int, center: list[float], noise: list[float], which: str = "all-cameras-must-see-full-board", seed: int = 0, most: int = 1 << 24) -> DataFrame:
    """(frame, cam, idx, x, y, rt_ref_frame) of ``n_frames`` random boards that the cameras see as asked, made on the cluster.

    A board's corners are about its middle; its pose is ``center`` give or take ``noise``.  Poses are drawn
    and tried until enough fit (at most ``most`` of them); frames are numbered from 0.
    """
    need = width_n * height_n if which.endswith("full-board") else width_n * height_n // 2 + 1
    tried = 2 * n_frames
    while True:
        rows = spark.range(tried).withColumnRenamed("id", "draw")
        rt = F.array(*[c + (uniform(seed, k, "draw") * 2 - 1) * n for k, (c, n) in enumerate(zip(map(float, center), map(float, noise), strict=True))])
        rows = rows.select("draw", rt.alias("rt_ref_frame"), F.explode(F.sequence(F.lit(0), F.lit(width_n * height_n - 1))).alias("idx"))
        at = [(F.col("idx") % width_n - (width_n - 1) / 2) * spacing, (F.floor(F.col("idx") / width_n) - (height_n - 1) / 2) * spacing, F.lit(0.0)]
        rows = on_frame(rows, pose.transform_point_rt, [[F.col("rt_ref_frame")[k] for k in range(6)], at], names=["bx", "by", "bz"])
        seen = None
        for c, m in enumerate(models):
            (w, h), cam = m["imagersize"], [F.lit(float(v)) for v in m["rt_cam_ref"]]
            one = on_frame(rows, pose.transform_point_rt, [cam, [F.col(k) for k in ("bx", "by", "bz")]], names=["cx", "cy", "cz"])
            one = lens.with_pixels(one, [F.col(k) for k in ("cx", "cy", "cz")], m["lensmodel"], m["intrinsics"], ("x", "y"))
            inside = (F.col("cz") > 0) & F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1)
            one = one.select("draw", F.lit(c).alias("cam"), "idx", "x", "y", "rt_ref_frame", F.coalesce(inside, F.lit(False)).alias("inside"))
            seen = one if seen is None else seen.unionByName(one)
        enough = seen.groupBy("draw", "cam").agg(F.count_if("inside").alias("n")).groupBy("draw").agg(F.count_if(F.col("n") >= need).alias("cams"))
        fits = stored(enough.filter(F.col("cams") == len(models) if which.startswith("all") else F.col("cams") > 0).select("draw"), "boards")
        if fits.count() >= n_frames:
            break
        if tried >= most:
            raise ValueError("too few of the poses drawn are seen as asked")
        tried *= 4
    kept = renumber(fits.orderBy("draw").limit(n_frames), "draw", "frame")  # as many as were asked for
    return seen.join(F.broadcast(kept) if n_frames <= 100_000 else kept, "draw").select(F.col("frame").cast("long").alias("frame"), "cam", "idx", "x", "y", "rt_ref_frame")


def make_tracks(spark: SparkSession, model: dict, n_poses: int, rt_world_cam: list[float], r_step: list[float], t_step: list[float], per_image: int, track_length: int, gridn: int, least_per_point: int = 4, least_per_pose: int = 4, seed: int = 0) -> DataFrame:
    """(point, pose, x, y, px, py, pz): features on the ground z = 0, seen by a camera that moves on by the same turn and the same way in the world at each pose.

    New features are drawn in each cell of a gridn x gridn grid over the imager, as many as keep about
    ``per_image`` in view, looked at where their rays meet the ground, and followed for ``track_length`` poses while
    in view.  Points and poses with too few observations are dropped until none is left.
    """
    (w, h), each = model["imagersize"], max(1, round(per_image / gridn**2 / track_length))
    born = spark.range(n_poses * gridn**2 * each).select(F.col("id").alias("point"), F.expr(f"id div {gridn**2 * each}").alias("first"), F.expr(f"id div {each} % {gridn**2}").alias("cell"))
    x, y = ((cell + uniform(seed, k, "point")) * (size - 1) / gridn for k, (cell, size) in enumerate(((F.col("cell") % gridn, w), (F.expr(f"cell div {gridn}"), h))))
    name, intrinsics = model["lensmodel"], np.asarray(model["intrinsics"], float)
    born = grids.with_kernel(born.withColumns({"x": x, "y": y}), ["x", "y"], lambda q: lens.unproject(q, name, intrinsics), ["vx", "vy", "vz"]).filter("vx is not null")

    def stand(m, n):
        """The pose of the camera at step n: turned and moved on n times."""
        return [*pose.compose_r(m, [m.num(v) for v in rt_world_cam[:3]], [n * float(v) for v in r_step]), *[n * float(t) + float(p) for p, t in zip(rt_world_cam[3:], t_step, strict=True)]]

    def ground(m, n, v):
        rt = stand(m, n[0])
        ray = pose.rotate_point_r(m, rt[:3], v)
        far = m.div(-rt[5], ray[2])
        return [*[p + r * far for p, r in zip(rt[3:], ray, strict=True)], far]

    born = on_frame(born.select("point", "first", "vx", "vy", "vz"), ground, [[F.col("first")], [F.col(c) for c in ("vx", "vy", "vz")]], names=["px", "py", "pz", "far"])
    # a filter would be pushed down through the formula's projections and repeat their shared parts without bound
    born = stored(born, "born").filter("far > 0")
    seen = born.select("point", "px", "py", F.lit(0.0).alias("pz"), F.explode(F.sequence("first", F.least(F.col("first") + track_length - 1, F.lit(n_poses - 1)))).alias("pose"))
    seen = on_frame(seen, lambda m, n, p: pose.transform_point_rt_inverted(m, stand(m, n[0]), p), [[F.col("pose")], [F.col(c) for c in ("px", "py", "pz")]], names=["cx", "cy", "cz"])
    seen = stored(lens.with_pixels(seen, [F.col(c) for c in ("cx", "cy", "cz")], name, intrinsics, ("x", "y")), "seen")
    seen = seen.filter((F.col("cz") > 0) & F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1)).select("point", "pose", "x", "y", "px", "py", "pz")
    return relations.cull_tracks(seen, "point", "pose", least_per_point, least_per_pose)


def add_noise(df: DataFrame, sigma: float, seed: int, x: str = "x", y: str = "y", w: str = "w") -> DataFrame:
    """Pixel noise of a deviation over the weight; corners not in use stay as they are."""
    scale = F.when(F.col(w) > 0, sigma / F.col(w)).otherwise(0.0)
    return df.withColumn(x, F.col(x) + F.randn(seed) * scale).withColumn(y, F.col(y) + F.randn(seed + 1) * scale)


def noisy_pixels(points: DataFrame, samples: int, sigma: float, seed: int, columns: list[str]) -> DataFrame:
    """Every row ``samples`` times, each copy of the named columns with its own noise."""
    rows = points.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    for k, c in enumerate(columns):
        rows = rows.withColumn(c, F.col(c) + F.randn(seed + k) * sigma)
    return rows
