"""Tables behind plots and reports: geometry, distortion, corrections, residual vectors, uncertainty grids, valid regions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import lens, pose
from plumbline.functions.scalars import NUMPY, on_frame, values, with_gradients
from plumbline.operators import grids, uncertainty
from plumbline.operators.solver import Problem


def camera_axes(cameras: DataFrame, scale: float = 1.0) -> DataFrame:
    """(cam, axis, x0, y0, z0, x1, y1, z1): each camera's axes in the reference, from a table of (cam, rt_cam_ref)."""
    axes = F.explode(F.array(*[F.struct(F.lit(n).alias("axis"), F.array(*[F.lit(scale if i == k else 0.0) for i in range(3)]).alias("v")) for k, n in enumerate("xyz")]))
    rows = cameras.select("cam", "rt_cam_ref", axes.alias("a")).select("cam", "rt_cam_ref", "a.axis", "a.v")
    rt = [F.col("rt_cam_ref")[i] for i in range(6)]

    def ends(m, rt, v):
        zero = [m.num(0)] * 3
        return [*pose.transform_point_rt_inverted(m, rt, zero), *pose.transform_point_rt_inverted(m, rt, v)]

    return on_frame(rows, ends, [rt, [F.col("v")[i] for i in range(3)]], names=["x0", "y0", "z0", "x1", "y1", "z1"]).drop("rt_cam_ref", "v")


def board_outlines(frames: DataFrame, width_n: int, height_n: int, spacing: float) -> DataFrame:
    """(frame, k, x, y, z): the corners of each board in the reference, from (frame, rt_ref_frame)."""
    w, h = (width_n - 1) * spacing, (height_n - 1) * spacing
    corners = F.posexplode(F.array(*[F.array(F.lit(x), F.lit(y), F.lit(0.0)) for x, y in ((0.0, 0.0), (w, 0.0), (w, h), (0.0, h), (0.0, 0.0))]))
    rows = frames.select("frame", "rt_ref_frame", corners.alias("k", "v"))
    return on_frame(rows, pose.transform_point_rt, [[F.col("rt_ref_frame")[i] for i in range(6)], [F.col("v")[i] for i in range(3)]], names=["x", "y", "z"]).drop("rt_ref_frame", "v")


def distortion_off_pinhole(spark: SparkSession, model: str, intrinsics: np.ndarray, imagersize, nx: int = 60) -> DataFrame:
    """(iy, ix, x, y, dx, dy): where a pinhole with the same core would put each pixel's ray, less the pixel."""
    i = np.asarray(intrinsics, float)
    return grids.over_grid(spark, imagersize, nx, lambda q: lens.project(lens.unproject(q, model, i), "LENSMODEL_PINHOLE", i[:4]) - q, ["dx", "dy"])


def radial_distortion(model: str, intrinsics: np.ndarray, degrees: np.ndarray) -> np.ndarray:
    """The angle to which the lens moves a ray at an angle from the axis, along x, in degrees."""
    a = np.radians(degrees)
    q = lens.project(np.stack([np.sin(a), 0 * a, np.cos(a)], -1), model, intrinsics)
    return np.degrees(np.arctan((q[:, 0] - intrinsics[2]) / intrinsics[0]))


def splined_correction(spark: SparkSession, model: str, intrinsics: np.ndarray, nx: int = 60, ny: int | None = None) -> DataFrame:
    """(iy, ix, ux, uy, dux, duy): the spline's surface over its domain."""
    m, i = lens.lensmodel(model), np.asarray(intrinsics, float)
    (x0, y0), (x1, y1) = lens.splined_domain(m).min(0), lens.splined_domain(m).max(0)
    ny = nx if ny is None else ny

    def kernel(at: np.ndarray) -> np.ndarray:
        u = np.stack([x0 + at[:, 0] * (x1 - x0) / (nx - 1), y0 + at[:, 1] * (y1 - y0) / (ny - 1)], -1)
        q = lens.project(values(lens.ray_of_u(NUMPY, [u[:, 0], u[:, 1]])), m, i)
        return np.concatenate([u, (q - i[2:4]) / i[:2] - u], -1)

    rows = spark.range(nx * ny).selectExpr(f"CAST(id div {nx} AS INT) AS iy", f"CAST(id % {nx} AS INT) AS ix")
    return grids.with_kernel(rows, ["ix", "iy"], kernel, ["ux", "uy", "dux", "duy"])


def resolution(spark: SparkSession, model: str, intrinsics: np.ndarray, imagersize, nx: int = 60, mode: str = "mean") -> DataFrame:
    """(iy, ix, x, y, deg_pixel)"""
    i = np.asarray(intrinsics, float)
    return grids.over_grid(spark, imagersize, nx, lambda q: lens.model_resolution_deg_pixel(q, model, i, mode), ["deg_pixel"])


def projection_difference(spark: SparkSession, models: list[tuple[str, np.ndarray]], imagersize, nx: int = 60, **how) -> DataFrame:
    """(iy, ix, x, y, dx, dy), or (.., difference) of more than two models: the pose between them is fitted on a grid of nx columns, the table made on the cluster."""
    kernel, n = uncertainty.projection_difference(models, imagersize, nx, **how)
    return grids.over_grid(spark, imagersize, nx, kernel, ["dx", "dy"] if n == 2 else ["difference"])


def stereo_pair_difference(spark: SparkSession, pairs: list[tuple], imagersize, nx: int = 60, distance: float | None = None) -> DataFrame:
    """(iy, ix, x, y, dx, dy)"""
    return grids.over_grid(spark, imagersize, nx, uncertainty.stereo_pair_difference(pairs, distance), ["dx", "dy"])


def uncertainty_by_distance(p: Problem, icam: int, distances: np.ndarray, q: np.ndarray | None = None, method: str = "cross-reprojection") -> np.ndarray:
    """The worst-direction deviation of one pixel (the imager's middle unless given) at each distance."""
    at = (np.asarray(p.imagersizes[icam], float) - 1) / 2 if q is None else np.asarray(q, float)
    v = lens.unproject(at, p.lensmodel, p.intrinsics[icam], normalize=True)
    return uncertainty.projection_uncertainty(np.asarray(distances, float)[:, None] * v, p, icam, method)


def uncertainty_grid(spark: SparkSession, p: Problem, icam: int, nx: int = 60, distance: float | None = None, method: str = "cross-reprojection", ny: int | None = None) -> DataFrame:
    """(x, y, stdev) over the imager, at a distance or at infinity: the problem goes to the tasks, each makes its part of the grid."""
    w, h = (int(v) for v in p.imagersizes[icam])
    ny = int(round(h / w * nx)) if ny is None else ny

    def run(batches):
        for pdf in batches:
            k = pdf["id"].to_numpy()
            q = np.stack([(k % nx) * (w - 1) / (nx - 1), (k // nx) * (h - 1) / (ny - 1)], -1)
            v = lens.unproject(q, p.lensmodel, p.intrinsics[icam], normalize=True) * (distance or 1.0)
            s = uncertainty.projection_uncertainty(v, p, icam, method, at_infinity=distance is None)
            yield pd.DataFrame({"x": q[:, 0], "y": q[:, 1], "stdev": s})

    return spark.range(nx * ny).mapInPandas(run, "x double, y double, stdev double")


def valid_intrinsics_region(cells: pd.DataFrame, imagersize, nx: int, ny: int, mean: float, stdev: float, count: int, uncertainty_limit: float | None = None) -> np.ndarray:
    """The outline of the largest connected set of grid cells within all limits: closed polygon of cell centres; empty if there is none."""
    ok = np.zeros((ny, nx), bool)
    for r in cells.itertuples():
        ok[r.iy, r.ix] = abs(r.mean) <= mean and r.stdev <= stdev and r.count >= count and (uncertainty_limit is None or r.uncertainty <= uncertainty_limit)
    best: list[tuple[int, int]] = []
    seen = np.zeros_like(ok)
    for y, x in zip(*np.nonzero(ok), strict=True):
        if seen[y, x]:
            continue
        group, todo = [], [(int(y), int(x))]
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            group.append((a, b))
            for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= c < ny and 0 <= d < nx and ok[c, d] and not seen[c, d]:
                    seen[c, d] = True
                    todo.append((c, d))
        if len(group) > len(best):
            best = group
    if not best:
        return np.zeros((0, 2))
    # walk the border of the set of unit squares about the cells, keeping the set on the left
    cells_in = set(best)
    step: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for y, x in best:
        for dy, dx, a, b in ((-1, 0, (y, x), (y, x + 1)), (0, 1, (y, x + 1), (y + 1, x + 1)), (1, 0, (y + 1, x + 1), (y + 1, x)), (0, -1, (y + 1, x), (y, x))):
            if (y + dy, x + dx) not in cells_in:
                step.setdefault(a, []).append(b)
    start = min(step)
    line, at = [start], step[start].pop()
    while at != start:
        line.append(at)
        at = step[at].pop()
    w, h = imagersize
    pts = np.array([[(x - 0.5) * (w - 1) / (nx - 1), (y - 0.5) * (h - 1) / (ny - 1)] for y, x in [*line, start]])
    return np.clip(pts, 0, [w - 1, h - 1])


# -- gradients of composition with an infinitely small pose, for uncertainty ----------------------------
def compose_r_tiny0(r1: np.ndarray) -> np.ndarray:
    return with_gradients(pose.compose_r)(np.zeros_like(r1), r1)[1]


def compose_r_tiny1(r0: np.ndarray) -> np.ndarray:
    return with_gradients(pose.compose_r)(r0, np.zeros_like(r0))[2]


def compose_rt_tiny0(rt1: np.ndarray) -> np.ndarray:
    return with_gradients(pose.compose_rt)(np.zeros_like(rt1), rt1)[1]


def compose_rt_tiny1(rt0: np.ndarray) -> np.ndarray:
    return with_gradients(pose.compose_rt)(rt0, np.zeros_like(rt0))[2]
