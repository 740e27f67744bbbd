"""Tables over imagers and lists of pixels: kernels that need only models run on the cluster, a batch of rows at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from plumbline.functions import lens, pose
from plumbline.functions.lens import with_kernel
from plumbline.functions.scalars import NUMPY, values


def parts(a: np.ndarray) -> list[np.ndarray]:
    return [a[..., i] for i in range(a.shape[-1])]


def grid_size(imagersize, nx: int, ny: int | None = None) -> tuple[int, int]:
    w, h = (int(v) for v in imagersize)
    return nx, int(round(h / w * nx)) if ny is None else ny


def over_grid(spark: SparkSession, imagersize, nx: int, kernel: Callable[[np.ndarray], np.ndarray], names: list[str], ny: int | None = None) -> DataFrame:
    """(iy, ix, x, y, names): an even grid over an imager, both borders included, and what the kernel makes of its pixels."""
    (w, h), (nx, ny) = (int(v) for v in imagersize), grid_size(imagersize, nx, ny)
    x, y = f"id % {nx} * {(w - 1) / max(nx - 1, 1)!r}D", f"id div {nx} * {(h - 1) / max(ny - 1, 1)!r}D"
    grid = spark.range(nx * ny).selectExpr(f"CAST(id div {nx} AS INT) AS iy", f"CAST(id % {nx} AS INT) AS ix", f"{x} AS x", f"{y} AS y")
    return with_kernel(grid, ["x", "y"], kernel, names)


def over_pixels(spark: SparkSession, imagersize, kernel: Callable[[np.ndarray], np.ndarray], names: list[str]) -> DataFrame:
    """(y, x, names): every pixel of an imager."""
    w, h = (int(v) for v in imagersize)
    pixels = spark.range(w * h).selectExpr(f"CAST(id div {w} AS INT) AS y", f"CAST(id % {w} AS INT) AS x")
    return with_kernel(pixels, ["x", "y"], kernel, names)


def model_of(m: dict) -> tuple[str, np.ndarray, np.ndarray]:
    return m["lensmodel"], np.asarray(m["intrinsics"], float), np.asarray(m["rt_cam_ref"], float)


def pose_between(to: np.ndarray, of: np.ndarray) -> np.ndarray:
    return values(pose.compose_rt(NUMPY, list(to), pose.invert_rt(NUMPY, list(of))))


def reprojection(source: dict, target: dict, intrinsics_only: bool = False, distance: float | None = None, plane: tuple[np.ndarray, float] | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """Pixels of one camera to those of another: by rotation (of points at infinity), at a distance, or on a plane n.p = d in the reference."""
    (m0, i0, rt0), (m1, i1, rt1) = model_of(source), model_of(target)
    rt10 = np.zeros(6) if intrinsics_only else pose_between(rt1, rt0)

    def kernel(q: np.ndarray) -> np.ndarray:
        v = lens.unproject(q, m0, i0, normalize=True)
        if plane is not None:
            n, d = np.asarray(plane[0], float), plane[1]
            back = values(pose.invert_rt(NUMPY, list(rt0)))
            ray = values(pose.rotate_point_r(NUMPY, list(back[:3]), parts(v)))
            v = v * ((d - n @ back[3:]) / (ray @ n))[..., None]
        elif distance is not None:
            v = v * distance
        far = plane is None and distance is None
        p = pose.rotate_point_r(NUMPY, list(rt10[:3]), parts(v)) if far else pose.transform_point_rt(NUMPY, list(rt10), parts(v))
        return lens.project(values(p), m1, i1)

    return kernel


def reproject_points(pixels: DataFrame, source: dict, target: dict, x: str = "x", y: str = "y", names: tuple[str, str] = ("x1", "y1"), **how) -> DataFrame:
    """A table of pixels of one camera with those of another."""
    return with_kernel(pixels, [x, y], reprojection(source, target, **how), list(names))


def image_map(spark: SparkSession, source: dict, target: dict, **how) -> DataFrame:
    """(y, x, x1, y1): the pixel of the source image that belongs at each pixel of the target's."""
    return over_pixels(spark, target["imagersize"], reprojection(target, source, **how), ["x1", "y1"])


def triangulate_pixels(pixels: DataFrame, models: list[dict], columns: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1"), method: str = "leecivera-mid2", sigma: float | None = None, correlation: float = 0.0) -> DataFrame:
    """Pixel pairs with their points (px, py, pz) in the first camera's coordinates, and with a pixel deviation their covariances (xx, xy, xz, yy, yz, zz)."""
    from plumbline.operators.uncertainty import triangulate

    cameras = [model_of(m) for m in models]

    def kernel(q: np.ndarray) -> np.ndarray:
        got = triangulate(q.reshape(-1, 2, 2), cameras, method, sigma, correlation)
        if sigma is None:
            return got
        p, cov = got
        return np.concatenate([p, cov[:, *np.triu_indices(3)]], -1)

    return with_kernel(pixels, list(columns), kernel, ["px", "py", "pz", *(["xx", "xy", "xz", "yy", "yz", "zz"] if sigma is not None else [])])


def within_region(pixels: DataFrame, model: dict, x: str = "x", y: str = "y") -> DataFrame:
    """Pixels of a camera with whether they lie within its valid-intrinsics region; null where that is unknown."""
    from pyspark.sql import functions as F

    from plumbline.functions.imaging import within_polygon

    region = model.get("valid_intrinsics_region")
    if region is None:
        return pixels.withColumn("within", F.lit(None).cast("boolean"))
    polygon = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in region]) if len(region) else F.lit(None)
    return pixels.withColumn("within", within_polygon(F.col(x), F.col(y), polygon) if len(region) else F.lit(False))
