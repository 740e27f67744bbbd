"""From corner tables to models, and from a model's stored solve to the tables behind its reports."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import lens
from plumbline.functions.imaging import grid_height
from plumbline.operators import grids, solver, stereo, views
from plumbline.operators import observations as obs
from plumbline.sources import models, tables


def calibrate_models(corners: DataFrame, lensmodel: str, imagersize: tuple[int, int], focal: float, width_n: int, height_n: int, spacing: float, key: str = "problem", names: list[str] | None = None, region_cells: int | None = 20) -> DataFrame:
    """(key, rms, outliers, and a model's columns): each problem's cameras, solved from (key, frame, cam, idx, x, y, w), with the solve they came from and the region it holds in.

    A camera's valid region is the largest part of its imager where residuals are as good as all over: mean and
    deviation within three times the solve's RMS, ``region_cells`` cells across (None: no region).
    """

    def solve(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p, s = solver.solved(pdf, lensmodel, imagersize, focal, width_n, height_n, spacing)
        inputs = models.pack_inputs(models.inputs_of(p))
        poses = np.vstack([np.zeros((1, 6)), p.rt_cam_ref])
        rows = []
        for c in range(len(p.intrinsics)):
            region = None if region_cells is None else valid_region(p, s["x"], c, region_cells, 3 * s["rms"]).tolist()
            rows.append({key: k[0], "rms": s["rms"], "outliers": s["outliers"], "path": None, "name": names[c] if names else f"camera-{c}", "lensmodel": lensmodel, "intrinsics": p.intrinsics[c].tolist(), "imagersize": [int(v) for v in imagersize], "rt_cam_ref": poses[c].tolist(), "icam_intrinsics": c, "icam_extrinsics": c - 1, "valid_intrinsics_region": region, "optimization_inputs": inputs})
        return pd.DataFrame(rows, dtype=object)

    kind = corners.schema[key].dataType.simpleString()
    return solver.dealt(corners, key).groupBy(key).applyInPandas(solve, f"`{key}` {kind}, rms double, outliers long, {models.SCHEMA}")


def corner_residuals(p: solver.Problem, x: np.ndarray | None = None) -> pd.DataFrame:
    """(iframe, cam, idx, x, y, w, dx, dy) of a problem's board corners."""
    x = p.measure(False)[0] if x is None else x
    n, k = len(p.obs), p.seen.shape[1] * p.seen.shape[2]
    e, seen = x[: 2 * n * k].reshape(-1, 2), p.seen.reshape(-1, 3)
    return pd.DataFrame({"iframe": np.repeat(p.obs[:, 0], k), "cam": np.repeat(p.obs[:, 1], k), "idx": np.tile(np.arange(k), n), "x": seen[:, 0], "y": seen[:, 1], "w": seen[:, 2], "dx": e[:, 0], "dy": e[:, 1]})


def valid_region(p: solver.Problem, x: np.ndarray, icam: int, nx: int, limit: float, least: int = 5) -> np.ndarray:
    """Of one solved camera: closed polygon, empty if no cell is good."""
    w, h = (int(v) for v in p.imagersizes[icam])
    ny = grid_height(nx, None, w, h)
    rows = corner_residuals(p, x)
    rows = rows[(rows["cam"] == icam) & (rows["w"] > 0)]
    at = lambda v, n, size: np.floor(v * ((n - 1) / (size - 1)) + 0.5).astype(int)
    rows = rows.assign(ix=at(rows["x"], nx, w), iy=at(rows["y"], ny, h))
    rows = rows[rows["ix"].between(0, nx - 1) & rows["iy"].between(0, ny - 1)]
    both = pd.concat([rows[["ix", "iy"]].assign(v=rows[c]) for c in ("dx", "dy")])
    cells = both.groupby(["ix", "iy"])["v"].agg(mean="mean", stdev=lambda v: v.std(ddof=0), count="count").reset_index()
    return views.valid_intrinsics_region(cells, (w, h), nx, ny, limit, limit, least + 1)


def problem_of(model: models.CameraModel) -> solver.Problem:
    inputs = model.optimization_inputs
    if inputs is None:
        raise ValueError("the model has no solve")
    return models.problem_of(inputs)


def residuals(spark: SparkSession, model: models.CameraModel) -> DataFrame:
    """(frame, cam, idx, x, y, w, dx, dy) of the model's solve, in the form of the observation operators."""
    return spark.createDataFrame(corner_residuals(problem_of(model)).rename(columns={"iframe": "frame"}))


def residual_reports(spark: SparkSession, model: models.CameraModel, nx: int = 20) -> dict[str, DataFrame]:
    """The solve's report, its observations from the worst, the histogram and the regional statistics of one camera."""
    rows = residuals(spark, model)
    w, h = model.imagersize
    own = rows.filter(F.col("cam") == model.icam_intrinsics)
    ny = grid_height(nx, None, w, h)
    cells = spark.range(nx * ny).selectExpr(f"CAST(id % {nx} AS INT) AS ix", f"CAST(id div {nx} AS INT) AS iy")
    return {
        "report": obs.solve_report(rows),
        "worst": obs.worst_observations(rows, 100),
        "histogram": obs.histogram(own, 0.04),
        "regional": obs.regional_statistics(own, obs.cell_of(F.col("x"), nx, w), obs.cell_of(F.col("y"), ny, h), cells),
    }


def geometry(spark: SparkSession, model: models.CameraModel, scale: float = 0.1) -> dict[str, DataFrame]:
    """Axes of the solve's cameras, outlines of its boards, and its points."""
    p = problem_of(model)
    poses = np.vstack([np.zeros((1, 6)), p.rt_cam_ref])
    cams = spark.createDataFrame([(i, [float(v) for v in rt]) for i, rt in enumerate(poses)], "cam int, rt_cam_ref array<double>")
    frames = spark.createDataFrame([(i, [float(v) for v in rt]) for i, rt in enumerate(p.rt_ref_frame)], "frame int, rt_ref_frame array<double>")
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p.points)], "point int, x double, y double, z double")
    return {"cameras": views.camera_axes(cams, scale), "boards": views.board_outlines(frames, p.seen.shape[2], p.seen.shape[1], p.spacing), "points": points}


def uncertainty(spark: SparkSession, model: models.CameraModel, nx: int = 60, distance: float | None = None, method: str = "cross-reprojection") -> DataFrame:
    return views.uncertainty_grid(spark, problem_of(model), int(model.icam_intrinsics), nx, distance, method)


def resolved(model: models.CameraModel) -> models.CameraModel:
    """The model after its stored solve was run again."""
    p, _ = solver.optimize(problem_of(model))
    i, e = int(model.icam_intrinsics), model.icam_extrinsics
    return models.CameraModel(**{**model.fields, "intrinsics": p.intrinsics[i].tolist(), "rt_cam_ref": (p.rt_cam_ref[e] if e is not None and e >= 0 else np.zeros(6)).tolist(), "optimization_inputs": models.inputs_of(replace(p))})


def converted(model: models.CameraModel, to: str) -> models.CameraModel:
    """The model in another lens model, by running its stored solve with that one: from the old core without distortion, geometry first."""
    p, i, e = problem_of(model), int(model.icam_intrinsics), model.icam_extrinsics
    n = lens.lensmodel(to).num_params
    start = np.concatenate([p.intrinsics[:, :4], np.zeros((len(p.intrinsics), n - 4))], 1)
    p = replace(p, lensmodel=to, intrinsics=start)
    p, _ = solver.optimize(replace(p, optimize_core=False, optimize_distortions=False), False)
    p, _ = solver.optimize(replace(p, optimize_core=True, optimize_distortions=True))
    return models.CameraModel(lensmodel=to, intrinsics=p.intrinsics[i].tolist(), imagersize=list(model.imagersize), rt_cam_ref=(p.rt_cam_ref[e] if e is not None and e >= 0 else np.zeros(6)).tolist(), icam_intrinsics=i, icam_extrinsics=e, optimization_inputs=models.inputs_of(p))


# -- images ----------------------------------------------------------------------------------------
def mapped_images(images: DataFrame, source: dict, target: dict, **how) -> DataFrame:
    """Images of one camera as another would have taken them: by rotation, at a distance or on a plane.  The map is made once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, h = (int(v) for v in target["imagersize"])
        y, x = np.mgrid[:h, :w].astype(float)
        at = grids.reprojection(target, source, **how)(np.stack([x.ravel(), y.ravel()], -1)).reshape(h, w, 2)
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                a = tables.transform_image(tables.image_array(r), at)
                out.append({**r, "width": w, "height": h, "dtype": str(a.dtype), "data": np.ascontiguousarray(a).tobytes()})
            yield pd.DataFrame(out, columns=list(pdf.columns))

    return images.mapInPandas(run, tables.IMAGE)


def rectified_images(images: DataFrame, models_: list[dict], rectified: list[dict], which: int) -> DataFrame:
    stereo.validate_rectified(rectified)
    return mapped_images(images, models_[which], rectified[which])


def ranges(disparities: DataFrame, rectified: list[dict], low: float = 0.0, high: float = float("inf")) -> DataFrame:
    """(x, y, disparity) of a rectified pair with range and point (px, py, pz) in the first camera's coordinates; natively, by generated code."""
    from plumbline.functions import imaging
    from plumbline.functions.scalars import on_frame

    baseline = stereo.validate_rectified(rectified)
    kind, core = rectified[0]["lensmodel"], [float(v) for v in rectified[0]["intrinsics"]]

    def formula(m, q, d):
        c = [m.num(v) for v in core]
        return [imaging.stereo_range(m, kind, d[0], q, c, baseline, low, high), *imaging.stereo_unproject(m, kind, d[0], q, c, baseline)]

    return on_frame(disparities, formula, [[F.col("x"), F.col("y")], [F.col("disparity")]], names=["range", "px", "py", "pz"])
