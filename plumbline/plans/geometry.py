"""Queries of grids, small solves and layouts, each with SQL from its known answer.

Problems are derived from the rows of ``nation``: cameras, boards and points follow from a row's
key by plain arithmetic, and what a solver or a fit must find again is known.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline import fixtures
from plumbline.fixtures import CORNER_SQL
from plumbline.functions import imaging, lens, pose
from plumbline.functions.scalars import NUMPY, on_frame, values
from plumbline.operators import alignment, grids, layout, solver, synthetic, uncertainty, views
from plumbline.operators import observations as obs
from plumbline.operators import relations as rel
from plumbline.plans import formula_sql as S

SIZE = (640, 480)
A = {"lensmodel": "LENSMODEL_PINHOLE", "intrinsics": [600.0, 610.0, 320.0, 240.0], "imagersize": SIZE, "rt_cam_ref": [0.0] * 6}
TURN = [0.05, -0.1, 0.02]
B = {"lensmodel": "LENSMODEL_PINHOLE", "intrinsics": [500.0, 505.0, 310.0, 250.0], "imagersize": (40, 30), "rt_cam_ref": [*TURN, 0.4, -0.1, 0.05]}


def _r(df: DataFrame, keep: list[str], names: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keep, *[(F.round(F.col(n), digits) + 0.0).alias(n) for n in names])


def _round(parts: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"CAST(round({x}, {digits}) + 0.0 AS DOUBLE) AS {n}" for n, x in parts.items())


def nations(spark, d) -> DataFrame:
    return fixtures.read(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("k"))


NATIONS = "(SELECT CAST(n_nationkey AS INTEGER) AS k FROM nation) n"


def _turned(v: list[str]) -> list[str]:
    """A vector of SQL terms turned by TURN: v cos + (axis x v) sin + axis (axis . v) (1 - cos)."""
    return _turned_by(v, TURN)


def _turned_by(v: list[str], r: list[float]) -> list[str]:
    angle = math.hypot(*r)
    axis = [repr(x / angle) for x in r]
    across, along = S.cross(axis, v), S.dot(axis, v)
    return [f"({x} * {math.cos(angle)!r} + {y} * {math.sin(angle)!r} + {a} * {along} * {1 - math.cos(angle)!r})" for x, y, a in zip(v, across, axis, strict=True)]


def _pixel(v: list[str], i: list[float]) -> list[str]:
    return [f"{i[0]} * ({v[0]}) / ({v[2]}) + {i[2]}", f"{i[1]} * ({v[1]}) / ({v[2]}) + {i[3]}"]


def _ray(x: str, y: str, i: list[float]) -> list[str]:
    return [f"(({x} - {i[2]}) / {i[0]})", f"(({y} - {i[3]}) / {i[1]})", "CAST(1 AS DOUBLE)"]


# -- pixels of one camera to those of another -----------------------------------------------------
def reproject_points(spark, d) -> DataFrame:
    e = F.col("e")
    rows = fixtures.vectors(spark, d).select("vec_id", (e[6] * 200 + 320).alias("x"), (e[7] * 200 + 240).alias("y"))
    return _r(grids.reproject_points(rows, A, {**B, "rt_cam_ref": [*TURN, 0, 0, 0]}), ["vec_id"], ["x1", "y1"])


def reproject_at_distance(spark, d) -> DataFrame:
    e = F.col("e")
    rows = fixtures.vectors(spark, d).select("vec_id", (e[6] * 200 + 320).alias("x"), (e[7] * 200 + 240).alias("y"))
    return _r(grids.reproject_points(rows, A, B, distance=5.0), ["vec_id"], ["x1", "y1"])


def image_map(spark, d) -> DataFrame:
    return _r(grids.image_map(spark, A, B), ["y", "x"], ["x1", "y1"])


def triangulate_pixels(spark, d) -> DataFrame:
    e = F.col("e")
    rows = fixtures.vectors(spark, d).select("vec_id", F.array(e[6], e[7], e[8] * 0.5 + 4).alias("p"))
    for n, m in enumerate((A, B)):
        rt = [F.lit(float(x)) for x in m["rt_cam_ref"]]
        rows = on_frame(rows, lambda f, t, p, m=m: lens.project_pinhole(f, m["intrinsics"], pose.transform_point_rt(f, t, p)), [rt, [F.col("p")[i] for i in range(3)]], names=[f"x{n}", f"y{n}"])
    return _r(grids.triangulate_pixels(rows.drop("p"), [A, B]), ["vec_id"], ["px", "py", "pz"], 5)


def points_within_region(spark, d) -> DataFrame:
    region = [[100.0, 100.0], [500.0, 120.0], [520.0, 400.0], [90.0, 380.0], [100.0, 100.0]]
    e = F.col("e")
    rows = fixtures.vectors(spark, d).select("vec_id", (e[6] * 600 + 320).alias("x"), (e[7] * 600 + 240).alias("y"))
    return grids.within_region(rows, {**A, "valid_intrinsics_region": region}).select("vec_id", "within")


# -- differences and views over an imager ------------------------------------------------------------
def difference_of_pinholes(spark, d) -> DataFrame:
    models = [(m["lensmodel"], np.array(m["intrinsics"])) for m in (A, B)]
    return _r(views.projection_difference(spark, models, SIZE, 40, intrinsics_only=True), ["iy", "ix"], ["dx", "dy"], 4)


def stereo_pair_difference(spark, d) -> DataFrame:
    one = np.array(A["intrinsics"])
    pairs = [(("LENSMODEL_PINHOLE", one, np.zeros(6)), ("LENSMODEL_PINHOLE", one, np.array([0, 0, 0, t, 0, 0]))) for t in (-0.5, -0.505)]
    return _r(views.stereo_pair_difference(spark, pairs, SIZE, 40, distance=10.0), ["iy", "ix"], ["dx", "dy"])


def distortion_off_pinhole(spark, d) -> DataFrame:
    return _r(views.distortion_off_pinhole(spark, "LENSMODEL_STEREOGRAPHIC", np.array(A["intrinsics"]), SIZE, 40), ["iy", "ix"], ["dx", "dy"])


def model_resolution(spark, d) -> DataFrame:
    return _r(views.resolution(spark, "LENSMODEL_PINHOLE", np.array([600.0, 600.0, 320.0, 240.0]), SIZE, 40), ["iy", "ix"], ["deg_pixel"])


SPLINED = "LENSMODEL_SPLINED_STEREOGRAPHIC_order=3_Nx=12_Ny=9_fov_x_deg=110"


def splined_correction(spark, d) -> DataFrame:
    """Control points that rise evenly give a surface that does."""
    m = lens.lensmodel(SPLINED)
    y, x = np.divmod(np.arange(m.nx * m.ny), m.nx)
    i = np.concatenate([A["intrinsics"], np.stack([0.01 + 0.002 * x, -0.02 + 0.003 * y], -1).ravel()])
    return _r(views.splined_correction(spark, SPLINED, i, 20, 15), ["iy", "ix"], ["ux", "uy", "dux", "duy"])


def spline_knots(spark, d) -> DataFrame:
    def kernel(at: np.ndarray) -> np.ndarray:
        out = []
        for (k,) in at.astype(int):
            x, y = lens.knots(f"LENSMODEL_SPLINED_STEREOGRAPHIC_order={2 + k % 2}_Nx={k + 6}_Ny={k + 5}_fov_x_deg=120")
            domain = lens.splined_domain(f"LENSMODEL_SPLINED_STEREOGRAPHIC_order={2 + k % 2}_Nx={k + 6}_Ny={k + 5}_fov_x_deg=120")
            out.append([x[0], x[-1], y[0], y[-1], domain[0, 0], domain[2, 1]])
        return np.array(out)

    return _r(grids.with_kernel(nations(spark, d), ["k"], kernel, [f"o{i}" for i in range(6)]), ["k"], [f"o{i}" for i in range(6)])


def field_of_view(spark, d) -> DataFrame:
    def kernel(at: np.ndarray) -> np.ndarray:
        return np.array([[*lens.report_fov("LENSMODEL_PINHOLE", np.array([600 + 10 * k, 610.0, 300 + k, 250 - k]), SIZE).values()] for k in at[:, 0]])

    return _r(grids.with_kernel(nations(spark, d), ["k"], kernel, ["across", "down", "corners"]), ["k"], ["across", "down", "corners"])


def cameras(spark, d) -> DataFrame:
    k = F.col("k")
    return nations(spark, d).select(k.alias("cam"), F.array(k * 0.1 + 0.05, k * -0.05, F.lit(0.2), k * 1.0, F.lit(2.0), k * -0.5).alias("rt_cam_ref"))


def camera_axes(spark, d) -> DataFrame:
    names = ["x0", "y0", "z0", "x1", "y1", "z1"]
    return _r(views.camera_axes(cameras(spark, d), 2.0), ["cam", "axis"], names)


def board_outlines(spark, d) -> DataFrame:
    frames = cameras(spark, d).select(F.col("cam").alias("frame"), F.col("rt_cam_ref").alias("rt_ref_frame"))
    return _r(views.board_outlines(frames, 10, 8, 0.1), ["frame", "k"], ["x", "y", "z"])


# -- polygons ------------------------------------------------------------------------------------
def contours(spark, d) -> DataFrame:
    """Triangles, closed where the key is odd: vertices once closed, and once no edge is longer than 3."""
    k = F.col("k")
    at = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y")) if not hasattr(x, "cast") else F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    p = F.array(at(0, 0), at(k + 4.0, k * 0.0), at(k * 0.0, k + 3.0))
    p = F.when(k % 2 == 1, F.concat(p, F.array(at(0, 0)))).otherwise(p)
    closed = imaging.close_contour(p)
    return nations(spark, d).select("k", F.size(closed).cast("long").alias("closed"), F.size(imaging.densify(closed, 3.0)).cast("long").alias("dense"))


def polygon_difference(spark, d) -> DataFrame:
    def kernel(at: np.ndarray) -> np.ndarray:
        square = lambda x, y, s: np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s]], float)
        out = []
        for (k,) in at:
            pieces = imaging.polygon_difference(square(0, 0, 10), square(2 + k / 4, 3, 1 + k / 2))
            out.append([sum(abs(imaging.polygon_area(p)) for p in pieces)])
        return np.array(out)

    return _r(grids.with_kernel(nations(spark, d), ["k"], kernel, ["area"]), ["k"], ["area"])


def valid_region(spark, d) -> DataFrame:
    """A rectangle of good cells about the middle: its outline's corners and area, in cells."""

    def kernel(at: np.ndarray) -> np.ndarray:
        out = []
        for (k,) in at.astype(int):
            w, h = 1 + k % 5, 1 + k % 4
            good = lambda x, y, w=w, h=h: 5 <= x < 5 + w and 4 <= y < 4 + h
            cells = pd.DataFrame([{"ix": x, "iy": y, "mean": 0.1 if good(x, y) else 9.0, "stdev": 0.2, "count": 20} for y in range(12) for x in range(16)])
            p = views.valid_intrinsics_region(cells, (151, 111), 16, 12, 1.0, 1.0, 5)
            out.append([len(p), abs(imaging.polygon_area(p[:-1])) / 100, p[:, 0].min(), p[:, 1].max()])
        return np.array(out)

    return _r(grids.with_kernel(nations(spark, d), ["k"], kernel, ["vertices", "area", "left", "bottom"]), ["k"], ["vertices", "area", "left", "bottom"])


# -- fits with a known answer ----------------------------------------------------------------------
def align_vectors(spark, d) -> DataFrame:
    """Vectors of each label, turned by a rotation of the label's own."""
    e = fixtures.read(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e"))
    r = [F.col("label") * 0.1, F.col("label") * -0.05, F.lit(0.2)]
    rows = on_frame(e.select("label", F.slice("e", 1, 3).alias("v1")), pose.rotate_point_r, [[c.cast("double") for c in r], [F.col("v1")[i] for i in range(3)]], out="v0")
    fitted = alignment.align_groups(rows, ["label"], "v0", "v1", vectors=True)
    return fitted.select("label", "n", *[(F.round(F.col("Rt01")[i], 6) + 0.0).alias(f"o{i}") for i in range(9)])


def sorted_eigenvalues(spark, d) -> DataFrame:
    x, y = F.col("dx"), F.col("dy")
    rows = fixtures.residuals(spark, d).groupBy("cam").agg(F.var_pop(x).alias("a"), F.covar_pop(x, y).alias("b"), F.var_pop(y).alias("c"))
    kernel = lambda m: uncertainty.sorted_eig(np.stack([m[:, [0, 1]], m[:, [1, 2]]], 1))[0]
    return _r(grids.with_kernel(rows, ["a", "b", "c"], kernel, ["low", "high"]), ["cam"], ["low", "high"], 3)


def pinhole_gradient(spark, d) -> DataFrame:
    """dq/dp and dq/dintrinsics, by dual numbers."""
    e = F.col("e")
    rows = fixtures.vectors(spark, d).select("vec_id", e[6].alias("x"), e[7].alias("y"), (e[8] * 0.5 + 2).alias("z"))

    def kernel(p: np.ndarray) -> np.ndarray:
        _, dp, di = lens.project_with_gradients(p, "LENSMODEL_PINHOLE", np.array(A["intrinsics"]))
        return np.concatenate([dp.reshape(-1, 6), di.reshape(-1, 8)], -1)

    names = [f"o{i}" for i in range(14)]
    return _r(grids.with_kernel(rows, ["x", "y", "z"], kernel, names), ["vec_id"], names)


def compose_tiny(spark, d) -> DataFrame:
    """Gradients of a composition with an infinitely small rotation, before and after."""
    e = F.col("e")
    rows = fixtures.vectors(spark, d).select("vec_id", *[(e[i] * 6).alias(f"r{i}") for i in range(3)])
    names = [f"o{i}" for i in range(18)]
    kernel = lambda r: np.concatenate([views.compose_r_tiny0(r).reshape(-1, 9), views.compose_r_tiny1(r).reshape(-1, 9)], -1)
    return _r(grids.with_kernel(rows, ["r0", "r1", "r2"], kernel, names), ["vec_id"], names)


def board_pose(spark, d) -> DataFrame:
    """The pose of a board from one camera's pixels."""
    y, x = np.mgrid[:5, :6].astype(float)
    board = np.stack([x * 0.1, y * 0.1, 0 * x], -1).reshape(-1, 3)

    def kernel(at: np.ndarray) -> np.ndarray:
        out = []
        for (k,) in at:
            rt = [0.1 + 0.01 * k, -0.2 + 0.01 * k, 0.05, -0.2, 0.1 - 0.01 * k, 1.5 + 0.1 * k]
            p = values(pose.transform_point_rt(NUMPY, [np.float64(v) for v in rt], [board[:, i] for i in range(3)]))
            q = lens.project(p, "LENSMODEL_PINHOLE", np.array(A["intrinsics"]))
            out.append(solver.board_pose(np.concatenate([q, np.ones((30, 1))], 1), board, "LENSMODEL_PINHOLE", np.array(A["intrinsics"])))
        return np.array(out)

    names = [f"o{i}" for i in range(6)]
    return _r(grids.with_kernel(nations(spark, d), ["k"], kernel, names), ["k"], names)


# -- solves ------------------------------------------------------------------------------------------
def calibrate(spark, d) -> DataFrame:
    """Two cameras that see eight boards, exactly, for each nation: lens and pose are found again from the corners alone."""
    k, f, c, i = F.col("k"), F.col("frame"), F.col("cam"), F.col("idx")
    rows = nations(spark, d).select("k", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("frame"))
    rows = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("cam")).select("*", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("idx"))
    intrinsics = [1200.0 + k, 1210.0 + k, F.lit(960.0), F.lit(600.0), F.lit(-0.1), k * 0.002, F.lit(0.001), F.lit(-0.001)]
    camera = [c * 0.02, c * -0.03, c * 0.01, c * -0.3, c * 0.01, c * 0.02]
    board = [F.sin(f * 1.3) * 0.4, F.cos(f * 2.1) * 0.4, F.sin(f * 0.7) * 0.2, F.cos(f * 1.1) * 0.3 - 0.25, F.sin(f * 1.9) * 0.2 - 0.2, F.sin(f * 2.7) * 0.4 + 1.6]
    point = [(i % 6) * 0.1, F.floor(i / 6) * 0.1, F.lit(0.0)]
    rows = on_frame(rows, lambda m, n, a, b, p: lens.project_opencv(m, n, pose.transform_point_rt(m, a, pose.transform_point_rt(m, b, p))), [intrinsics, camera, board, point], names=["x", "y"])
    out = solver.calibrate(rows.withColumn("w", F.lit(1.0)), "k", "LENSMODEL_OPENCV4", (1920, 1200), 1100.0, 6, 5, 0.1, regularize=False)
    return out.select("k", "icam", *[(F.round(F.col("intrinsics")[j], 3) + 0.0).alias(f"i{j}") for j in range(8)], *[(F.round(F.col("rt_cam_ref")[j], 4) + 0.0).alias(f"o{j}") for j in range(6)], F.round("rms", 3).alias("rms"), "outliers")


def _scene(k: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points, and the poses of two cameras beside one at the reference."""
    n = np.arange(9.0)
    points = np.stack([np.sin(n * 1.7 + k) * 1.5, np.cos(n * 2.3) * 1.2, 6 + np.sin(n * 0.9 + k)], -1)
    return points, np.array([0.02, 0.1, -0.01, -0.6, 0.1 + 0.01 * k, 0.05]), np.array([-0.05, -0.1, 0.02, 0.5, -0.2, 0.1 + 0.01 * k])


def _seen(points: np.ndarray, rt: np.ndarray) -> np.ndarray:
    return lens.project(values(pose.transform_point_rt(NUMPY, list(rt), [points[:, i] for i in range(3)])), "LENSMODEL_PINHOLE", np.array(A["intrinsics"]))


def bundle_points(spark, d) -> DataFrame:
    """Points and poses from pixels, where three points are known: the free points are found again."""

    def problem(pdf: pd.DataFrame) -> solver.Problem:
        points, rt1, rt2 = _scene(float(pdf["k"].iloc[0]))
        poses = np.array([np.zeros(6), rt1, rt2])
        views_of = [(p, 0, c - 1) for c in range(3) for p in range(9)]
        seen = np.concatenate([np.concatenate([_seen(points, rt), np.ones((9, 1))], 1) for rt in poses])
        start = points + np.where(np.arange(9)[:, None] < 6, 0.2 * np.sin(np.arange(27.0)).reshape(9, 3), 0)
        return solver.Problem("LENSMODEL_PINHOLE", np.array([SIZE]), np.array([A["intrinsics"]]), poses[1:] + 0.02, np.zeros((0, 6)), np.zeros((0, 3), int), np.zeros((0, 1, 1, 3)), 0.0, points=start, n_fixed=3, obs_points=np.array(views_of), seen_points=seen, optimize_core=False, optimize_distortions=False, regularize=False)

    def result(p: solver.Problem, s: dict) -> pd.DataFrame:
        return pd.DataFrame({"point": range(9), "x": p.points[:, 0], "y": p.points[:, 1], "z": p.points[:, 2]})

    out = solver.solve_groups(nations(spark, d), "k", problem, "point int, x double, y double, z double", result)
    return _r(out, ["k", "point"], ["x", "y", "z"], 5)


def bundle_rays(spark, d) -> DataFrame:
    """A camera's pose from rays to points that are no states, at distance 1 from the reference."""

    def problem(pdf: pd.DataFrame) -> solver.Problem:
        points, rt, _ = _scene(float(pdf["k"].iloc[0]))
        rt = np.concatenate([rt[:3], rt[3:] / np.linalg.norm(rt[3:])])
        second = values(pose.transform_point_rt(NUMPY, list(rt), [points[:, i] for i in range(3)]))
        rays = np.stack([points, second], 1).reshape(-1, 3)
        sets = np.array([(p, 0, c - 1) for p in range(9) for c in range(2)])
        rays = rays / np.linalg.norm(rays, axis=1, keepdims=True)
        return solver.Problem("LENSMODEL_PINHOLE", np.array([SIZE]), np.array([A["intrinsics"]]), rt[None] + 0.01, np.zeros((0, 6)), np.zeros((0, 3), int), np.zeros((0, 1, 1, 3)), 0.0, obs_rays=sets, rays=rays, optimize_core=False, optimize_distortions=False, regularize=False, unity_cam01=True)

    def result(p: solver.Problem, s: dict) -> pd.DataFrame:
        return pd.DataFrame([{f"o{i}": v for i, v in enumerate(p.rt_cam_ref[0])}])

    out = solver.solve_groups(nations(spark, d), "k", problem, ", ".join(f"o{i} double" for i in range(6)), result, reject_outliers=False)
    return _r(out, ["k"], [f"o{i}" for i in range(6)], 4)


def optimizer_callback(spark, d) -> DataFrame:
    """Measurements and some gradients of a board of four corners, straight ahead, and of a known point."""

    def kernel(at: np.ndarray) -> np.ndarray:
        out = []
        for (k,) in at:
            frame = np.array([[0, 0, 0, 0.1 * k - 1, 0.2, 2 + 0.1 * k]])
            seen = np.array([[[[300.0, 250.0, 1.0], [310.0, 255.0, 0.5]], [[305.0, 270.0, 0.8], [315.0, 275.0, -1.0]]]])
            p = solver.Problem("LENSMODEL_PINHOLE", np.array([SIZE]), np.array([[600 + k, 610.0, 320.0, 240.0 + k]]), np.zeros((0, 6)), frame, np.array([[0, 0, -1]]), seen, 0.1, points=np.array([[0.3, -0.2, 4.0]]), n_fixed=1, obs_points=np.array([[0, 0, -1]]), seen_points=np.array([[350.0, 200.0, 0.9]]), optimize_distortions=False, optimize_warp=False)
            x = p.measure()[0]
            j = p.jacobian_table().pivot_table(index="row", columns="col", values="value", fill_value=0.0).to_numpy()
            a = p.state_index_frames(0)
            out.append([*x, j[0, 0], j[2, a + 3], j[2, a + 5], j[4, a + 5]])
        return np.array(out)

    names = [f"o{i}" for i in range(16)]
    return _r(grids.with_kernel(nations(spark, d), ["k"], kernel, names), ["k"], names)


def pack_state(spark, d) -> DataFrame:
    """The packed state of a problem with every kind of state, and what it is unpacked to."""

    def kernel(at: np.ndarray) -> np.ndarray:
        out = []
        for (k,) in at:
            p = solver.Problem("LENSMODEL_OPENCV4", np.array([SIZE]), np.array([[600 + k, 610, 320, 240, 0.1, 0.2, 0.3, 0.01 * k]]), np.array([[0.1, 0.2, 0.3, k, 5, 6]]), np.array([[0.3, 0.2, 0.1, 4, 5, k]]), np.array([[0, 0, 0]]), np.ones((1, 2, 2, 3)), 0.1, np.array([0.01, 0.002 * k]), points=np.array([[1.0, 2, k], [7, 8, 9]]), n_fixed=1)
            b = p.pack()
            again = p.ingest(b)
            out.append([*b, again.intrinsics[0, 7], again.rt_ref_frame[0, 5], again.points[0, 2], again.warp[1]])
        return np.array(out)

    names = [f"o{i}" for i in range(29)]
    return _r(grids.with_kernel(nations(spark, d), ["k"], kernel, names), ["k"], names)


def _layouts(spark, d) -> DataFrame:
    k = F.col("k")
    cols = {"cameras": k % 3 + 1, "n_intrinsics": F.when(k % 2 == 0, 8).otherwise(12), "poses": k % 4, "frames": k % 5, "points": k % 6 + 2, "fixed": k % 3, "boards": 2 * (k % 5), "width_n": k % 3 + 4, "height_n": k % 2 + 3, "point_views": 3 * (k % 6), "pair_count": k * 2}
    flags = {"core": k % 2 == 0, "distortions": k % 3 > 0, "extrinsics": k % 5 > 0, "frames_too": k % 7 > 0, "warp": k % 4 > 0, "regularize": k % 6 > 0, "unity": k % 3 == 1}
    return nations(spark, d).withColumns({**cols, **flags})


def state_layout(spark, d) -> DataFrame:
    out = layout.with_states(_layouts(spark, d), intrinsics=F.lit(1), extrinsics=F.lit(2), frames=F.lit(1), points=F.lit(1))
    return out.select("k", "num_states", *[F.col(f"{p}_{b}").cast("long").alias(f"{p}_{b}") for b in layout.STATES for p in ("num_state", "state_index")])


def measurement_layout(spark, d) -> DataFrame:
    out = layout.with_measurements(_layouts(spark, d), boards=F.lit(1), points=F.lit(2), triangulated=F.lit(3))
    return out.select("k", "num_measurements", *[F.col(f"{p}_{b}").cast("long").alias(f"{p}_{b}") for b in layout.MEASUREMENTS for p in ("num_measurement", "measurement_index")])


def _rays(spark, d) -> DataFrame:
    rows = fixtures.read(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("last"))
    return rel.point_sets(rows, F.col("event_id"), "last", "user_id")


def decode_pairs(spark, d) -> DataFrame:
    return layout.decode_pairs(_rays(spark, d), ["user_id"], "set_id", "event_id").select("user_id", F.col("measurement").cast("long").alias("measurement"), "seq0", "seq1")


def pair_counts(spark, d) -> DataFrame:
    return layout.pair_count(_rays(spark, d), ["user_id"], "set_id").select("user_id", F.col("pair_count").cast("long").alias("pair_count"))


# -- observations of points and without noise ---------------------------------------------------------
def point_residuals(spark, d) -> DataFrame:
    seen = fixtures.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("point"), (F.col("l_suppkey") % 4).cast("int").alias("cam"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_linenumber") * 10.0).alias("y"), (F.col("l_suppkey") % 3 - 1).cast("double").alias("w"))
    points = fixtures.read(spark, d, "part").select(F.col("p_partkey").alias("point"), F.array(F.col("p_size") * 0.1, (F.col("p_partkey") % 7) * 0.1, 5.0 + F.col("p_partkey") % 5).alias("p"))
    cams = spark.range(4).select(F.col("id").cast("int").alias("cam"), F.array(F.lit(600.0), F.lit(610.0), F.lit(320.0), F.lit(240.0)).alias("intrinsics"), F.when(F.col("id") > 0, F.array(*[F.lit(0.0)] * 3, F.col("id") * 0.5, F.lit(0.1), F.lit(0.0))).alias("rt_cam_ref"))
    out = obs.point_residuals(seen, points, cams, "LENSMODEL_PINHOLE")
    return out.groupBy("cam", "w").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dx"), 4).alias("dx"), F.round(F.avg("dy"), 4).alias("dy"), F.round(F.max(F.abs("dx")), 4).alias("most"))


def perfect_corners(spark, d) -> DataFrame:
    c = fixtures.CAMERA
    seen = fixtures.corners(spark, d)
    frames = fixtures.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame")).distinct()
    frames = frames.select("frame", F.array(*[F.lit(0.0)] * 5, 2.0 + (F.col("frame") % 7) * 0.5).alias("rt_ref_frame"))
    cams = spark.range(4).select(F.col("id").cast("int").alias("cam"), F.array(F.lit(c["f"]), F.lit(c["f"]), F.lit(c["cx"]), F.lit(c["cy"])).alias("intrinsics"), F.array(*[F.lit(0.0)] * 3, (F.col("id") - 1.5) * 0.2, F.lit(0.0), F.lit(0.0)).alias("rt_cam_ref"))
    return _r(obs.predicted_corners(seen, frames, cams, 0.1, 3, "LENSMODEL_PINHOLE"), ["frame", "cam", "idx", "w"], ["x", "y"])


def cull_random_boards(spark, d) -> DataFrame:
    """How many boards go; which ones is up to a hash."""
    culled = obs.cull_random_boards(fixtures.corners(spark, d), 1 / 3, 5, ["frame", "cam"])
    boards = culled.groupBy("frame", "cam").agg(F.count("w").alias("left"), F.count(F.lit(1)).alias("all"))
    return boards.agg(F.count_if(F.col("left") == 0).alias("gone"), F.count_if(F.col("left") == F.col("all")).alias("kept"))


def frame_numbers(spark, d) -> DataFrame:
    o = fixtures.read(spark, d, "orders")
    files = o.select((F.col("o_custkey") % 2).cast("int").alias("cam"), F.concat(F.lit("img-"), F.lpad(F.col("o_orderkey").cast("string"), 9, F.lit("0")), F.lit("-c.png")).alias("path"))
    return rel.frame_numbers(files).select("cam", "frame", F.length("path").cast("long").alias("length"))


def synthetic_boards(spark, d) -> DataFrame:
    """Random boards that two cameras see whole: how many, and how many corners are off the imager or elsewhere than their board's pose says."""
    cams = [{**A, "lensmodel": "LENSMODEL_OPENCV4", "intrinsics": [*A["intrinsics"], -0.05, 0.02, 0.001, -0.001], "rt_cam_ref": rt} for rt in ([0.0] * 6, [0.02, -0.03, 0.01, -0.3, 0.01, 0.02])]
    rows = synthetic.board_views(spark, cams, 6, 5, 0.1, 25, [0, 0, 0, 0, 0, 2.0], [0.5, 0.5, 0.5, 0.4, 0.3, 0.5], seed=3)
    i = F.col("idx")
    board = [(i % 6 - 2.5) * 0.1, (F.floor(i / 6) - 2) * 0.1, F.lit(0.0)]
    rt = F.when(F.col("cam") == 1, F.array(*map(F.lit, cams[1]["rt_cam_ref"]))).otherwise(F.array(*[F.lit(0.0)] * 6))
    rows = rows.withColumn("rt", rt)
    rows = on_frame(rows, lambda m, c, f, p: lens.project_opencv(m, cams[0]["intrinsics"], pose.transform_point_rt(m, c, pose.transform_point_rt(m, f, p))), [[F.col("rt")[k] for k in range(6)], [F.col("rt_ref_frame")[k] for k in range(6)], board], names=["u", "v"])
    off = ~(F.col("x").between(0, 639) & F.col("y").between(0, 479))
    return rows.agg(F.count_distinct("frame").alias("frames"), F.max("frame").alias("last"), F.count(F.lit(1)).alias("corners"), F.count_if(off).alias("off"), F.count_if(F.hypot(F.col("x") - F.col("u"), F.col("y") - F.col("v")) > 1e-6).alias("elsewhere"))


def tracks(spark, d) -> DataFrame:
    """Tracks of a camera that flies on, looking down: whether there are any, and how many break a rule."""
    model = {"lensmodel": "LENSMODEL_PINHOLE", "intrinsics": [500.0, 500.0, 319.5, 239.5], "imagersize": (640, 480)}
    # from 100 above ground, z being down; the camera's axes are the world's
    rows = synthetic.make_tracks(spark, model, 40, [0.0, 0, 0, 0, 0, -100.0], [0.0, 0, 0.01], [4.0, 1.0, 0.0], 200, 12, 5, 4, 10)
    of_point, of_pose = Window.partitionBy("point"), Window.partitionBy("pose")
    rows = rows.withColumns({"a": F.count(F.lit(1)).over(of_point), "b": F.count(F.lit(1)).over(of_pose), "span": F.max("pose").over(of_point) - F.min("pose").over(of_point)})
    turn, dx, dy = F.col("pose") * 0.01, F.col("px") - 4 * F.col("pose"), F.col("py") - F.col("pose")
    u, v = 5 * (F.cos(turn) * dx + F.sin(turn) * dy) + 319.5, 5 * (F.cos(turn) * dy - F.sin(turn) * dx) + 239.5
    return rows.agg((F.count(F.lit(1)) > 2000).alias("many"), F.count_if(F.col("pz") != 0).alias("off_ground"), F.count_if((F.col("a") < 4) | (F.col("b") < 10) | (F.col("span") > 11)).alias("short"), F.count_if(F.hypot(F.col("x") - u, F.col("y") - v) > 1e-6).alias("elsewhere"))


QUERIES = (synthetic_boards, tracks, reproject_points, reproject_at_distance, image_map, triangulate_pixels, points_within_region, difference_of_pinholes, stereo_pair_difference, distortion_off_pinhole, model_resolution, splined_correction, spline_knots, field_of_view, camera_axes, board_outlines, contours, polygon_difference, valid_region, align_vectors, sorted_eigenvalues, pinhole_gradient, compose_tiny, board_pose, calibrate, bundle_points, bundle_rays, optimizer_callback, pack_state, state_layout, measurement_layout, decode_pairs, pair_counts, point_residuals, perfect_corners, cull_random_boards, frame_numbers)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


# -- SQL -----------------------------------------------------------------------------------------------
_POINTS = "SELECT vec_id, CAST(embedding[7] AS DOUBLE) * 200 + 320 AS x, CAST(embedding[8] AS DOUBLE) * 200 + 240 AS y FROM embeddings"


def _grid(nx: int, ny: int, size=SIZE) -> str:
    return f"(SELECT CAST(i // {nx} AS INTEGER) AS iy, CAST(i % {nx} AS INTEGER) AS ix, (i % {nx}) * CAST({size[0] - 1} AS DOUBLE) / {nx - 1} AS x, (i // {nx}) * CAST({size[1] - 1} AS DOUBLE) / {ny - 1} AS y FROM range({nx * ny}) t(i)) g"


_GRID = _grid(40, 30)
_AX, _AY = "(x - 320.0) / 600.0", "(y - 240.0) / 610.0"
_UNIT = [f"5 * {v} / sqrt(1 + power({_AX}, 2) + power({_AY}, 2))" for v in (f"({_AX})", f"({_AY})", "1")]
_FAR = [f"({v} + {t})" for v, t in zip(_turned(_UNIT), B["rt_cam_ref"][3:], strict=True)]
_CAM = {"ax": "0.1 * k + 0.05", "ay": "-0.05 * k", "az": "CAST(0.2 AS DOUBLE)", "tx": "CAST(k AS DOUBLE)", "ty": "CAST(2 AS DOUBLE)", "tz": "-0.5 * k"}


def _poses(columns: str = "*") -> str:
    """Nations with a pose: matrix m0 to m8 and t."""
    sql = f"SELECT *, {', '.join(f'{x} AS {n}' for n, x in _CAM.items())} FROM {NATIONS}"
    for stage in (*S.axis("a"), {f"m{i}": x for i, x in enumerate(S.matrix("a"))}):
        sql = f"SELECT *, {', '.join(f'{x} AS {n}' for n, x in stage.items())} FROM ({sql}) s"
    return f"({sql}) c"


_M = [f"m{i}" for i in range(9)]
_T = ["tx", "ty", "tz"]
_BACK = [f"-({x})" for x in S.apply(S.transposed(_M), _T)]
_AXES = " UNION ALL ".join(f"SELECT k AS cam, '{a}' AS axis, {_round({f'{c}0': b for c, b in zip('xyz', _BACK, strict=True)} | {f'{c}1': f'{b} + 2 * m{3 * i + j}' for j, (c, b) in enumerate(zip('xyz', _BACK, strict=True))})} FROM {_poses()}" for i, a in enumerate("xyz"))
_OUTLINE = " UNION ALL ".join(f"SELECT k AS frame, CAST({n} AS INTEGER) AS k, {_round({c: f'm{3 * j} * {x} + m{3 * j + 1} * {y} + {t}' for j, (c, t) in enumerate(zip('xyz', _T, strict=True))})} FROM {_poses()}" for n, (x, y) in enumerate(((0.0, 0.0), (0.9, 0.0), (0.9, 0.7), (0.0, 0.7), (0.0, 0.0))))
_SPU = "((nx - 1 - margin) / (4 * tan(radians(120) / 4)))"
_LABELS = "(SELECT label, count(*) AS n, label * 0.1 AS ax, label * -0.05 AS ay, CAST(0.2 AS DOUBLE) AS az FROM embeddings GROUP BY label)"


def _labels(outputs: list[str], extra: str = "") -> str:
    sql = _LABELS
    for stage in S.axis("a"):
        sql = f"(SELECT *, {', '.join(f'{x} AS {n}' for n, x in stage.items())} FROM {sql} s)"
    return f"SELECT label, n, {_round({f'o{i}': x for i, x in enumerate(outputs)})} FROM {sql} s"


def _jacobian(sign: str) -> list[str]:
    """The inverse left (-) or right (+) Jacobian of a rotation vector: h I + (1 - h) axis axis' -+ [r]x / 2, h = (angle / 2) cot(angle / 2), of the angle from -pi to pi."""
    w = "(a_angle - 2 * pi() * round(a_angle / (2 * pi())))"
    h = f"({w} / 2 / tan({w} / 2))"
    k = [f"a_{i}" for i in range(3)]
    skew = ["0", f"-{k[2]}", k[1], k[2], "0", f"-{k[0]}", f"-{k[1]}", k[0], "0"]
    return [f"({h if i == j else '0'} + (1 - {h}) * {k[i]} * {k[j]} {sign} {w} / 2 * ({skew[3 * i + j]}))" for i in range(3) for j in range(3)]


_BOARD_RT = ["0.1 + 0.01 * k", "-0.2 + 0.01 * k", "0.05", "-0.2", "0.1 - 0.01 * k", "1.5 + 0.1 * k"]
_SCENE = "(SELECT k, CAST(i AS INTEGER) AS point, sin(i * 1.7 + k) * 1.5 AS x, cos(i * 2.3) * 1.2 AS y, 6 + sin(i * 0.9 + k) AS z FROM " + NATIONS + ", range(9) t(i))"
_LEN = "sqrt(0.36 + power(0.1 + 0.01 * k, 2) + 0.0025)"


def _callback() -> dict[str, str]:
    out, n = {}, 0
    z = "(2 + 0.1 * k)"
    for (x, y), (u, v, w) in zip(((0, 0), (0.1, 0), (0, 0.1), (0.1, 0.1)), ((300, 250, 1.0), (310, 255, 0.5), (305, 270, 0.8), (0, 0, 0)), strict=True):
        out[f"o{n}"] = f"{w} * ((600 + k) * ({x} + 0.1 * k - 1) / {z} + 320 - {u})"
        out[f"o{n + 1}"] = f"{w} * (610 * ({y} + 0.2) / {z} + 240 + k - {v})"
        n += 2
    out |= {"o8": "0.9 * ((600 + k) * 0.3 / 4 + 320 - 350)", "o9": "0.9 * (610 * (-0.2) / 4 + 240 + k - 200)"}
    out |= {"o10": "0.1 / 64 * (320 - 319.5)", "o11": "0.1 / 64 * (240 + k - 239.5)"}
    return out | {"o12": f"(0.1 * k - 1) / {z}", "o13": f"0.5 * (600 + k) / {z}", "o14": f"-0.5 * (600 + k) * (0.1 + 0.1 * k - 1) / ({z} * {z})", "o15": f"-0.8 * (600 + k) * (0.1 * k - 1) / ({z} * {z})"}


def _packed() -> dict[str, str]:
    turn, far = "radians(0.1)", "radians(15)"
    b = ["(600 + k) / 500.0", "610 / 500.0", "320 / 20.0", "240 / 20.0", "0.1", "0.2", "0.3", "0.01 * k", f"0.1 / {turn}", f"0.2 / {turn}", f"0.3 / {turn}", "k", "5", "6", f"0.3 / {far}", f"0.2 / {far}", f"0.1 / {far}", "4", "5", "k", "1", "2", "k", "0.01 / 0.01", "0.002 * k / 0.01"]
    return {f"o{i}": x for i, x in enumerate([*b, "0.01 * k", "k", "k", "0.002 * k"])}


_LAYOUT = """(SELECT k, k % 3 + 1 AS cameras, CASE WHEN k % 2 = 0 THEN 8 ELSE 12 END AS n, k % 4 AS poses, k % 5 AS frames, k % 6 + 2 AS points, k % 3 AS fixed, 2 * (k % 5) AS boards,
    (k % 3 + 4) * (k % 2 + 3) * 2 AS each, 3 * (k % 6) AS views, k * 2 AS pairs, k % 2 = 0 AS core, k % 3 > 0 AS dist, k % 5 > 0 AS ext, k % 7 > 0 AS fr, k % 4 > 0 AS warp, k % 6 > 0 AS reg, k % 3 = 1 AS unity FROM {0})""".format(NATIONS)


def _layout_sql(blocks: dict[str, tuple[str, str]], items: dict[str, int], prefix: str) -> str:
    """blocks: name to (number, width of one item)."""
    counts = ", ".join(f"CAST({n} AS BIGINT) AS c_{b}" for b, (n, _) in blocks.items())
    widths = ", ".join(f"CAST({w} AS BIGINT) AS w_{b}" for b, (_, w) in blocks.items())
    names = list(blocks)
    columns = []
    for i, b in enumerate(names):
        start = " + ".join([f"c_{x}" for x in names[:i]] or ["0"])
        at = items.get(b, 0)
        columns += [f"c_{b} AS num_{prefix}_{b}", f"CASE WHEN {at} * w_{b} < c_{b} THEN CAST({start} + {at} * w_{b} AS BIGINT) END AS {prefix}_index_{b}"]
    return f"SELECT k, {' + '.join(f'c_{b}' for b in names)} AS num_{prefix}s, {', '.join(columns)} FROM (SELECT k, {counts}, {widths} FROM {_LAYOUT} l) c"


_EACH_CAMERA = "(CASE WHEN core THEN 4 ELSE 0 END + CASE WHEN dist THEN n - 4 ELSE 0 END)"
_REGULAR = "(CASE WHEN reg THEN cameras * (CASE WHEN dist THEN n - 4 ELSE 0 END + CASE WHEN core THEN 2 ELSE 0 END) ELSE 0 END + CASE WHEN unity AND ext AND poses > 0 THEN 1 ELSE 0 END)"
_SETS = "SELECT user_id, event_id, sum(b) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS set_id FROM (SELECT user_id, event_id, coalesce(lag(CAST(event_type = 'purchase' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS b FROM events) e"

SQL: dict[str, str] = {
    "reproject_points": f"SELECT vec_id, {_round(dict(zip(('x1', 'y1'), _pixel(_turned(_ray('x', 'y', A['intrinsics'])), B['intrinsics']), strict=True)))} FROM ({_POINTS}) p",
    "reproject_at_distance": f"SELECT vec_id, {_round(dict(zip(('x1', 'y1'), _pixel(_FAR, B['intrinsics']), strict=True)))} FROM ({_POINTS}) p",
    # a target pixel's ray turned back: by the opposite turn, so the axis changes its sign
    "image_map": f"SELECT CAST(i // 40 AS INTEGER) AS y, CAST(i % 40 AS INTEGER) AS x, {{0}} FROM (SELECT i, CAST(i % 40 AS DOUBLE) AS px, CAST(i // 40 AS DOUBLE) AS py FROM range(1200) t(i)) g",
    "triangulate_pixels": f"SELECT vec_id, {_round({'px': 'CAST(embedding[7] AS DOUBLE)', 'py': 'CAST(embedding[8] AS DOUBLE)', 'pz': 'CAST(embedding[9] AS DOUBLE) * 0.5 + 4'}, 5)} FROM embeddings",
    # a convex region, so inside is to the same side of all four edges
    "points_within_region": "SELECT vec_id, (400 * (y - 100) - 20 * (x - 100) > 0 AND 20 * (y - 120) - 280 * (x - 500) > 0 AND -430 * (y - 400) + 20 * (x - 520) > 0 AND 10 * (y - 380) + 280 * (x - 90) > 0) AS within FROM (SELECT vec_id, CAST(embedding[7] AS DOUBLE) * 600 + 320 AS x, CAST(embedding[8] AS DOUBLE) * 600 + 240 AS y FROM embeddings) p",
    "difference_of_pinholes": f"SELECT iy, ix, {_round({'dx': f'500 * {_AX} + 310 - x', 'dy': f'505 * {_AY} + 250 - y'}, 4)} FROM {_GRID}",
    "stereo_pair_difference": f"SELECT iy, ix, {_round({'dx': f'600 * (-0.505 + 0.5) / (10 / sqrt(1 + power({_AX}, 2) + power({_AY}, 2)))', 'dy': 'CAST(0 AS DOUBLE)'})} FROM {_GRID}",
    "distortion_off_pinhole": f"SELECT iy, ix, {_round({'dx': f'600 * {_AX} / (1 - (power({_AX}, 2) + power({_AY}, 2)) / 4) + 320 - x', 'dy': f'610 * {_AY} / (1 - (power({_AX}, 2) + power({_AY}, 2)) / 4) + 240 - y'})} FROM {_GRID}",
    # a pinhole stretches by 1 / cos across the radius and by 1 / cos^2 along it
    "model_resolution": f"SELECT iy, ix, {_round({'deg_pixel': 'degrees((c + c * c) / 600) / 2'})} FROM (SELECT *, 1 / sqrt(1 + power((x - 320) / 600, 2) + power((y - 240) / 600, 2)) AS c FROM {_GRID}) r",
    "splined_correction": f"SELECT iy, ix, {_round({'ux': 'ux', 'uy': 'uy', 'dux': '0.01 + 0.002 * (ux * s + 5.5)', 'duy': '-0.02 + 0.003 * (uy * s + 4)'})} FROM (SELECT *, (ix / 19.0 - 0.5) * 9 / s AS ux, (iy / 14.0 - 0.5) * 6 / s AS uy FROM (SELECT CAST(i // 20 AS INTEGER) AS iy, CAST(i % 20 AS INTEGER) AS ix, 9 / (4 * tan(radians(110) / 4)) AS s FROM range(300) t(i)) g) u",
    "spline_knots": f"SELECT k, {_round({'o0': '-(nx - 1) / 2 / s', 'o1': '(nx - 1) / 2 / s', 'o2': '-(ny - 1) / 2 / s', 'o3': '(ny - 1) / 2 / s', 'o4': '-((nx - 1) / 2 - margin / 2) / s', 'o5': '((ny - 1) / 2 - margin / 2) / s'})} FROM (SELECT *, {_SPU} AS s FROM (SELECT k, CAST(k + 6 AS DOUBLE) AS nx, CAST(k + 5 AS DOUBLE) AS ny, CAST(1 + k % 2 AS DOUBLE) AS margin FROM {NATIONS}) a) b",
    "field_of_view": f"SELECT k, {_round({'across': 'degrees(atan((300 + k) / f) + atan((639 - 300 - k) / f))', 'down': 'degrees(atan((250 - k) / 610) + atan((479 - 250 + k) / 610))', 'corners': 'degrees(atan(sqrt(power((300 + k) / f, 2) + power((250 - k) / 610, 2))) + atan(sqrt(power((300 + k) / f, 2) + power((229 + k) / 610, 2))) + atan(sqrt(power((339 - k) / f, 2) + power((250 - k) / 610, 2))) + atan(sqrt(power((339 - k) / f, 2) + power((229 + k) / 610, 2)))) / 2'})} FROM (SELECT CAST(k AS DOUBLE) AS k0, k, 600.0 + 10 * k AS f FROM {NATIONS}) a",
    "camera_axes": _AXES,
    "board_outlines": _OUTLINE,
    "contours": f"SELECT k, CAST(4 AS BIGINT) AS closed, CAST(1 + greatest(1, ceil((k + 4) / 3.0)) + greatest(1, ceil(sqrt(power(k + 4, 2) + power(k + 3, 2)) / 3.0)) + greatest(1, ceil((k + 3) / 3.0)) AS BIGINT) AS dense FROM {NATIONS}",
    # the small square may stick out of the large one
    "polygon_difference": f"SELECT k, {_round({'area': '100 - greatest(0, least(10, 3 + k / 4.0 + k / 2.0) - (2 + k / 4.0)) * (least(10, 4 + k / 2.0) - 3)'})} FROM {NATIONS}",
    "valid_region": f"SELECT k, {_round({'vertices': 'CAST(2 * (1 + k % 5) + 2 * (1 + k % 4) + 1 AS DOUBLE)', 'area': 'CAST((1 + k % 5) * (1 + k % 4) AS DOUBLE)', 'left': 'CAST(45 AS DOUBLE)', 'bottom': 'CAST(35 + 10 * (1 + k % 4) AS DOUBLE)'})} FROM {NATIONS}",
    "align_vectors": _labels(S.matrix("a")),
    "procrustes_groups": _labels([*S.matrix("a"), "CAST(label AS DOUBLE)", "CAST(2 AS DOUBLE)", "CAST(3 AS DOUBLE)"]),
    "sorted_eigenvalues": f"SELECT cam, {_round({'low': '(a + c) / 2 - s', 'high': '(a + c) / 2 + s'}, 3)} FROM (SELECT *, sqrt(power((a - c) / 2, 2) + b * b) AS s FROM (SELECT cam, var_pop(dx) AS a, covar_pop(dx, dy) AS b, var_pop(dy) AS c FROM ({fixtures.RESIDUAL_SQL}) r GROUP BY cam) v) w",
    "pinhole_gradient": f"SELECT vec_id, {_round({f'o{i}': x for i, x in enumerate(['600 / z', '0', '-600 * x / (z * z)', '0', '610 / z', '-610 * y / (z * z)', 'x / z', '0', '1', '0', '0', 'y / z', '0', '1'])})} FROM (SELECT vec_id, CAST(embedding[7] AS DOUBLE) AS x, CAST(embedding[8] AS DOUBLE) AS y, CAST(embedding[9] AS DOUBLE) * 0.5 + 2 AS z FROM embeddings) p",
    "compose_tiny": S.select([*_jacobian("-"), *_jacobian("+")], *S.axis("a")),
    "board_pose": f"SELECT k, {_round({f'o{i}': x for i, x in enumerate(_BOARD_RT)})} FROM {NATIONS}",
    "calibrate": f"SELECT k, c AS icam, {_round({f'i{j}': x for j, x in enumerate(['1200 + k', '1210 + k', '960', '600', '-0.1', '0.002 * k', '0.001', '-0.001'])}, 3)}, {_round({f'o{j}': x for j, x in enumerate(['0.02 * c', '-0.03 * c', '0.01 * c', '-0.3 * c', '0.01 * c', '0.02 * c'])}, 4)}, CAST(0 AS DOUBLE) AS rms, CAST(0 AS BIGINT) AS outliers FROM {NATIONS}, (SELECT CAST(unnest([0, 1]) AS INTEGER) AS c) c",
    "bundle_points": f"SELECT k, point, {_round({c: c for c in 'xyz'}, 5)} FROM {_SCENE} s",
    "bundle_rays": f"SELECT k, {_round({f'o{i}': x for i, x in enumerate(['0.02', '0.1', '-0.01', f'-0.6 / {_LEN}', f'(0.1 + 0.01 * k) / {_LEN}', f'0.05 / {_LEN}'])}, 4)} FROM {NATIONS}",
    "optimizer_callback": f"SELECT k, {_round(_callback())} FROM {NATIONS}",
    "pack_state": f"SELECT k, {_round(_packed())} FROM {NATIONS}",
    "state_layout": _layout_sql(
        {"intrinsics": (f"cameras * {_EACH_CAMERA}", _EACH_CAMERA), "extrinsics": ("CASE WHEN ext THEN 6 * poses ELSE 0 END", "6"), "frames": ("CASE WHEN fr THEN 6 * frames ELSE 0 END", "6"), "points": ("CASE WHEN fr THEN 3 * (points - fixed) ELSE 0 END", "3"), "warp": ("CASE WHEN warp AND boards > 0 THEN 2 ELSE 0 END", "2")},
        {"intrinsics": 1, "extrinsics": 2, "frames": 1, "points": 1},
        "state",
    ),
    "measurement_layout": _layout_sql({"boards": ("boards * each", "each"), "points": ("2 * views", "2"), "triangulated": ("pairs", "1"), "regularization": (_REGULAR, "1")}, {"boards": 1, "points": 2, "triangulated": 3}, "measurement"),
    "decode_pairs": f"WITH s AS ({_SETS}), f AS (SELECT user_id, set_id, min(event_id) AS first FROM s GROUP BY 1, 2) SELECT p.user_id, row_number() OVER (PARTITION BY p.user_id ORDER BY f.first, p.event_id, q.event_id) - 1 AS measurement, p.event_id AS seq0, q.event_id AS seq1 FROM s p JOIN s q ON p.user_id = q.user_id AND p.set_id = q.set_id AND p.event_id < q.event_id JOIN f ON f.user_id = p.user_id AND f.set_id = p.set_id",
    "pair_counts": f"WITH s AS ({_SETS}) SELECT user_id, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pair_count FROM (SELECT user_id, set_id, count(*) AS n FROM s GROUP BY 1, 2) c GROUP BY 1",
    "point_residuals": "SELECT cam, w, count(*) AS n, round(avg(dx), 4) + 0.0 AS dx, round(avg(dy), 4) + 0.0 AS dy, round(max(abs(dx)), 4) + 0.0 AS most FROM (SELECT cam, w, CASE WHEN w > 0 THEN w * (600 * (px + cam * 0.5) / pz + 320 - x) ELSE 0 END AS dx, CASE WHEN w > 0 THEN w * (610 * (py + CASE WHEN cam > 0 THEN 0.1 ELSE 0 END) / pz + 240 - y) ELSE 0 END AS dy FROM (SELECT CAST(l_suppkey % 4 AS INTEGER) AS cam, CAST(l_quantity AS DOUBLE) AS x, l_linenumber * 10.0 AS y, CAST(l_suppkey % 3 - 1 AS DOUBLE) AS w, p_size * 0.1 AS px, (p_partkey % 7) * 0.1 AS py, 5.0 + p_partkey % 5 AS pz FROM lineitem JOIN part ON p_partkey = l_partkey) j) r GROUP BY cam, w",
    "perfect_corners": f"SELECT frame, cam, idx, w, {_round({'x': '1800 * ((idx % 3) * 0.1 + (cam - 1.5) * 0.2) / (2.0 + (frame % 7) * 0.5) + 1999.5', 'y': '1800 * (floor(idx / 3) * 0.1) / (2.0 + (frame % 7) * 0.5) + 999.5'})} FROM ({CORNER_SQL}) c",
    "cull_random_boards": f"SELECT CAST(round(n / 3.0) AS BIGINT) AS gone, n - CAST(round(n / 3.0) AS BIGINT) AS kept FROM (SELECT count(*) AS n FROM (SELECT DISTINCT frame, cam FROM ({CORNER_SQL}) c) b) t",
    "synthetic_boards": "SELECT CAST(25 AS BIGINT) AS frames, CAST(24 AS BIGINT) AS last, CAST(1500 AS BIGINT) AS corners, CAST(0 AS BIGINT) AS off, CAST(0 AS BIGINT) AS elsewhere",
    "tracks": "SELECT TRUE AS many, CAST(0 AS BIGINT) AS off_ground, CAST(0 AS BIGINT) AS short, CAST(0 AS BIGINT) AS elsewhere",
    "frame_numbers": "SELECT CAST(o_custkey % 2 AS INTEGER) AS cam, o_orderkey AS frame, CAST(19 AS BIGINT) AS length FROM orders",
}


def _image_map() -> str:
    back = _turned_by(_ray("px", "py", B["intrinsics"]), [-x for x in TURN])
    return _round(dict(zip(("x1", "y1"), _pixel(back, A["intrinsics"]), strict=True)))


SQL["image_map"] = SQL["image_map"].format(_image_map())


def oracle_sql() -> dict[str, str]:
    return SQL
