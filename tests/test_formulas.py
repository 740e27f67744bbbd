"""Formulas: NumPy against independent matrix code, dual numbers against differences, columns against NumPy, round trips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import imaging, lens, pose, triangulation
from plumbline.functions.scalars import NUMPY, on_arrays, on_frame, values, with_gradients

rng = np.random.default_rng(0)


def matrix(r):
    th = np.linalg.norm(r)
    k = r / th if th else np.array([1.0, 0, 0])
    K = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + math.sin(th) * K + (1 - math.cos(th)) * K @ K


ANGLES = [0.0, 1e-9, 1e-6, 1e-4, 0.3, 2.0, math.pi - 1e-4, math.pi - 1e-8, math.pi]


@pytest.mark.parametrize("angle", ANGLES)
def test_rotations_at_all_angles(angle):
    for _ in range(10):
        k = rng.standard_normal(3)
        r = k / np.linalg.norm(k) * angle
        R = on_arrays(pose.R_from_r)(r).reshape(3, 3)
        assert np.allclose(R, matrix(r), atol=1e-12)
        back = on_arrays(pose.r_from_R)(R.ravel())
        assert min(np.abs(back - r).max(), np.abs(back + r).max() if angle > math.pi - 1e-6 else np.inf) < 1e-7
        assert np.allclose(matrix(back), R, atol=1e-9)


def test_pose_algebra():
    for _ in range(20):
        a, b, x = rng.standard_normal(6), rng.standard_normal(6), rng.standard_normal(3)
        A, B = matrix(a[:3]), matrix(b[:3])
        c = on_arrays(pose.compose_rt)(a, b)
        assert np.allclose(matrix(c[:3]), A @ B) and np.allclose(c[3:], A @ b[3:] + a[3:])
        assert np.allclose(on_arrays(pose.transform_point_rt)(a, x), A @ x + a[3:])
        i = on_arrays(pose.compose_rt)(a, on_arrays(pose.invert_rt)(a))
        assert np.abs(i).max() < 1e-9
        q = on_arrays(pose.quat_from_R)(A.ravel())
        assert abs(np.linalg.norm(q) - 1) < 1e-12 and np.allclose(on_arrays(pose.R_from_quat)(q).reshape(3, 3), A)
        assert np.allclose(on_arrays(pose.transform_point_rt_inverted)(a, A @ x + a[3:]), x)
        z = on_arrays(pose.R_aligned_to_vector)(x).reshape(3, 3)
        assert np.allclose(z @ x, [0, 0, np.linalg.norm(x)]) and np.allclose(z @ z.T, np.eye(3)) and np.linalg.det(z) > 0


@pytest.mark.parametrize("f,sizes", [(pose.R_from_r, (3,)), (pose.compose_rt, (6, 6)), (pose.transform_point_rt, (6, 3)), (pose.invert_rt, (6,)), (pose.rotate_point_r, (3, 3)), (triangulation.leecivera_mid2, None), (triangulation.geometric, None), (triangulation.leecivera_linf, None)])
def test_gradients(f, sizes):
    args = [rng.standard_normal((7, n)) for n in sizes] if sizes else [np.array([[0.1, 0.05, 1.0]]), np.array([[-0.2, 0.06, 1.0]]), np.array([[1.0, 0.1, 0.0]])]
    v, *grads = with_gradients(f)(*args)
    assert np.allclose(v, on_arrays(f)(*args))
    for k, g in enumerate(grads):
        for i in range(args[k].shape[-1]):
            e = np.zeros_like(args[k])
            e[..., i] = 1e-6
            up = on_arrays(f)(*[a + e if j == k else a for j, a in enumerate(args)])
            down = on_arrays(f)(*[a - e if j == k else a for j, a in enumerate(args)])
            assert np.allclose((up - down) / 2e-6, g[..., i], atol=1e-6)


def test_gradients_at_the_identity():
    v, j = with_gradients(pose.R_from_r)(np.zeros(3))
    assert np.allclose(v.reshape(3, 3), np.eye(3)) and np.isfinite(j).all()
    v, a, b = with_gradients(pose.compose_r)(np.zeros(3), np.array([0.1, 0.2, 0.3]))
    assert np.allclose(v, [0.1, 0.2, 0.3]) and np.isfinite(a).all() and np.allclose(b, np.eye(3))


def test_triangulation_finds_exact_points():
    p, t = np.array([0.3, -0.2, 5.0]), np.array([1.0, 0.1, -0.05])
    for f in triangulation.METHODS.values():
        assert np.allclose(on_arrays(f)(p, p - t, t), p, atol=1e-9)
    rt = np.array([0.1, -0.05, 0.02, *t])
    R = matrix(rt[:3])
    got = on_arrays(triangulation.lindstrom)(p, R.T @ (p - t), np.concatenate([R.ravel(), t]))
    assert np.allclose(got, p, atol=1e-9)
    for name in ("leecivera-mid2", "leecivera-wmid2", "geometric", "leecivera-l1", "leecivera-linf"):
        assert np.allclose(on_arrays(triangulation.METHODS[name])(np.array([-0.5, 0, 1.0]), np.array([0.5, 0.0, 1.0]), t), 0), name  # rays that diverge


MODELS = {
    "LENSMODEL_PINHOLE": [],
    "LENSMODEL_STEREOGRAPHIC": [],
    "LENSMODEL_LONLAT": [],
    "LENSMODEL_LATLON": [],
    "LENSMODEL_OPENCV4": [0.05, -0.02, 0.001, -0.002],
    "LENSMODEL_OPENCV5": [0.05, -0.02, 0.001, -0.002, 0.01],
    "LENSMODEL_OPENCV8": [0.05, -0.02, 0.001, -0.002, 0.01, 0.02, 0.01, 0.005],
    "LENSMODEL_OPENCV12": [0.05, -0.02, 0.001, -0.002, 0.01, 0.02, 0.01, 0.005, 0.001, 0.002, -0.001, 0.001],
    "LENSMODEL_CAHVOR": [0.01, -0.02, 0.01, 0.02, -0.01],
    "LENSMODEL_CAHVORE_linearity=0.37": [0.01, -0.02, 0.01, 0.02, -0.01, 0.0, 0.0, 0.0],
    "LENSMODEL_SPLINED_STEREOGRAPHIC_order=3_Nx=11_Ny=8_fov_x_deg=120": None,
    "LENSMODEL_SPLINED_STEREOGRAPHIC_order=2_Nx=11_Ny=8_fov_x_deg=120": None,
}


@pytest.mark.parametrize("name", MODELS)
def test_lens_models(name):
    n = lens.lensmodel(name).num_params
    i = np.array([1500, 1490, 1000, 800] + (MODELS[name] if MODELS[name] is not None else list(rng.standard_normal(n - 4) * 0.01)), float)
    assert len(i) == n and lens.lensmodel(name).name == name
    p = rng.standard_normal((30, 3)) * [0.3, 0.3, 0.1] + [0, 0, 1]
    q, dp, di = lens.project_with_gradients(p, name, i)
    assert np.allclose(q, lens.project(p, name, i))
    for k in range(3):
        e = np.eye(3)[k] * 1e-6
        assert np.allclose((lens.project(p + e, name, i) - lens.project(p - e, name, i)) / 2e-6, dp[..., k], rtol=1e-5, atol=1e-3)
    for k in range(0, n, max(1, n // 12)):
        e = np.eye(n)[k] * 1e-6
        assert np.allclose((lens.project(p, name, i + e) - lens.project(p, name, i - e)) / 2e-6, di[..., k], rtol=1e-5, atol=1e-3)
    v = lens.unproject(q, name, i, normalize=True)
    assert np.allclose(v, p / np.linalg.norm(p, axis=1, keepdims=True), atol=1e-9)
    for unit in (True, False):
        v, dq, di = lens.unproject_with_gradients(q, name, i, unit)
        assert np.allclose(v, lens.unproject(q, name, i, unit), atol=1e-9)
        for k in range(2):
            e = np.eye(2)[k] * 1e-4
            assert np.allclose((lens.unproject(q + e, name, i, unit) - lens.unproject(q - e, name, i, unit)) / 2e-4, dq[..., k], rtol=1e-3, atol=1e-7)
        for k in range(0, 9 if "CAHVORE" in name else n, max(1, n // 6)):  # a pupil that moves has no unprojection
            e = np.eye(n)[k] * 1e-5
            assert np.allclose((lens.unproject(q, name, i + e, unit) - lens.unproject(q, name, i - e, unit)) / 2e-5, di[..., k], rtol=1e-3, atol=2e-5)


# Published pixels of three points for each lens model, within 0.01.
POINTS = np.array([(1.0, 2.0, 10.0), (-1.1, 0.3, 1.0), (-0.9, -1.5, 1.0)])
CORES = [(1512.0, 1112, 500.0, 333.0), (1502.0, 1112, 500.0, 433.0), (1522.0, 1112, 500.0, 533.0)]
OPENCV = [1512.0, 1112, 500.0, 333.0, -0.012, 0.035, -0.001, 0.002, 0.019, 0.014, -0.056, 0.050]
BENT = [4842.918, 4842.771, 1970.528, 1085.302, -0.001, 0.002, -0.637, -0.002, 0.016]
GOLDEN = [
    ("LENSMODEL_PINHOLE", [(1512.0, 1112, 500.0, 333.0), (1512.0, 1112, 500.0, 433.0), (1512.0, 1112, 500.0, 533.0)], [(651.2, 555.4), (-1163.2, 766.6), (-860.8, -1135.0)]),
    ("LENSMODEL_STEREOGRAPHIC", CORES, [(649.35582325, 552.6874014), (-813.05440267, 698.1222302), (-408.67354332, -573.48815174)]),
    ("LENSMODEL_LATLON", CORES, [(647.79131656, 552.50386255), (-718.86844854, 757.09995546), (-204.73403533, -559.86662025)]),
    ("LENSMODEL_LONLAT", CORES, [(650.69900257, 551.44238248), (-751.13786254, 654.42977413), (-615.34458492, -400.73749463)]),
    ("LENSMODEL_OPENCV4", [OPENCV[:8]] * 3, [(651.27371, 555.23042), (-1223.38516, 678.01468), (-1246.7310448, -1822.799928)]),
    ("LENSMODEL_OPENCV5", [OPENCV[:9]] * 3, [(651.2740691, 555.2309482), (-1292.8121176, 691.9401448), (-1987.550162, -2730.85863427)]),
    ("LENSMODEL_OPENCV8", [OPENCV] * 3, [(651.1885442, 555.10514968), (-1234.45480366, 680.23499814), (-770.03274263, -1238.4871943)]),
    ("LENSMODEL_CAHVOR", [BENT] * 3, [(2143.17840406, 1442.93419919), (-92.63813066, 1653.09646897), (-249.83199315, -2606.46477164)]),
    ("LENSMODEL_CAHVORE_linearity=0.00", [[*BENT, 1e-8, 2e-8, 3e-8]] * 3, [(2140.340769278752759, 1437.371480086463635), (496.634661939782575, 1493.316705796434917), (970.117888562484495, -568.301135889864668)]),
    ("LENSMODEL_CAHVORE_linearity=0.00", [[*BENT, 1e-2, 2e-2, 3e-2]] * 3, [(2140.342263050081783, 1437.374408380910836), (491.682975341940221, 1494.659342555658441), (962.730552352575160, -580.643118338666000)]),
    ("LENSMODEL_CAHVORE_linearity=0.40", [[*BENT, 1e-2, 2e-2, 3e-2]] * 3, [(2140.788976358770469, 1438.250116781426641), (426.278593220184689, 1512.393568241352796), (882.926242407330619, -713.971745152981612)]),
]


@pytest.mark.parametrize("name, intrinsics, pixels", GOLDEN)
def test_published_pixels(name, intrinsics, pixels):
    got = np.array([lens.project(p, name, np.array(i, float)) for p, i in zip(POINTS, intrinsics, strict=True)])
    assert np.abs(got - pixels).max() < 1e-2


def test_cahvore_where_no_ray_enters():
    i = np.array([*BENT, 0.0, 0.0, 0.0])
    got = lens.project(np.array([[0.0, 0.0, 1.0], [3.0, 0.0, -1.0], [0.1, 0.2, 1.0]]), lens.LensModel("LENSMODEL_CAHVORE", linearity=1.0), i)
    assert np.isfinite(got[[0, 2]]).all() and np.isnan(got[1]).all()
    zeta, size, pupil = np.array([1.0, 2.0, 0.5]), np.array([0.3, 0.0, 1.5]), (0.01, 0.02, 0.03)
    t = lens.entry_angle(zeta, size, pupil, math.pi)
    assert np.allclose(zeta * np.sin(t) - size * np.cos(t), (t - np.sin(t)) * (0.01 + 0.02 * t**2 + 0.03 * t**4), atol=1e-12)


@pytest.mark.parametrize("order", [2, 3])
def test_splines_as_columns_equal_arrays(spark, order):
    name = f"LENSMODEL_SPLINED_STEREOGRAPHIC_order={order}_Nx=11_Ny=8_fov_x_deg=120"
    i = np.array([1500, 1490, 1000, 800, *(np.random.default_rng(5).standard_normal(176) * 0.01)])
    p = np.random.default_rng(6).standard_normal((200, 3))
    df = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(p)] + [(200, 0.0, 0.0, -1.0), (201, None, 1.0, 1.0)], "k int, x double, y double, z double")
    got = lens.with_pixels(df, [F.col(c) for c in "xyz"], name, i).orderBy("k").collect()
    assert np.allclose([(r.qx, r.qy) for r in got[:200]], lens.project(p, name, i), rtol=1e-12, atol=1e-9)
    assert got[200].qx is None and got[201].qy is None
    code = on_frame(df, lens.splined_formula(lens.lensmodel(name), i), [[F.col(c) for c in "xyz"]], names=["qx", "qy"]).orderBy("k").limit(200).collect()
    assert np.allclose([(r.qx, r.qy) for r in code], lens.project(p, name, i), rtol=1e-12, atol=1e-9)
    generic = values(lens.project_splined(NUMPY, lens.lensmodel(name), i, [p[:, k] for k in range(3)])[0])
    assert np.allclose(generic, lens.project(p, name, i), rtol=1e-12, atol=1e-9)


def test_projections_with_a_model_a_row(spark):
    rows = [(0, [0.1, 0.2, 1.0], "LENSMODEL_PINHOLE", [500.0, 510.0, 320.0, 240.0]), (1, [0.1, 0.2, 1.0], "LENSMODEL_PINHOLE", [600.0, 510.0, 320.0, 240.0]), (2, None, "LENSMODEL_PINHOLE", [500.0, 510.0, 320.0, 240.0]), (3, [0.3, -0.2, 2.0], "LENSMODEL_OPENCV4", [500.0, 510.0, 320.0, 240.0, 0.1, 0.0, 0.0, 0.0]), (4, [0.1, None, 1.0], "LENSMODEL_PINHOLE", [500.0, 510.0, 320.0, 240.0]), (5, [0.1, 0.2, 1.0], None, None)]
    df = spark.createDataFrame(rows, "k int, p array<double>, lensmodel string, intrinsics array<double>").coalesce(1)
    got = {r.k: r.q for r in lens.with_projections(df).collect()}
    assert got[2] is got[4] is got[5] is None
    for k in (0, 1, 3):
        assert np.allclose(got[k], lens.project(np.array(rows[k][1]), rows[k][2], np.array(rows[k][3])))


def test_an_aligned_rotation_leaves_the_z_axis():
    R = on_arrays(pose.R_aligned_to_vector)(np.array([[0.0, 0.0, 1.0], [0.0, 0.0, 5.0], [2.0, 0.0, 0.0]])).reshape(3, 3, 3)
    assert np.allclose(R[:2], np.eye(3)) and np.allclose(R[2], [[0, 1, 0], [0, 0, 1], [1, 0, 0]])


def test_divergent_rays_cost_more():
    t = np.array([1.0, 0.0, 0.0])
    f = lambda a, b: float(on_arrays(triangulation.reprojection_angle)(np.array(a), np.array(b), t))
    assert f([0.2, 0.0, 1.0], [-0.2, 0.0, 1.0]) < 1e-7
    small, large = f([-0.01, 0.0, 1.0], [0.01, 0.0, 1.0]), f([-0.4, 0.0, 1.0], [0.4, 0.0, 1.0])
    assert large > 0.7 and small < large
    x = np.array([-1.0, 0.0, 0.75, 1.5, 2.25, 3.0, 9.0])
    assert triangulation.smooth_step(NUMPY, x).tolist() == [0, 0, 0.125, 0.5, 0.875, 1, 1]


def test_lens_names():
    assert lens.parse_name("LENSMODEL_NOPE") == lens.UNKNOWN
    assert lens.parse_name("LENSMODEL_CAHVORE") == lens.parse_name("LENSMODEL_SPLINED_STEREOGRAPHIC") == lens.MISSING_CONFIG
    assert lens.parse_name("LENSMODEL_CAHVORE_linearity=x") == lens.BAD_CONFIG
    assert lens.lensmodel("LENSMODEL_SPLINED_STEREOGRAPHIC_order=3_Nx=30_Ny=18_fov_x_deg=150").num_params == 4 + 2 * 30 * 18


def test_unprojection_without_an_answer_is_null():
    v = lens.unproject(np.array([[1e6, 1e6]]), "LENSMODEL_OPENCV8", np.array([1500.0, 1500, 1000, 800, 0, 0, 0, 0, 0, 1.0, 0, 0]))
    assert np.isnan(v).all()


def test_color_map_ends():
    got = np.stack(imaging.color(NUMPY, np.array([-1.0, 0.0, 0.5, 1.0, 2.0]), 0.0, 1.0), -1)
    assert got[0].tolist() == got[1].tolist() == [0, 0, 0] and got[3].tolist() == got[4].tolist() == [255, 255, 0]


def test_stereo_range_limits():
    f = lambda d: imaging.stereo_range(NUMPY, "LENSMODEL_PINHOLE", np.array(d), [1000.0, 800.0], [1500.0, 1500, 1000, 800], 0.5, 1.0, 80.0)
    assert f([0.0, -1.0, 0.5, 81.0]).tolist() == [0, 0, 0, 0] and np.allclose(f([1.0, 80.0]), [750.0, 9.375])


def test_columns_equal_arrays(spark):
    a, x = rng.standard_normal((50, 6)), rng.standard_normal((50, 3))
    df = spark.createDataFrame([(i, p.tolist(), q.tolist()) for i, (p, q) in enumerate(zip(a, x, strict=True))], "i int, a array<double>, x array<double>")
    got = on_frame(df, pose.transform_point_rt, [[F.col("a")[i] for i in range(6)], [F.col("x")[i] for i in range(3)]], out="y").orderBy("i").collect()
    assert np.allclose([r.y for r in got], on_arrays(pose.transform_point_rt)(a, x), atol=1e-12)


def test_polygons(spark):
    sq = "array(struct(0D as x, 0D as y), struct(4D as x, 0D as y), struct(4D as x, 4D as y), struct(0D as x, 4D as y))"
    df = spark.createDataFrame([(1.0, 1.0), (4.0, 1.0), (0.0, 0.0), (5.0, 1.0), (2.0, 4.0)], "x double, y double").withColumn("p", F.expr(sq))
    assert [r[0] for r in df.select(imaging.within_polygon(F.col("x"), F.col("y"), F.col("p"))).collect()] == [True, False, False, False, False]
    r = df.select(F.size(imaging.close_contour(F.col("p"))), F.size(imaging.close_contour(imaging.close_contour(F.col("p")))), F.size(imaging.densify(F.col("p"), 1.0))).first()
    assert tuple(r) == (5, 5, 13)
    pieces = imaging.polygon_difference(np.array([[0, 0], [4, 0], [4, 4], [0, 4]]), np.array([[1, 1], [2, 1], [2, 2], [1, 2]]))
    assert abs(sum(abs(imaging.polygon_area(p)) for p in pieces) - 15) < 1e-9


def test_grids_round_half_to_even():
    assert imaging.grid_height(5, None, 1000, 500) == 2 and imaging.grid_height(7, None, 1000, 500) == 4


def test_resolution_and_field_of_view():
    i = np.array([1000.0, 1000, 999.5, 499.5])
    r = lens.model_resolution_deg_pixel(np.array([[999.5, 499.5]]), "LENSMODEL_PINHOLE", i, "mean")
    assert np.allclose(r, math.degrees(1 / 1000))
    assert abs(lens.report_fov("LENSMODEL_PINHOLE", i, (2000, 1000))["horizontal"] - 2 * math.degrees(math.atan(0.9995))) < 1e-9
    assert values([np.float64(1)])[0] == 1
