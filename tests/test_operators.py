"""Observation operators, relations, solvers and sources on small hand-made inputs."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import lens, pose
from plumbline.functions.scalars import NUMPY, values
from plumbline.operators import alignment, solver, stereo, synthetic, uncertainty
from plumbline.operators import observations as obs
from plumbline.operators import relations as rel
from plumbline.sources import models, tables
from plumbline.streaming import culling

RES = "frame int, cam int, idx int, x double, y double, w double, dx double, dy double"


def test_corner_table(spark, tmp_path):
    (tmp_path / "c.vnl").write_text("# filename x y level\nframe1-cam1.jpg 1 2 0\nframe1-cam1.jpg - - -\nframe1-cam1.jpg 3 4 2\nframe2-cam2.jpg 5 6\n# c\nother.png 1 1 0\nframe2-cam2.jpg -1 6 0\n")
    rows = tables.assign_cameras(tables.read_corners(spark, str(tmp_path)), ["*-cam1.jpg", "*-cam2.jpg"]).orderBy("line").collect()
    assert [(r.cam, r.w) for r in rows] == [(0, 1.0), (0, -1.0), (0, 0.25), (1, 1.0), (1, -1.0)]
    rows = tables.read_corners(spark, str(tmp_path), "weight").orderBy("line").collect()
    assert [r.w for r in rows][:3] == [-1.0, -1.0, 2.0]


def test_frame_numbers(spark):
    df = spark.createDataFrame([("a0995b.jpg", 0), ("a0996b.jpg", 0), ("a1000b.jpg", 0), ("z7.jpg", 1)], "path string, cam int")
    assert {r.path: r.frame for r in rel.frame_numbers(df).collect()} == {"a0995b.jpg": 995, "a0996b.jpg": 996, "a1000b.jpg": 1000, "z7.jpg": 0}


def test_outliers_need_a_far_one(spark):
    near = [(i, 0, 0, 0.0, 0.0, 1.0, 1.0, -1.0) for i in range(100)]
    df = spark.createDataFrame([*near, (200, 0, 0, 0.0, 0.0, 1.0, 4.4, 0.0)], RES)
    assert obs.mark_outliers(df).filter("outlier").count() == 0
    df = spark.createDataFrame([*near, (200, 0, 0, 0.0, 0.0, 1.0, 40.0, 0.0), (201, 0, 0, 0.0, 0.0, -1.0, 90.0, 0.0)], RES)
    got = obs.mark_outliers(df).filter("outlier").collect()
    assert [(r.frame, r.w) for r in got] == [(200, -1.0)]


def test_rotating_four_times_changes_nothing(spark):
    df = spark.createDataFrame([(0, 0, i, float(i), 0.0, 1.0, 0.0, 0.0) for i in range(12)], RES)
    turned, nx, ny = df, 4, 3
    for _ in range(4):
        turned = obs.rotate_corners(turned, nx, ny, 1, ["frame", "cam"])
        nx, ny = ny, nx
    assert all(r.idx == r.x for r in turned.collect())
    with pytest.raises(Exception, match="wrong number"):
        obs.rotate_corners(df, 3, 3, 1, ["frame", "cam"]).collect()


def test_random_boards_are_an_exact_number(spark):
    df = spark.createDataFrame([(f, 0, i, 0.0, 0.0, 1.0, 0.0, 0.0) for f in range(20) for i in range(3)], RES)
    got = obs.cull_random_boards(df, 0.25, 1, ["frame", "cam"])
    assert got.filter("w is null").select("frame").distinct().count() == 5 and got.count() == 60


def test_correspondence_is_checked(spark):
    good = spark.createDataFrame([(0, None), (1, 0), (1, 0)], "i int, e int")
    assert sorted(map(tuple, rel.corresponding_extrinsics(good, "i", "e").collect())) == [(0, -1), (1, 0)]
    with pytest.raises(Exception, match="one to one"):
        rel.corresponding_extrinsics(spark.createDataFrame([(0, 0), (0, 1)], "i int, e int"), "i", "e").collect()


def test_traversal_prefers_fewer_hops_then_more_frames(spark):
    edges = spark.createDataFrame([(0, 1, 5), (0, 2, 9), (1, 3, 5), (2, 3, 7), (4, 5, 9), (0, 6, 1)], "a long, b long, shared long")
    got = {r.node: (r.parent, r.hops) for r in rel.traverse_links(edges, 0, 2).collect()}
    assert got == {0: (None, 0), 1: (0, 1), 2: (0, 1), 3: (2, 2)}


def test_procrustes(spark):
    rng = np.random.default_rng(0)
    p1 = rng.standard_normal((40, 3))
    rt = np.array([0.2, -0.4, 0.1, 1.0, 2.0, 3.0])
    p0 = values(pose.transform_point_rt(NUMPY, list(rt), [p1[:, i] for i in range(3)]))
    Rt = alignment.align_procrustes_points_Rt01(p0, p1)
    want = np.array(values(pose.Rt_from_rt(NUMPY, list(rt))))
    assert np.allclose(Rt.ravel(), want)
    assert not alignment.align_procrustes_vectors_R01(np.ones((4, 3)), np.ones((4, 3))).any()
    w = rng.random(40)
    df = spark.createDataFrame([(0, a.tolist(), b.tolist(), float(c)) for a, b, c in zip(p0 + rng.standard_normal((40, 3)) * 0.1, p1, w, strict=True)], "k int, p0 array<double>, p1 array<double>, w double")
    rows = df.collect()
    one = alignment.align_procrustes_points_Rt01(np.array([r.p0 for r in rows]), np.array([r.p1 for r in rows]), w)
    assert np.allclose(alignment.align_groups(df, ["k"], "p0", "p1", "w").first().Rt01, one.ravel(), atol=1e-9)


@pytest.fixture(scope="module")
def solved():
    rng = np.random.default_rng(1)
    cams = [{"lensmodel": "LENSMODEL_OPENCV4", "intrinsics": np.array([1200.0, 1210, 960, 600, -0.1, 0.05, 0.001, -0.001]), "imagersize": [1920, 1200], "rt_cam_ref": np.array(x)} for x in ([0.0] * 6, [0.02, -0.03, 0.01, -0.3, 0.01, 0.02])]
    _, q = synthetic.synthesize_boards(cams, 8, 6, 0.1, 14, np.array([0, 0, 0, 0, 0, 2.0]), np.array([0.5, 0.5, 0.5, 0.4, 0.3, 0.5]))
    q = q + rng.standard_normal(q.shape) * 0.2
    q[3, 0, 1, 2] += 40
    n = len(q) * 2
    o = np.array([(f, c, c - 1) for f in range(len(q)) for c in range(2)])
    seen = np.concatenate([q.reshape(n, 6, 8, 2), np.ones((n, 6, 8, 1))], -1)
    p = solver.seed("LENSMODEL_OPENCV4", np.array([[1920, 1200]] * 2), 1100.0, o, seen, 0.1)
    p, _ = solver.optimize(replace(p, optimize_distortions=False, optimize_core=False, optimize_warp=False), False)
    return *solver.optimize(replace(p, optimize_core=True, optimize_distortions=True, optimize_warp=True)), cams


def test_solver(solved):
    p, s, cams = solved
    assert s["outliers"] == 1 and 0.15 < s["rms"] < 0.21
    assert np.abs(p.intrinsics[:, :2] - [c["intrinsics"][:2] for c in cams]).max() < 8
    assert np.abs(p.rt_cam_ref[0] - cams[1]["rt_cam_ref"]).max() < 0.01
    assert np.allclose(p.ingest(p.pack()).pack(), p.pack())


def test_layout(solved):
    p = solved[0]
    assert p.num_states() == 2 * 8 + 6 + 14 * 6 + 2 and p.state_index_frames(1) == 16 + 6 + 6 and p.state_index_calobject_warp() == p.num_states() - 2
    assert p.num_measurements_boards() == 28 * 48 * 2 and p.measurement_index_boards(2) == 2 * 2 * 48 and p.num_measurements() == p.num_measurements_boards() + 12
    j = p.jacobian_table()
    assert j["row"].max() < p.num_measurements() and j["col"].max() < p.num_states()
    assert len(j) - 2 * p.num_measurements_boards() == p.num_j_nonzero()  # the table holds fy and cy of x, and fx and cx of y, which are 0
    x, _ = p.measure()
    e = 1e-6
    for k in (0, 5, 17, 30):
        b = p.pack()
        b[k] += e
        num = (p.ingest(b).measure(False)[0] - x) / e / p.scales()[k]
        got = np.zeros(len(x))
        sel = j[j["col"] == k]
        got[sel["row"]] = sel["value"]
        assert np.allclose(num, got, rtol=1e-3, atol=1e-2 * max(1, np.abs(got).max()) * 1e-2)


def scene(kind):
    """Two cameras beside one at the reference, free and known points, rays; with a board for good measure."""
    rng = np.random.default_rng(3)
    core = np.array([[600.0, 610, 320, 240, 0.05, -0.02, 0.001, 0.002], [620.0, 600, 310, 250, -0.03, 0.02, 0.001, -0.002]])
    rt = np.array([[0.02, 0.1, -0.01, -0.6, 0.1, 0.05], [-0.05, -0.1, 0.02, 0.5, -0.2, 0.1]])
    poses = np.vstack([rt, np.zeros((1, 6))])
    points = np.stack([rng.uniform(-1.5, 1.5, 10), rng.uniform(-1, 1, 10), rng.uniform(5, 8, 10)], -1)
    T = lambda a, p: values(pose.transform_point_rt(NUMPY, list(a), [p[:, i] for i in range(3)]))
    obs_points = np.array([(p, e % 2, e) for e in (-1, 0, 1) for p in range(10)])
    q = np.array([lens.project(T(poses[e], points[p : p + 1]), "LENSMODEL_OPENCV4", core[c])[0] for p, c, e in obs_points])
    seen_points = np.concatenate([q, np.ones((30, 1))], 1)
    seen_points[4, 2] = -1
    frames = np.array([[0.1, -0.2, 0.05, -0.3, 0.1, 3.0], [0.2, 0.1, -0.1, 0.2, -0.1, 3.5]])
    y, x = np.mgrid[:3, :4].astype(float)
    board = np.stack([x * 0.2, y * 0.2, 0 * x], -1).reshape(-1, 3)
    o = np.array([(f, e % 2, e) for f in (0, 1) for e in (-1, 0, 1)])
    seen = np.array([np.concatenate([lens.project(T(poses[e], T(frames[f], board)), "LENSMODEL_OPENCV4", core[c]), np.ones((12, 1))], 1).reshape(3, 4, 3) for f, c, e in o])
    rays = np.array([T(poses[e], points[p : p + 1])[0] for p in range(5) for e in (-1, 0, 1)])
    obs_rays = np.array([(p, e % 2, e) for p in range(5) for e in (-1, 0, 1)])
    noise = rng.standard_normal(rays.shape) * (0.002 if kind == "noisy" else 0)
    return solver.Problem("LENSMODEL_OPENCV4", np.array([[640, 480]] * 2), core, rt, frames, o, seen, 0.2, points=points, n_fixed=3, obs_points=obs_points, seen_points=seen_points, obs_rays=obs_rays, rays=rays + noise, unity_cam01=True)


def test_points_and_rays_are_measured():
    p = scene("exact")
    assert p.num_states() == 16 + 12 + 12 + 21 + 2 and p.state_index_points(6) == 40 + 18 and p.state_index_points(7) is None
    assert (p.num_measurements_boards(), p.num_measurements_points(), p.num_measurements_points_triangulated(), p.num_measurements_regularization()) == (144, 60, 15, 13)
    assert p.measurement_index_points(2) == 148 and p.measurement_index_points_triangulated(2) == 204 + 6 and p.measurement_index_regularization() == 219
    assert p.decode_triangulated(7) == {"iobservation0": 6, "iobservation1": 8, "iobservation_point0": 6, "Nobservations_this_point": 3, "Nmeasurements_this_point": 3, "ipoint": 2}
    x, _ = p.measure()
    assert np.abs(x[:204]).max() < 1e-9 and np.abs(x[204:219]).max() < 1e-6
    own = 2 + 4
    assert len(p.jacobian_table()) - 2 * 204 + 2 * 15 * own == p.num_j_nonzero()


def test_gradients_of_all_measurements():
    p = scene("noisy")
    rng = np.random.default_rng(0)
    p = p.ingest(p.pack() + rng.standard_normal(p.num_states()) * 1e-3 / p.scales())
    j = p.jacobian_table().pivot_table(index="row", columns="col", values="value", fill_value=0.0, aggfunc="sum").reindex(index=range(p.num_measurements()), columns=range(p.num_states()), fill_value=0.0).to_numpy()
    for k in range(p.num_states()):
        e = np.zeros(p.num_states())
        e[k] = 1e-6 / p.scales()[k]
        num = (p.ingest(p.pack() + e).measure(False)[0] - p.ingest(p.pack() - e).measure(False)[0]) / 2e-6
        assert np.allclose(num, j[:, k], rtol=2e-4, atol=2e-4 * max(1, np.abs(j[:, k]).max())), k
    normal, js = p.normal(), j * p.scales()
    assert np.allclose(normal.dense(), js.T @ js, rtol=1e-9, atol=1e-9) and np.allclose(normal.g, js.T @ normal.x)
    r = rng.standard_normal((p.num_states(), 3))
    damped = js.T @ js
    damped += 1e-3 * np.diag(np.diag(damped))
    assert np.allclose(damped @ normal.factor(1e-3)(r), r, atol=1e-6)
    assert np.allclose(normal.times(r), js.T @ js @ r)
    low = solver.conditioning(p, 3)
    assert [c["eigenvalue"] for c in low] == sorted(c["eigenvalue"] for c in low) and 0 < low[0]["share"] < 1


def test_points_are_found_again():
    truth = scene("exact")
    rng = np.random.default_rng(1)
    start = replace(truth, optimize_core=False, optimize_distortions=False, regularize=False, unity_cam01=False, optimize_warp=False)
    start = start.ingest(start.pack() + rng.standard_normal(start.num_states()) * 0.02 / start.scales())
    assert np.abs(start.points[:7] - truth.points[:7]).max() > 0.01 and (start.points[7:] == truth.points[7:]).all()
    p, s = solver.optimize(start, False)
    assert s["rms"] < 1e-6 and np.allclose(p.points, truth.points, atol=1e-5) and np.allclose(p.rt_cam_ref, truth.rt_cam_ref, atol=1e-6)


def test_outliers_among_rays():
    p = scene("noisy")
    p = replace(p, rays=p.rays + 0, seen=p.seen.copy())
    p.rays[4] += [0, 0.5, 0]
    marked, found = solver.mark_outliers(p, p.measure(False)[0])
    assert found >= 2 and marked.rays_out[4] and not p.rays_out.any()
    n = p.num_measurements_boards() + p.num_measurements_points()
    gone = (marked.rays_out[p.pairs()]).any(1)
    assert (marked.measure(False)[0][n : n + 15][gone] == 0).all()


@pytest.mark.parametrize("nx, ny", [(5, 4), (5, 5)])
def test_splines_are_held_back_across_more_than_along(nx, ny):
    name = f"LENSMODEL_SPLINED_STEREOGRAPHIC_order=3_Nx={nx}_Ny={ny}_fov_x_deg=90"
    rng = np.random.default_rng(0)
    du = rng.standard_normal((ny, nx, 2))
    p = solver.Problem(name, np.array([[640, 480]]), np.concatenate([[500.0, 500, 319.5, 239.5], du.ravel()])[None], np.zeros((0, 6)), np.zeros((0, 6)), np.zeros((0, 3), int), np.zeros((0, 1, 1, 3)), 0.1, optimize_core=False)
    x, rows = p._regularization()
    assert len(x) == 2 * nx * ny == p.num_measurements_regularization() and all(len(r) == 2 for r in rows)
    for n, (along, across) in enumerate(x.reshape(-1, 2)):
        v = du.reshape(-1, 2)[n]
        away = np.array([n % nx - (nx - 1) / 2, n // nx - (ny - 1) / 2])
        if not away.any():
            assert np.allclose([along, across], [0.01 * v[0], -0.01 * v[1]])
            continue
        away /= np.linalg.norm(away)
        assert np.isclose(along, 0.01 * v @ away) and np.isclose(abs(across), 0.1 * abs(away[0] * v[1] - away[1] * v[0]))


def test_propagation_equals_the_dense_formula(solved):
    p = solved[0]
    J = np.random.default_rng(0).standard_normal((5, 2, p.num_states()))
    M = np.linalg.inv(p.normal().dense())
    want = J @ (M @ p.normal(observations_only=True).dense() @ M) @ np.swapaxes(J, -1, -2) * 0.09
    assert np.allclose(uncertainty.propagated(p, J, 0.3), want, rtol=1e-5)


def test_uncertainty_against_sampling(solved):
    """The predicted deviation of a pixel against that of re-solved noisy problems, for one camera's own intrinsics and pose."""
    p, _, _ = solved
    exact = replace(p, regularize=False)
    x = exact.measure(False)[0].reshape(*p.seen.shape[:3], 2)
    clean = p.seen.copy()
    clean[..., :2] += x
    clean[..., 2] = 1
    rng, at, got = np.random.default_rng(0), np.array([0.1, 0.1, 2.5]), []
    base = replace(exact, seen=clean)
    for _ in range(25):
        seen = clean.copy()
        seen[..., :2] += rng.standard_normal(seen.shape[:3] + (2,)) * 0.3
        s, _ = solver.optimize(replace(base, seen=seen), False)
        rt = []
        for a, b in zip(s.rt_ref_frame, base.rt_ref_frame, strict=True):
            local = values(pose.transform_point_rt_inverted(NUMPY, list(b), list(at)))
            rt.append(values(pose.transform_point_rt(NUMPY, list(a), list(local))))
        got.append(lens.project(np.mean(rt, 0), s.lensmodel, s.intrinsics[0]))
    want = uncertainty.projection_uncertainty(at[None], base, 0, "mean-pcam", sigma=0.3)[0]
    have = float(uncertainty.worst_direction_stdev(np.cov(np.array(got).T)))
    assert 0.6 < want / have < 1.6
    cross = uncertainty.projection_uncertainty(at[None], base, 0, "cross-reprojection", sigma=0.3)[0]
    assert 0 < cross < 4 * want


def test_noise_of_a_solve_in_triangulated_points(solved):
    p = solved[0]
    at = np.array([[0.2, 0.1, 2.5], [-0.3, 0.2, 4.0]])
    second = values(pose.transform_point_rt(NUMPY, list(p.rt_cam_ref[0]), [at[:, k] for k in range(3)]))
    q = np.stack([lens.project(at, p.lensmodel, p.intrinsics[0]), lens.project(second, p.lensmodel, p.intrinsics[1])], 1)

    def point(x):
        cams = [(x.lensmodel, x.intrinsics[c], rt) for c, rt in enumerate((np.zeros(6), x.rt_cam_ref[0]))]
        return uncertainty.triangulate(q, cams)

    points, by_solve, by_pixels = uncertainty.triangulate_solved(q, p, (0, 1), q_observation_stdev=0.5, sigma=0.3)
    assert np.allclose(points, at, atol=1e-6)
    J = np.zeros((2, 3, p.num_states()))
    for k in range(p.num_states()):
        e = np.zeros(p.num_states())
        e[k] = 1e-6
        J[:, :, k] = (point(p.ingest(p.pack() + e)) - point(p.ingest(p.pack() - e))) / 2e-6
    assert np.allclose(by_solve, uncertainty.propagated(p, J, 0.3), rtol=1e-3, atol=1e-12)
    cams = [(p.lensmodel, p.intrinsics[c], rt) for c, rt in enumerate((np.zeros(6), p.rt_cam_ref[0]))]
    assert np.allclose(by_pixels, uncertainty.triangulate(q, cams, q_observation_stdev=0.5)[1], rtol=1e-6)


def test_differences_and_refits():
    i = np.array([1200.0, 1210, 960, 600, -0.1, 0.05, 0.001, -0.001])
    d, _ = uncertainty.projection_diff([("LENSMODEL_OPENCV4", i)] * 2, (1920, 1200), nx=24)
    assert np.abs(d).max() < 1e-4
    b, rms = uncertainty.convert_lensmodel("LENSMODEL_OPENCV4", i, (1920, 1200), "LENSMODEL_OPENCV8", nx=10, trials=1)
    assert rms < 1e-6 and len(b) == 12
    with pytest.raises(ValueError):
        alignment.implied_rt10(np.zeros((2, 3)), np.zeros((2, 3)), np.zeros((2, 2)), None)


def test_rectified_stereo(spark):
    m = [{"lensmodel": "LENSMODEL_OPENCV4", "intrinsics": [1200.0, 1210, 960, 600, -0.1, 0.05, 0.001, -0.001], "imagersize": [1920, 1200], "rt_cam_ref": np.array(x)} for x in ([0.0] * 6, [0.02, -0.03, 0.01, -0.3, 0.01, 0.02])]
    for kind in ("LENSMODEL_LATLON", "LENSMODEL_PINHOLE"):
        r = stereo.rectified_system(m, 40, 30, rectification=kind, pixels_per_deg_az=-0.25, pixels_per_deg_el=-0.25)
        assert abs(stereo.validate_rectified(r) - np.linalg.norm(pose_t(m))) < 1e-9
        p = np.array([[0.3, 0.2, 4.0]])  # in the reference
        q = [lens.project(values(pose.transform_point_rt(NUMPY, list(x["rt_cam_ref"]), [p[:, i] for i in range(3)])), kind, x["intrinsics"]) for x in r]
        assert abs(q[0][0, 1] - q[1][0, 1]) < 1e-6 and q[0][0, 0] > q[1][0, 0]
        a = stereo.rectification_maps(m, r)[0]
        t = stereo.rectification_table(spark, m, r)
        row = t.filter("y = 3 and x = 5").first()
        assert np.allclose([row.x0, row.y0], a[3, 5], atol=1e-2) and t.count() == a.shape[0] * a.shape[1]


def pose_t(m):
    return values(pose.compose_rt(NUMPY, list(m[0]["rt_cam_ref"]), pose.invert_rt(NUMPY, list(m[1]["rt_cam_ref"]))))[3:]


def test_feature_matching():
    rng = np.random.default_rng(0)
    a = rng.random((80, 90))
    b = np.zeros((80, 90))
    b[3:, 5:] = a[:-3, :-5]
    q, _ = stereo.match_feature(a, b, np.array([40, 40]), 8, (11, 11))
    assert np.abs(q - [45, 43]).max() < 0.5


MODEL = {"lensmodel": "LENSMODEL_OPENCV4", "intrinsics": [1200.0, 1210.0, 960.0, 600.0, -0.1, 0.05, 0.001, -0.001], "imagersize": [1920, 1200], "rt_cam_ref": [0.1, 0.2, -0.3, 1.0, 2.0, 3.0], "icam_intrinsics": None, "icam_extrinsics": None, "optimization_inputs": None, "valid_intrinsics_region": [[0.0, 0.0], [100.0, 0.0], [100.0, 100.0], [0.0, 0.0]]}


def test_model_files(spark, tmp_path):
    assert models.parse_native(models.format_native(MODEL, "a note")) == MODEL
    old = "{'distortion_model': 'DISTORTION_OPENCV4', 'extrinsics': [0,0,0,0,0,0], 'intrinsics': [1,1,1,1,0,0,0,0], 'imagersize': [2,2]}"
    assert models.parse_native(old)["lensmodel"] == "LENSMODEL_OPENCV4"
    with pytest.raises(ValueError):
        models.parse_native(old.replace("[1,1,1,1,0,0,0,0]", "[1,1]"))
    df = spark.createDataFrame([{**MODEL, "path": "p", "name": "cam0"}], models.SCHEMA)
    folder = f"file://{tmp_path}/m"
    assert models.write(df, folder).count() == 1
    back = models.read(spark, folder).first()
    assert back.lensmodel == MODEL["lensmodel"] and np.allclose(back.intrinsics, MODEL["intrinsics"]) and back.valid_intrinsics_region == MODEL["valid_intrinsics_region"]
    with pytest.raises(Exception, match="FileExists"):
        models.write(df, folder).count()
    assert models.write(df, folder, overwrite=True).count() == 1


@pytest.mark.parametrize("name,extra", [("LENSMODEL_PINHOLE", []), ("LENSMODEL_CAHVOR", [0.01, -0.02, 0.03, 0.04, 0.05]), ("LENSMODEL_CAHVORE_linearity=0.37", [0.01, -0.02, 0.03, 0.04, 0.05, 0.1, 0.2, 0.3])])
def test_cahvor_files(name, extra):
    m = {**MODEL, "lensmodel": name, "intrinsics": [*MODEL["intrinsics"][:4], *extra]}
    back = models.parse_cahvor(models.format_cahvor(m))
    assert back["lensmodel"] == name and np.allclose(back["intrinsics"], m["intrinsics"], atol=1e-6) and np.allclose(back["rt_cam_ref"], m["rt_cam_ref"], atol=1e-8)


def test_yaml_files():
    two = [{**MODEL, "rt_cam_ref": [0.0] * 6}, MODEL]
    back = models.parse_kalibr(models.format_kalibr(two))
    assert np.allclose(back["cam1"]["rt_cam_ref"], MODEL["rt_cam_ref"]) and back["cam0"]["intrinsics"] == MODEL["intrinsics"]
    ros = "image_width: 640\nimage_height: 480\ncamera_matrix:\n  rows: 3\n  data: [500, 0, 320,\n    0, 501, 240, 0, 0, 1]\ndistortion_coefficients:\n  data: [0.1, 0.2, 0, 0, 0.3]\n"
    m = models.parse_ros(ros)
    assert m["lensmodel"] == "LENSMODEL_OPENCV5" and m["intrinsics"] == [500, 501, 320, 240, 0.1, 0.2, 0, 0, 0.3]


def test_transforms():
    got = models.parse_transforms("# c\nins2veh = (1 2 3) (1 0 0 0)\n cam2ins[3] = (4 5 6)(0.6 0 0 0.8)\n")
    assert np.allclose(got["veh_from_ins"], [[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 2, 3]])
    assert np.allclose(got["ins_from_camera"][3], [[-0.28, -0.96, 0], [0.96, -0.28, 0], [0, 0, 1], [4, 5, 6]])
    for bad in ("cam2ins[3] = (4 5 6) (1 0 0 0)", "ins2veh = (1 2 3) (1 0 0 0)\nins2veh = (1 2 3) (1 0 0 0)", "ins2veh = 1 2 3", "veh = (1 2 3) (1 0 0 0)"):
        with pytest.raises(ValueError):
            models.parse_transforms(bad)


def test_cahvor_axes():
    """V that leans towards H does not make a rotation that is none; a missing size is an error."""
    text = "Dimensions = 640 480\nC = 1 2 3\nA = 0 0 2\nH = 500 0 320\nV = 20 510 240\n"
    m = models.parse_cahvor(text)
    R = np.array(values(pose.R_from_r(NUMPY, [np.float64(x) for x in m["rt_cam_ref"][:3]]))).reshape(3, 3)
    assert np.allclose(R, np.eye(3)) and m["intrinsics"][:1] == [500.0] and m["intrinsics"][2:] == [320.0, 240.0]
    with pytest.raises(ValueError, match="Dimensions"):
        models.parse_cahvor(text.split("\n", 1)[1])


def test_stored_solves(solved):
    p = solved[0]
    inputs = models.inputs_of(p)
    m = models.CameraModel(lensmodel=p.lensmodel, intrinsics=p.intrinsics[1].tolist(), imagersize=[1920, 1200], rt_cam_ref=p.rt_cam_ref[0].tolist(), icam_intrinsics=1, icam_extrinsics=0, optimization_inputs=inputs)
    again = models.CameraModel.parse(str(m))
    assert again.same_solve(m) and again.icam_extrinsics == 0 and not again.moved_since_solve()
    q = models.problem_of(again.optimization_inputs)
    assert np.allclose(q.measure(False)[0], p.measure(False)[0]) and q.num_states() == p.num_states()
    assert models.unpack_inputs(models.pack_inputs({"a": None, "b": "x", "c": True, "rt_cam_ref": None}))["rt_cam_ref"].shape == (0, 6)
    again.rt_ref_cam = again.rt_ref_cam + 0.1
    assert again.moved_since_solve() and again.optimization_inputs is not None
    again.set_intrinsics("LENSMODEL_PINHOLE", [1, 2, 3, 4])
    assert again.optimization_inputs is None and not again.same_solve(m) and again.valid_intrinsics_region is None
    with pytest.raises(ValueError):
        models.CameraModel.parse(str(models.CameraModel(**MODEL)).replace("}", "    'icam_intrinsics': 1,\n}"))


def test_poses_of_a_model():
    m = models.CameraModel(**MODEL)
    for name in ("rt_ref_cam", "Rt_cam_ref", "Rt_ref_cam", "extrinsics_rt_fromref", "extrinsics_Rt_toref"):
        was, n = m.rt_cam_ref, models.CameraModel(**{**MODEL, "rt_cam_ref": [0.0] * 6})
        setattr(n, name, getattr(m, name))
        assert np.allclose(n.rt_cam_ref, was), name
    assert np.allclose(m.Rt_ref_cam[:3] @ m.Rt_cam_ref[:3], np.eye(3))


def test_images_and_clouds(spark, tmp_path):
    rng = np.random.default_rng(0)
    for end, a in (("pgm", rng.integers(0, 255, (5, 7)).astype("u1")), ("ppm", rng.integers(0, 255, (5, 7, 3)).astype("u1")), ("png", rng.integers(0, 60_000, (5, 7)).astype("u2")), ("png", rng.integers(0, 255, (5, 7, 3)).astype("u1"))):
        assert (tables.decode_image(tables.encode_image(a, end)) == a).all()
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "a.pgm").write_bytes(tables.encode_image(np.arange(12, dtype="u1").reshape(3, 4), "pgm"))
    row = tables.read_images(spark, str(tmp_path / "i")).first()
    assert (tables.image_array(row) == np.arange(12).reshape(3, 4)).all()
    m = np.stack(np.meshgrid(np.arange(4.0), np.arange(3.0)), -1) + [0.5, 0]
    assert tables.transform_image(np.arange(12.0).reshape(3, 4), m)[0].tolist() == [0.5, 1.5, 2.5, 0.0]
    points = spark.createDataFrame([(1.0, 2.0, 3.0, 9)], "x double, y double, z double, gray int")
    path = tables.write_ply(points.coalesce(1), f"file://{tmp_path}/p").first().path
    assert open(path, "rb").read().endswith(np.array([1, 2, 3], "<f4").tobytes() + bytes([9, 9, 9]))


def test_streams(spark, tmp_path):
    rows = [(i, 0, 0, 100.0 * i, 5.0, 1.0, 0.0, 0.0) for i in range(10)]
    spark.createDataFrame(rows, RES).write.parquet(f"{tmp_path}/in")
    stream = culling.cull(culling.corner_stream(spark, f"{tmp_path}/in", RES), left_of=400.0)
    q = stream.writeStream.format("memory").queryName("culled").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(60)
    assert spark.table("culled").filter("w is null").count() == 5
    events = spark.range(10).select(F.col("id").cast("double").alias("value"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.lit(1).alias("k"))
    got = culling.windowed(events, "ts", "value").orderBy("start").collect()
    assert [r.n for r in got] == [6, 4] and got[0].mean == 2.5 and math.isclose(got[0].stdev, np.std(range(6)))
    assert culling.sessions(events, "ts", "k").first().n == 10


def test_boards_of_a_wrong_size(spark):
    rows = [(f, 0, i, 1.0, 1.0, 1.0) for f, n in ((1, 4), (2, 3), (3, 4), (4, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "frame int, cam int, idx int, x double, y double, w double")
    assert sorted((r.iframe, r.frame) for r in obs.boards(df, 2, 2, 2).collect()) == [(0, 1), (1, 3)]
    with pytest.raises(Exception, match="wrong number"):
        obs.boards(df, 2, 2, 2, on_wrong_size="raise").collect()
    assert obs.boards(df.filter("frame <> 2"), 2, 2, 2, on_wrong_size="raise").count() == 2


@pytest.mark.parametrize("which, both", [("all-cameras-must-see-full-board", True), ("some-cameras-must-see-half-board", False)])
def test_boards_made_on_the_cluster(spark, which, both):
    cams = [{"lensmodel": "LENSMODEL_CAHVORE_linearity=0.37" if c else "LENSMODEL_PINHOLE", "intrinsics": [600.0, 610, 320, 240] + [0.0, 0.0, 0.01, 0.0, 0.0, 0.001, 0.0, 0.0] * c, "imagersize": [640, 480], "rt_cam_ref": [0.0, 0.0, 0.0, -0.4 * c, 0.0, 0.0]} for c in (0, 1)]
    args = (spark, cams, 4, 3, 0.1, 12, [0, 0, 0, 0, 0, 1.5], [0.4, 0.4, 0.4, 0.6, 0.4, 0.2], which, 7)
    rows = synthetic.board_views(*args).toPandas()
    assert sorted(rows["frame"].unique()) == list(range(12)) and len(rows) == 12 * 2 * 12
    inside = rows.assign(ok=rows["x"].between(0, 639) & rows["y"].between(0, 479)).groupby(["frame", "cam"])["ok"].sum().unstack()
    assert (inside == 12).all().all() if both else (inside.max(1) >= 7).all()
    again = synthetic.board_views(*args).toPandas()
    key = ["frame", "cam", "idx"]
    assert np.allclose(rows.sort_values(key)[["x", "y"]], again.sort_values(key)[["x", "y"]], equal_nan=True)
    with pytest.raises(ValueError, match="too few"):
        synthetic.board_views(*args[:6], [0, 0, 0, 50, 0, 1.5], *args[7:], most=64)


def test_tracks_of_a_turning_camera(spark):
    model = {"lensmodel": "LENSMODEL_OPENCV4", "intrinsics": [500.0, 500.0, 319.5, 239.5, -0.02, 0.01, 0.0, 0.0], "imagersize": (640, 480)}
    rows = synthetic.make_tracks(spark, model, 20, [0.1, 0.2, 0.0, 0.0, 0.0, -50.0], [0.0, 0.02, 0.01], [1.0, 0.5, 0.0], 150, 10, 4, 4, 8).toPandas()
    assert len(rows) > 500 and rows.groupby("point").size().min() >= 4 and rows.groupby("pose").size().min() >= 8
    for r in rows.sample(40, random_state=0).itertuples():
        turn = values(pose.compose_r(NUMPY, [np.float64(v) for v in (0.1, 0.2, 0.0)], [np.float64(r.pose * v) for v in (0.0, 0.02, 0.01)]))
        rt = [*turn, r.pose * 1.0, r.pose * 0.5, -50.0]
        p = values(pose.transform_point_rt_inverted(NUMPY, [np.float64(v) for v in rt], [np.float64(v) for v in (r.px, r.py, r.pz)]))
        assert r.pz == 0 and np.allclose(lens.project(p, model["lensmodel"], np.array(model["intrinsics"])), [r.x, r.y], atol=1e-6)


def test_features_at_the_border():
    a = np.random.default_rng(2).uniform(0, 255, (40, 50))
    q, d = stereo.match_feature(a, a, np.array([8.0, 9.0]), 5, (9, 9))
    assert np.allclose(q, [8, 9], atol=0.3) and abs(d["best"] - 1) < 1e-9
    y, x = np.unravel_index(np.nanargmax(d["scores"]), d["scores"].shape)
    assert (x, y) == (5, 5) and np.isinf(d["scores"][0, 0]) and np.isfinite(d["scores"][5, 5])
    assert stereo.match_feature(a, a[:6, :6], np.array([3.0, 3.0]), 2, (9, 9))[0] is None
