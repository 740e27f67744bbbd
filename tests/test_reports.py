"""From corners to models, from models to their reports, and the command-line jobs between files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.__main__ import main
from plumbline.functions import lens, pose
from plumbline.functions.scalars import NUMPY, values
from plumbline.operators import grids, layout, reports, solver, stereo
from plumbline.operators.synthetic import synthesize_boards
from plumbline.sources import models, tables

CAMERAS = [{"lensmodel": "LENSMODEL_OPENCV4", "intrinsics": np.array([1200.0, 1210, 960, 600, -0.1, 0.05, 0.001, -0.001]), "imagersize": [1920, 1200], "rt_cam_ref": np.array(x)} for x in ([0.0] * 6, [0.02, -0.03, 0.01, -0.3, 0.01, 0.02])]
SETUP = dict(lensmodel="LENSMODEL_OPENCV4", imagersize=(1920, 1200), focal=1100.0, width_n=8, height_n=6, spacing=0.1)


@pytest.fixture(scope="module")
def corners():
    _, q = synthesize_boards(CAMERAS, 8, 6, 0.1, 14, np.array([0, 0, 0, 0, 0, 2.0]), np.array([0.5, 0.5, 0.5, 0.4, 0.3, 0.5]))
    q = q + np.random.default_rng(1).standard_normal(q.shape) * 0.2
    return [(0, f, c, y * 8 + x, float(q[f, c, y, x, 0]), float(q[f, c, y, x, 1]), 1.0) for f, c, y, x in np.ndindex(q.shape[:4])]


@pytest.fixture(scope="module")
def solved(spark, corners):
    rows = spark.createDataFrame(corners, "problem int, frame int, cam int, idx int, x double, y double, w double")
    return reports.calibrate_models(rows, **SETUP, names=["left", "right"]).orderBy("icam_intrinsics").collect()


def model_of(row):
    return models.CameraModel(**{k: v for k, v in row.asDict().items() if k not in ("problem", "rms", "outliers", "path", "name")})


def test_corners_to_models(spark, solved):
    assert [r.name for r in solved] == ["left", "right"] and all(0.15 < r.rms < 0.21 for r in solved)
    m = model_of(solved[1])
    assert abs(m.intrinsics[1][0] - 1200) < 8 and np.abs(m.rt_cam_ref - CAMERAS[1]["rt_cam_ref"]).max() < 0.01
    r = m.valid_intrinsics_region
    assert np.allclose(r[0], r[-1]) and r.min() >= 0 and r[:, 0].max() <= 1919 and len(r) > 4
    again = models.CameraModel.parse(str(m))
    assert not again.moved_since_solve() and again.same_solve(model_of(solved[0]))


def test_reports_of_a_model(spark, solved):
    m = model_of(solved[1])
    found = reports.residual_reports(spark, m)
    r = found["report"].first()
    assert r.measurements == 14 * 2 * 48 * 2 and abs(r.rms - solved[1].rms) < 0.01
    assert found["worst"].count() == 28 and found["regional"].count() == 20 * 12
    assert found["histogram"].agg(F.sum("count")).first()[0] == 14 * 48 * 2
    g = reports.geometry(spark, m)
    assert (g["cameras"].count(), g["boards"].count(), g["points"].count()) == (6, 70, 0)
    u = reports.uncertainty(spark, m, 6).collect()
    assert len(u) == 6 * 4 and all(0 < x.stdev < 20 for x in u)
    again = reports.resolved(m)
    assert np.allclose(again.intrinsics[1], m.intrinsics[1], atol=1e-3)


def test_another_lens_model_by_the_solve(solved):
    m = model_of(solved[1])
    c = reports.converted(m, "LENSMODEL_OPENCV8")
    q = np.array([[300.0, 200], [960, 600], [1500, 900]])
    was, now = (lens.unproject(q, *x.intrinsics, normalize=True) for x in (m, c))
    assert np.degrees(np.arccos(np.clip((was * now).sum(1), -1, 1))).max() < 0.1
    assert c.intrinsics[0] == "LENSMODEL_OPENCV8" and not c.moved_since_solve() and not c.same_solve(m)


def test_layout_of_problems_equals_the_solver(spark):
    shapes = [(3, 2, 5, 4, 1, 4), (1, 0, 3, 0, 0, 2)]
    rows, problems = [], []
    for k, (cams, poses, frames, points, fixed, boards) in enumerate(shapes):
        obs = np.array([(i % frames, i % cams, i % (poses + 1) - 1) for i in range(boards)]).reshape(-1, 3)
        p = solver.Problem("LENSMODEL_OPENCV8", np.array([[640, 480]] * cams), np.ones((cams, 12)), np.ones((poses, 6)), np.ones((frames, 6)), obs, np.ones((boards, 3, 4, 3)), 0.1, points=np.ones((points, 3)), n_fixed=fixed, obs_points=np.array([(0, 0, -1)] * 2 * bool(points)).reshape(-1, 3).astype(int), seen_points=np.ones((2 * bool(points), 3)), obs_rays=np.array([(s, 0, -1) for s in (0, 0, 0, 1, 1)]), rays=np.ones((5, 3)), unity_cam01=True)
        problems.append(p)
        rows.append((k, cams, 12, poses, frames, points, fixed, boards, 4, 3, len(p.obs_points), 4, True, True, True, True, True, True, True))
    df = spark.createDataFrame(rows, "k int, cameras int, n_intrinsics int, poses int, frames int, points int, fixed int, boards int, width_n int, height_n int, point_views int, pair_count int, core boolean, distortions boolean, extrinsics boolean, frames_too boolean, warp boolean, regularize boolean, unity boolean")
    s = layout.with_states(df, frames=F.lit(1), points=F.lit(2)).orderBy("k").collect()
    m = layout.with_measurements(df, boards=F.lit(1), points=F.lit(1), triangulated=F.lit(3)).orderBy("k").collect()
    for p, a, b in zip(problems, s, m, strict=True):
        assert a.num_states == p.num_states() and a.num_state_points == p.num_states_points()
        assert a.state_index_frames == p.state_index_frames(1) and a.state_index_points == p.state_index_points(2) and a.state_index_warp == p.state_index_calobject_warp()
        assert b.num_measurements == p.num_measurements() and b.measurement_index_boards == p.measurement_index_boards(1) and b.measurement_index_points == p.measurement_index_points(1)
        assert b.measurement_index_triangulated == p.measurement_index_points_triangulated(1) and b.measurement_index_regularization == p.measurement_index_regularization()


def test_images_of_another_camera(spark, tmp_path):
    a = {"lensmodel": "LENSMODEL_PINHOLE", "intrinsics": [100.0, 100, 19.5, 14.5], "imagersize": (40, 30), "rt_cam_ref": [0.0] * 6}
    wide = {**a, "intrinsics": [50.0, 50, 19.5, 14.5]}
    image = np.arange(1200, dtype=np.uint16).reshape(30, 40) * 10
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.png").write_bytes(tables.encode_image(image, "png"))
    out = reports.mapped_images(tables.read_images(spark, str(tmp_path / "in")), a, wide)
    got = tables.image_array(out.first())
    assert got.shape == (30, 40) and got[0, 0] == 0
    assert np.allclose(got[10, 15], tables.transform_image(image.astype(float), np.array([[[10.5, 5.5]]]))[0, 0], atol=1)
    path = tables.write_images(out, f"file://{tmp_path}/out").first().path
    assert (tables.decode_image(open(path, "rb").read()) == got).all()


def test_ranges_of_disparities(spark):
    pair = [{**c, "intrinsics": c["intrinsics"].tolist()} for c in CAMERAS]
    flat = stereo.rectified_system(pair, 40, 30, pixels_per_deg_az=10.0, pixels_per_deg_el=10.0)
    p = np.array([[0.2, 0.1, 4.0], [-0.5, 0.3, 9.0]])
    q = [lens.project(values(pose.transform_point_rt(NUMPY, list(m["rt_cam_ref"]), [p[:, i] for i in range(3)])), m["lensmodel"], np.asarray(m["intrinsics"], float)) for m in flat]
    rows = spark.createDataFrame([(k, float(a[0]), float(a[1]), float(a[0] - b[0])) for k, (a, b) in enumerate(zip(*q, strict=True))], "k int, x double, y double, disparity double")
    for r in reports.ranges(rows, flat).collect():
        own = values(pose.transform_point_rt(NUMPY, list(flat[0]["rt_cam_ref"]), list(p[r.k])))
        assert np.allclose([r.px, r.py, r.pz], own, atol=1e-6) and abs(r.range - np.linalg.norm(own)) < 1e-6


def test_jobs(spark, solved, corners, tmp_path):
    folder = f"file://{tmp_path}/models"
    df = spark.createDataFrame([r.asDict() for r in solved], "problem int, rms double, outliers long, " + models.SCHEMA)
    models.write(df.drop("problem", "rms", "outliers"), folder).count()
    left, right = f"{tmp_path}/models/left.cameramodel", f"{tmp_path}/models/right.cameramodel"
    (tmp_path / "q.txt").write_text("# x y\n960 600\n100 200\n")
    main(["reproject-points", f"{tmp_path}/q.txt", left, right, f"{tmp_path}/moved"])
    a, b = (models.CameraModel.parse(open(x).read()) for x in (left, right))
    got = spark.read.parquet(f"{tmp_path}/moved").orderBy("x").collect()
    want = grids.reprojection(a.fields, b.fields)(np.array([[100.0, 200], [960, 600]]))
    assert np.allclose([(r.x1, r.y1) for r in got], want)
    main(["within-region", f"{tmp_path}/q.txt", left, f"{tmp_path}/within"])
    assert {r.x: r.within for r in spark.read.parquet(f"{tmp_path}/within").collect()}[960] is True
    (tmp_path / "pairs.txt").write_text("960 600 %r %r\n" % tuple(float(v) for v in grids.reprojection(a.fields, b.fields, distance=3.0)(np.array([[960.0, 600]]))[0]))
    main(["triangulate", f"{tmp_path}/pairs.txt", left, right, f"{tmp_path}/points", "--sigma", "0.3"])
    r = spark.read.parquet(f"{tmp_path}/points").first()
    assert abs(np.linalg.norm([r.px, r.py, r.pz]) - 3) < 1e-6 and r.zz > r.xx > 0
    main(["show", "residuals", left, f"{tmp_path}/shown", "--gridn", "10"])
    assert spark.read.parquet(f"{tmp_path}/shown/regional").count() == 60
    main(["difference", left, right, "--target", f"{tmp_path}/diff", "--gridn", "12", "--intrinsics-only"])
    assert spark.read.parquet(f"{tmp_path}/diff").count() == 12 * 8
    lines = [f"frame{f:03d}-cam{c}.png {x!r} {y!r} 0" for _, f, c, _, x, y, _ in sorted(corners)]
    (tmp_path / "corners.vnl").write_text("# filename x y level\n" + "\n".join(lines) + "\n")
    main(["calibrate-cameras", f"{tmp_path}/corners.vnl", f"file://{tmp_path}/found", "*-cam0.png", "*-cam1.png", "--lensmodel", "LENSMODEL_OPENCV4", "--focal", "1100", "--imagersize", "1920", "1200", "--object-width-height", "8", "6", "--object-spacing", "0.1"])
    again = models.CameraModel.parse(open(f"{tmp_path}/found/camera-1.cameramodel").read())
    assert np.allclose(again.intrinsics[1], b.intrinsics[1], atol=1e-3)
    main(["rotate-corners", f"{tmp_path}/corners.vnl", f"{tmp_path}/turned", "8", "6", "--turns", "2"])
    assert spark.read.parquet(f"{tmp_path}/turned").filter("line = 1 and idx = 47").count() == 1
