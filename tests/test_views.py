"""Tables behind plots."""

import numpy as np
import pandas as pd

from plumbline.functions import pose
from plumbline.functions.scalars import on_arrays
from plumbline.operators import views


def test_geometry(spark):
    cams = spark.createDataFrame([(0, [0.0, 0.0, 0.0, 1.0, 2.0, 3.0])], "cam int, rt_cam_ref array<double>")
    rows = {r.axis: r for r in views.camera_axes(cams).collect()}
    assert (rows["x"].x0, rows["x"].y0, rows["x"].z0) == (-1, -2, -3) and rows["x"].x1 == 0 and rows["z"].z1 == -2
    frames = spark.createDataFrame([(0, [0.0] * 6)], "frame int, rt_ref_frame array<double>")
    assert [r.x for r in views.board_outlines(frames, 3, 2, 0.1).orderBy("k").collect()] == [0, 0.2, 0.2, 0, 0]


def test_distortion_and_corrections(spark):
    i = np.array([1000.0, 1000, 500, 400])
    assert views.distortion_off_pinhole(spark, "LENSMODEL_PINHOLE", i, (1000, 800), 5).filter("abs(dx) + abs(dy) > 1e-9").count() == 0
    assert np.allclose(views.radial_distortion("LENSMODEL_PINHOLE", i, np.array([10.0, 30])), [10, 30])
    m = "LENSMODEL_SPLINED_STEREOGRAPHIC_order=3_Nx=8_Ny=6_fov_x_deg=90"
    s = np.concatenate([i, np.full(96, 0.01)])
    got = views.splined_correction(spark, m, s, 4).toPandas()
    assert np.allclose(got[["dux", "duy"]], 0.01)
    assert views.resolution(spark, "LENSMODEL_PINHOLE", i, (1000, 800), 4).count() == 12


def test_region_of_the_largest_part():
    cells = pd.DataFrame([{"ix": x, "iy": y, "mean": 0.0, "stdev": 1.0 if (x, y) in ((0, 0), (2, 1), (2, 2), (3, 1), (3, 2)) else 9.0, "count": 100} for x in range(5) for y in range(4)])
    r = views.valid_intrinsics_region(cells, (401, 301), 5, 4, 1.0, 2.0, 10)
    assert np.allclose(r[0], r[-1]) and np.allclose([r.min(0), r.max(0)], [[150, 50], [350, 250]])
    assert len(views.valid_intrinsics_region(cells, (401, 301), 5, 4, 1.0, 0.5, 10)) == 0


def test_small_poses():
    rt = np.array([0.3, -0.2, 0.5, 1.0, 2.0, 3.0])
    for f, left in ((views.compose_rt_tiny0, True), (views.compose_rt_tiny1, False)):
        g = f(rt)
        for k in range(6):
            e = np.eye(6)[k] * 1e-6
            up, down = (on_arrays(pose.compose_rt)(*((s * e, rt) if left else (rt, s * e))) for s in (1, -1))
            assert np.allclose((up - down) / 2e-6, g[:, k], atol=1e-6)
    r = rt[:3]
    assert np.allclose(views.compose_r_tiny1(r), views.compose_rt_tiny1(rt)[:3, :3]) and np.allclose(views.compose_r_tiny0(r), views.compose_rt_tiny0(rt)[:3, :3])
