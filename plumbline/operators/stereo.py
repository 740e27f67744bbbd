"""Rectified stereo systems, image reprojection maps, and matching of features, one camera pair at a time."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import lens, pose
from plumbline.functions.scalars import NUMPY, values


def _parts(a: np.ndarray) -> list:
    return [a[..., i] for i in range(a.shape[-1])]


def _R(rt) -> np.ndarray:
    return np.array(values(pose.R_from_r(NUMPY, [np.float64(x) for x in rt[:3]]))).reshape(3, 3)


def rectified_resolution(model: dict, R_cam_rect: np.ndarray, az0_deg: float, el0_deg: float, rectification: str = "LENSMODEL_LATLON") -> tuple[float, float]:
    """Pixels a degree of azimuth and elevation at the centre of view, from the camera's own resolution there."""
    az, el = math.radians(az0_deg), math.radians(el0_deg)
    v = np.array([math.sin(az), math.cos(az) * math.sin(el), math.cos(az) * math.cos(el)])
    d_az = np.array([math.cos(az), -math.sin(az) * math.sin(el), -math.sin(az) * math.cos(el)])
    d_el = np.array([0, math.cos(az) * math.cos(el), -math.cos(az) * math.sin(el)])
    _, dq, _ = lens.project_with_gradients(R_cam_rect @ v, model["lensmodel"], np.asarray(model["intrinsics"]))
    out = []
    for d in (d_az, d_el):
        out.append(float(np.linalg.norm(dq @ R_cam_rect @ d)) * math.pi / 180)
    if rectification == "LENSMODEL_PINHOLE":  # pixels a degree at the centre of a flat imager
        out = [out[0] * math.cos(az) ** 2, out[1] * math.cos(el) ** 2]
    return out[0], out[1]


def rectified_system(models: list[dict], az_fov_deg: float, el_fov_deg: float, az0_deg: float | None = None, el0_deg: float = 0.0, pixels_per_deg_az: float = -1.0, pixels_per_deg_el: float = -1.0, rectification: str = "LENSMODEL_LATLON") -> list[dict]:
    """Two models with a common orientation: x along the baseline, z as far forward as the cameras look; negative resolutions scale the camera's own."""
    rts = [np.asarray(m["rt_cam_ref"], float) for m in models]
    rt01 = values(pose.compose_rt(NUMPY, list(rts[0]), pose.invert_rt(NUMPY, list(rts[1]))))
    t01 = rt01[3:]
    baseline = float(np.linalg.norm(t01))
    if baseline == 0:
        raise ValueError("the cameras stand at one place")
    x = t01 / baseline
    forward = np.array([0, 0, 1.0]) + _R(rt01) @ np.array([0, 0, 1.0])
    z = forward - (forward @ x) * x
    z /= np.linalg.norm(z)
    R_rect_cam0 = np.stack([x, np.cross(z, x), z])
    if az0_deg is None:
        f = R_rect_cam0 @ (forward / np.linalg.norm(forward))
        az0_deg = math.degrees(math.asin(f[0]))
    own = rectified_resolution(models[0], R_rect_cam0.T, az0_deg, el0_deg, rectification)
    res = [r if r > 0 else -r * o for r, o in zip((pixels_per_deg_az, pixels_per_deg_el), own, strict=True)]
    a0, e0, fa, fe = (math.radians(v) for v in (az0_deg, el0_deg, az_fov_deg, el_fov_deg))
    if rectification == "LENSMODEL_LATLON":
        size = [round(az_fov_deg * res[0]), round(el_fov_deg * res[1])]
        f = [math.degrees(1) * r for r in res]
        c = [(size[0] - 1) / 2 - f[0] * a0, (size[1] - 1) / 2 - f[1] * e0]
    else:
        f = [math.degrees(1) * r for r in res]
        span = [(math.tan(m - w / 2), math.tan(m + w / 2)) for m, w in ((a0, fa), (e0, fe))]
        size = [round(k * (hi - lo)) for k, (lo, hi) in zip(f, span, strict=True)]
        c = [-k * lo for k, (lo, hi) in zip(f, span, strict=True)]
    Rt0 = np.vstack([R_rect_cam0, np.zeros(3)])
    rt_rect0_cam0 = values(pose.rt_from_Rt(NUMPY, [np.float64(v) for v in Rt0.ravel()]))
    rt0 = values(pose.compose_rt(NUMPY, list(rt_rect0_cam0), list(rts[0])))
    rt1 = rt0.copy()
    rt1[3] -= baseline
    base = {"lensmodel": rectification, "intrinsics": np.array([*f, *c]), "imagersize": size}
    return [{**base, "rt_cam_ref": rt0}, {**base, "rt_cam_ref": rt1}]


def validate_rectified(models: list[dict]) -> float:
    """The baseline of a rectified pair; raises where it isn't one."""
    a, b = models
    if a["lensmodel"] != b["lensmodel"] or a["lensmodel"] not in ("LENSMODEL_LATLON", "LENSMODEL_PINHOLE"):
        raise ValueError("both rectified models are LATLON or both are pinholes")
    if not np.allclose(a["intrinsics"], b["intrinsics"]) or list(a["imagersize"]) != list(b["imagersize"]):
        raise ValueError("rectified models have the same intrinsics and size")
    rt = values(pose.compose_rt(NUMPY, list(np.asarray(a["rt_cam_ref"], float)), pose.invert_rt(NUMPY, list(np.asarray(b["rt_cam_ref"], float)))))
    if np.abs(rt[[0, 1, 2, 4, 5]]).max() > 1e-6 or rt[3] <= 0:
        raise ValueError("the second rectified camera stands along x, with the same orientation")
    return float(rt[3])


def image_map(source: dict, target: dict, rotation_only: bool = True, distance: float | None = None, plane: tuple[np.ndarray, float] | None = None) -> np.ndarray:
    """(H, W, 2) of source pixels for each pixel of the target: by rotation, at a distance, or on a plane n.p = d (reference coordinates)."""
    w, h = target["imagersize"]
    x, y = np.meshgrid(np.arange(w, dtype=float), np.arange(h, dtype=float))
    v = lens.unproject(np.stack([x, y], -1), target["lensmodel"], np.asarray(target["intrinsics"]), normalize=True)
    rt = values(pose.compose_rt(NUMPY, list(np.asarray(source["rt_cam_ref"], float)), pose.invert_rt(NUMPY, list(np.asarray(target["rt_cam_ref"], float)))))
    if plane is not None:
        n, d = plane
        inv = values(pose.invert_rt(NUMPY, list(np.asarray(target["rt_cam_ref"], float))))
        ray = values(pose.rotate_point_r(NUMPY, list(inv[:3]), _parts(v)))
        v = v * ((d - n @ inv[3:]) / (ray @ n))[..., None]
    elif distance is not None:
        v = v * distance
    p = values(pose.transform_point_rt(NUMPY, list(rt), _parts(v)) if plane is not None or distance is not None else pose.rotate_point_r(NUMPY, list(rt[:3]), _parts(v)))
    return lens.project(p, source["lensmodel"], np.asarray(source["intrinsics"])).astype(np.float32)


def rectification_maps(models: list[dict], rectified: list[dict]) -> list[np.ndarray]:
    validate_rectified(rectified)
    return [image_map(m, r) for m, r in zip(models, rectified, strict=True)]


def pinhole_for_reprojection(model: dict, fit: str | np.ndarray | None = None, scale_focal: float | None = None, scale_image: float = 1.0) -> dict:
    """A pinhole model for an image; the focal length is scaled so that corners, edge centres or given pixels stay in view."""
    w, h = model["imagersize"]
    i = np.asarray(model["intrinsics"], float)[:4].copy()
    if scale_focal is None and fit is not None:
        m, n = (w - 1) / 2, (h - 1) / 2
        q = {"corners": [[0, 0], [w - 1, 0], [0, h - 1], [w - 1, h - 1]], "centers-horizontal": [[0, n], [w - 1, n]], "centers-vertical": [[m, 0], [m, h - 1]]}[fit] if isinstance(fit, str) else fit
        v = lens.unproject(np.array(q, float), model["lensmodel"], np.asarray(model["intrinsics"]))
        u = v[:, :2] / v[:, 2:] * i[:2]
        room = np.where(u < 0, -i[2:], np.array([w - 1, h - 1]) - i[2:])
        ratio = room / np.where(u == 0, np.nan, u)
        scale_focal = float(np.nanmin(ratio[ratio > 0]))
    i[:2] *= scale_focal or 1.0
    i = np.concatenate([i[:2] * scale_image, (i[2:] + 0.5) * scale_image - 0.5])
    return {**model, "lensmodel": "LENSMODEL_PINHOLE", "intrinsics": i, "imagersize": [round(w * scale_image), round(h * scale_image)]}


def match_feature(image0: np.ndarray, image1: np.ndarray, q0: np.ndarray, search_radius: int, template_size: tuple[int, int], q1_estimate: np.ndarray | None = None, H10: np.ndarray | None = None) -> tuple[np.ndarray | None, dict]:
    """Where a template about q0 is found in the other image: normalised cross-correlation, then a quadratic fit about its best pixel."""
    from plumbline.sources.tables import transform_image

    H = np.eye(3) if H10 is None else H10
    at = H @ np.array([*q0, 1.0])
    center = np.rint(at[:2] / at[2] if q1_estimate is None else q1_estimate).astype(int)
    tw, th = template_size
    dx, dy = np.meshgrid(np.arange(tw) - tw // 2, np.arange(th) - th // 2)
    target = np.stack([dx + center[0], dy + center[1], np.ones_like(dx)], -1).astype(float)
    back = target @ np.linalg.inv(H).T
    back = back[..., :2] / back[..., 2:]
    if H10 is None:
        back = np.stack([dx + q0[0], dy + q0[1]], -1)
    template = transform_image(image0.astype(float), back)
    t = template - template.mean()
    r = search_radius
    scores = np.full((2 * r + 1, 2 * r + 1), -np.inf)
    x0, y0 = center[0] - r - tw // 2, center[1] - r - th // 2  # where the first patch begins
    i0, i1 = max(0, -x0), min(2 * r + 1, image1.shape[1] - tw - x0 + 1)
    j0, j1 = max(0, -y0), min(2 * r + 1, image1.shape[0] - th - y0 + 1)
    if i1 > i0 and j1 > j0:  # all patches within the image at once
        near = image1[y0 + j0 : y0 + j1 - 1 + th, x0 + i0 : x0 + i1 - 1 + tw].astype(float)
        patches = np.lib.stride_tricks.sliding_window_view(near, (th, tw))
        spread = (patches**2).sum((2, 3)) - patches.sum((2, 3)) ** 2 / (th * tw)
        d = np.sqrt(np.maximum(spread, 0) * (t * t).sum())
        scores[j0:j1, i0:i1] = np.where(d > 1e-9, np.einsum("jiyx,yx->ji", patches, t) / np.where(d > 1e-9, d, 1), 0.0)
    if not np.isfinite(scores).any():
        return None, {"scores": scores}
    j, i = np.unravel_index(np.argmax(scores), scores.shape)
    sub = np.zeros(2)
    if 0 < i < 2 * r and 0 < j < 2 * r and np.isfinite(scores[j - 1 : j + 2, i - 1 : i + 2]).all():
        s = scores[j - 1 : j + 2, i - 1 : i + 2]
        y, x = np.mgrid[-1:2, -1:2]
        A = np.stack([np.ones(9), x.ravel(), y.ravel(), x.ravel() ** 2, x.ravel() * y.ravel(), y.ravel() ** 2], 1)
        _, b, c, d, e, f = np.linalg.lstsq(A, s.ravel(), rcond=None)[0]
        M = np.array([[2 * d, e], [e, 2 * f]])
        if np.linalg.det(M) > 0:
            sub = np.clip(np.linalg.solve(M, [-b, -c]), -1, 1)
    return center + [i - r, j - r] + sub, {"scores": scores, "best": float(scores[j, i])}


def rectification_table(spark: SparkSession, models: list[dict], rectified: list[dict]) -> DataFrame:
    """(y, x, x0, y0, x1, y1): the maps as rows, made row of pixels by row of pixels on the cluster."""
    validate_rectified(rectified)
    w, h = rectified[0]["imagersize"]
    schema = "y int, x int, x0 float, y0 float, x1 float, y1 float"

    def run(batches):
        import pandas as pd

        for pdf in batches:
            y, x = np.meshgrid(pdf["id"].to_numpy(), np.arange(w), indexing="ij")
            q = np.stack([x, y], -1).reshape(-1, 2).astype(float)
            out = {"y": q[:, 1].astype("i4"), "x": q[:, 0].astype("i4")}
            for k, (m, r) in enumerate(zip(models, rectified, strict=True)):
                v = lens.unproject(q, r["lensmodel"], np.asarray(r["intrinsics"]))
                rt = values(pose.compose_rt(NUMPY, list(np.asarray(m["rt_cam_ref"], float)), pose.invert_rt(NUMPY, list(np.asarray(r["rt_cam_ref"], float)))))
                p = lens.project(values(pose.rotate_point_r(NUMPY, list(rt[:3]), _parts(v))), m["lensmodel"], np.asarray(m["intrinsics"])).astype("f4")
                out |= {f"x{k}": p[:, 0], f"y{k}": p[:, 1]}
            yield pd.DataFrame(out)

    return spark.range(h).select(F.col("id")).mapInPandas(run, schema)
