"""Rigid alignment of point and vector sets, for one set in memory or one per group on Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEGENERATE = 1e-12


def rotation_of(M: np.ndarray) -> np.ndarray:
    """The rotation R that maximises trace(R' M), M = sum w v0 v1'; zeros where it is not determined."""
    u, s, v = np.linalg.svd(M)
    if s[1] < DEGENERATE:
        return np.zeros((3, 3))
    d = np.sign(np.linalg.det(u @ v))
    return u @ np.diag([1.0, 1.0, d]) @ v


def align_procrustes_vectors_R01(v0: np.ndarray, v1: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """R01 with v0 = R01 v1 in the least-squares sense; vectors as rows."""
    w = np.ones(len(v0)) if weights is None else np.asarray(weights)
    return rotation_of((v0 * w[:, None]).T @ v1)


def align_procrustes_points_Rt01(p0: np.ndarray, p1: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Rt01 (4, 3) with p0 = R p1 + t.  Weights act on the cross-covariance, not on the centroids."""
    c0, c1 = p0.mean(0), p1.mean(0)
    R = align_procrustes_vectors_R01(p0 - c0, p1 - c1, weights)
    return np.vstack([R, c0 - R @ c1])


def align_groups(pairs: DataFrame, keys: list[str], p0: str, p1: str, weight: str | None = None, vectors: bool = False) -> DataFrame:
    """(keys, n, Rt01: 12 numbers) per group of point pairs; of ``vectors``, only turned, about the origin.

    The moments are sums that combine on the map side; only 3x3 matrices reach Python.  The
    weighted cross-covariance about unweighted centroids expands into weighted sums.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    a, b = [F.col(p0)[i] for i in range(3)], [F.col(p1)[i] for i in range(3)]
    sums = [F.count(F.lit(1)).alias("n"), F.sum(w).alias("w")]
    sums += [F.sum(x).alias(f"a{i}") for i, x in enumerate(a)] + [F.sum(x).alias(f"b{i}") for i, x in enumerate(b)]
    sums += [F.sum(w * x).alias(f"wa{i}") for i, x in enumerate(a)] + [F.sum(w * x).alias(f"wb{i}") for i, x in enumerate(b)]
    sums += [F.sum(w * x * y).alias(f"m{i}{j}") for i, x in enumerate(a) for j, y in enumerate(b)]
    moments = pairs.groupBy(*keys).agg(*sums)

    def fit(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                g = lambda p: np.array([r[f"{p}{i}"] for i in range(3)])  # noqa: E731, B023
                M = np.array([[r[f"m{i}{j}"] for j in range(3)] for i in range(3)])
                c0, c1 = (np.zeros(3), np.zeros(3)) if vectors else (g("a") / r["n"], g("b") / r["n"])
                R = rotation_of(M - np.outer(g("wa"), c1) - np.outer(c0, g("wb")) + r["w"] * np.outer(c0, c1))
                rows.append([*R.ravel().tolist(), *(c0 - R @ c1).tolist()])
            yield pd.concat([pdf[[*keys, "n"]].reset_index(drop=True), pd.Series(rows, name="Rt01", dtype=object)], axis=1)

    schema = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return moments.mapInPandas(fit, f"{schema}, n long, Rt01 array<double>")


def implied_rt10(p0: np.ndarray, p1: np.ndarray, q0: np.ndarray, project1, weights: np.ndarray | None = None, steps: int = 50) -> np.ndarray:
    """The pose rt10 for which points of camera 0, moved to camera 1, project to the pixels camera 0 saw: Huber-weighted Gauss-Newton from Procrustes.

    ``project1(p)`` gives (q, dq/dp).  Rows that aren't finite don't count; fewer than three raise.
    """
    from plumbline.functions import pose
    from plumbline.functions.scalars import DUAL, NUMPY, dual_inputs, jacobian, values

    ok = np.isfinite(p0).all(1) & np.isfinite(p1).all(1) & np.isfinite(q0).all(1)
    w = np.where(ok, 1.0 if weights is None else weights, 0.0)
    if (w > 0).sum() < 3:
        raise ValueError("fewer than three samples in the region of focus")
    p0, p1, q0, w = p0[w > 0], p1[w > 0], q0[w > 0], w[w > 0]
    Rt = align_procrustes_points_Rt01(p1, p0, w)
    rt = values(pose.rt_from_Rt(NUMPY, [np.array(x) for x in Rt.ravel()]))
    for _ in range(steps):
        d = dual_inputs(np.broadcast_to(rt, (len(p0), 6)))[0]
        moved = pose.transform_point_rt(DUAL, d, [p0[:, i] for i in range(3)])
        q, dq = project1(values(moved))
        x, j = q - q0, dq @ jacobian(moved)
        size = np.linalg.norm(x, axis=1) * w
        sigma = 1.4826 * np.median(size) + 1e-12
        k = w * np.where(size <= 1.345 * sigma, 1.0, np.sqrt(1.345 * sigma / np.maximum(size, 1e-300)))
        jj, jx = (j * k[:, None, None]).reshape(-1, 6), (x * k[:, None]).ravel()
        step = np.linalg.lstsq(jj, -jx, rcond=None)[0]
        rt = rt + step
        if np.abs(step).max() < 1e-12:
            break
    return rt
