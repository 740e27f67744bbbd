"""Calibration by sparse non-linear least squares with rejection of outliers, one problem a group.

A problem's measurements are few thousand to few hundred thousand and share few parameters,
so a problem is solved whole in one task, and Spark distributes over problems.  Boards, free and
fixed points, and triangulated points are measured.  Normal equations are summed from one dense
block for each observation; what frames and points have to themselves stays in small blocks that
are eliminated first, so memory grows with their number, not with its square.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from plumbline.functions import lens, pose, triangulation
from plumbline.functions.scalars import DUAL, NUMPY, dual_inputs, jacobian, values
from plumbline.operators.alignment import align_procrustes_points_Rt01

# Scales of packed state variables.
SCALE_FOCAL, SCALE_CENTER, SCALE_DISTORTION = 500.0, 20.0, 1.0
SCALE_ROTATION_CAMERA, SCALE_TRANSLATION_CAMERA = math.radians(0.1), 1.0
SCALE_ROTATION_FRAME, SCALE_TRANSLATION_FRAME = math.radians(15.0), 1.0
SCALE_POINT, SCALE_WARP = 1.0, 0.01
# What regularisation counts as a pixel error of 0.1.
PIXEL_ERROR = 0.1
USUAL_DISTORTION, USUAL_SPLINE, USUAL_CENTER, USUAL_UNITY = 1.0, 10.0, 0.1, 0.01
DENOMINATOR, TANGENTIAL = 5.0, 10.0
MAX_ITERATIONS, UPDATE_THRESHOLD = 300, 1e-7
K0, K1 = 4.0, 5.0
ROUNDING_PIXELS, ROUNDING_ANGLE = 1e-6, 1e-9


def _rows(*shape: int, kind: type = float):
    return field(default_factory=lambda: np.zeros(shape, kind))


@dataclass
class Block:
    """The gradient of some measurements: by shared states (columns ``cols``), and by the own states of a frame or a point (from ``at`` on)."""

    cols: np.ndarray
    j: np.ndarray
    at: int | None = None
    own: np.ndarray | None = None

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if self.at is None:
            return self.cols, self.j
        return np.concatenate([self.cols, np.arange(self.at, self.at + self.own.shape[1])]), np.concatenate([self.j, self.own], 1)


@dataclass
class Problem:
    """What cameras saw.

    ``obs``: boards (iframe, icam_intrinsics, icam_extrinsics; -1 at the reference), ``seen``: (N, H, W, 3)
    of x, y, weight.  ``obs_points``: (ipoint, icam_intrinsics, icam_extrinsics), ``seen_points``: (N, 3); the
    last ``n_fixed`` points are known.  ``obs_rays``: (set, icam_intrinsics, icam_extrinsics), ``rays``: (N, 3)
    in the camera's coordinates; rays of one set, which stand together, look at one point that is no state.
    """

    lensmodel: str
    imagersizes: np.ndarray
    intrinsics: np.ndarray
    rt_cam_ref: np.ndarray
    rt_ref_frame: np.ndarray
    obs: np.ndarray
    seen: np.ndarray
    spacing: float
    warp: np.ndarray = _rows(2)
    points: np.ndarray = _rows(0, 3)
    n_fixed: int = 0
    obs_points: np.ndarray = _rows(0, 3, kind=int)
    seen_points: np.ndarray = _rows(0, 3)
    obs_rays: np.ndarray = _rows(0, 3, kind=int)
    rays: np.ndarray = _rows(0, 3)
    rays_out: np.ndarray | None = None
    optimize_core: bool = True
    optimize_distortions: bool = True
    optimize_extrinsics: bool = True
    optimize_frames: bool = True
    optimize_warp: bool = True
    regularize: bool = True
    unity_cam01: bool = False

    def __post_init__(self) -> None:
        if self.rays_out is None:
            self.rays_out = np.zeros(len(self.rays), bool)

    @property
    def n_intrinsics(self) -> int:
        return 4 * self.optimize_core + (self.intrinsics.shape[1] - 4) * self.optimize_distortions

    # -- layout: intrinsics, extrinsics, frames, points, warp; boards, points, rays, regularisation -----
    def num_states_intrinsics(self) -> int:
        return self.n_intrinsics * len(self.intrinsics)

    def num_states_extrinsics(self) -> int:
        return 6 * len(self.rt_cam_ref) * self.optimize_extrinsics

    def num_states_frames(self) -> int:
        return 6 * len(self.rt_ref_frame) * self.optimize_frames

    def num_states_points(self) -> int:
        return 3 * (len(self.points) - self.n_fixed) * self.optimize_frames

    def num_states_calobject_warp(self) -> int:
        return 2 * bool(self.optimize_warp and len(self.obs))

    def num_states(self) -> int:
        return self.num_states_intrinsics() + self.num_states_extrinsics() + self.num_states_frames() + self.num_states_points() + self.num_states_calobject_warp()

    def state_index_intrinsics(self, i: int) -> int | None:
        return i * self.n_intrinsics if self.n_intrinsics and 0 <= i < len(self.intrinsics) else None

    def state_index_extrinsics(self, i: int) -> int | None:
        return self.num_states_intrinsics() + 6 * i if self.optimize_extrinsics and 0 <= i < len(self.rt_cam_ref) else None

    def state_index_frames(self, i: int) -> int | None:
        return self.num_states_intrinsics() + self.num_states_extrinsics() + 6 * i if self.optimize_frames and 0 <= i < len(self.rt_ref_frame) else None

    def state_index_points(self, i: int) -> int | None:
        free = self.num_states_points() // 3
        return self.num_states_intrinsics() + self.num_states_extrinsics() + self.num_states_frames() + 3 * i if 0 <= i < free else None

    def state_index_calobject_warp(self) -> int | None:
        return self.num_states() - 2 if self.num_states_calobject_warp() else None

    def num_measurements_boards(self) -> int:
        return 2 * int(np.prod(self.seen.shape[:3]))

    def measurement_index_boards(self, i: int) -> int | None:
        return 2 * i * self.seen.shape[1] * self.seen.shape[2] if 0 <= i < len(self.obs) else None

    def num_measurements_points(self) -> int:
        return 2 * len(self.obs_points)

    def measurement_index_points(self, i: int) -> int | None:
        return self.num_measurements_boards() + 2 * i if 0 <= i < len(self.obs_points) else None

    def pairs(self) -> np.ndarray:
        """(first, second) ray of every measurement of triangulated points, in order."""
        sets = self.obs_rays[:, 0]
        ends = np.flatnonzero(np.diff(sets, append=sets[-1:] + 1)) + 1 if len(sets) else []
        out, start = [], 0
        for end in ends:
            out += [(a, b) for a in range(start, end) for b in range(a + 1, end)]
            start = end
        return np.array(out, int).reshape(-1, 2)

    def num_measurements_points_triangulated(self, first_sets: int | None = None) -> int:
        """Of all sets or of the first ones: n (n - 1) / 2 for a set of n rays."""
        sets, n = np.unique(self.obs_rays[:, 0], return_counts=True)
        first = np.array([np.flatnonzero(self.obs_rays[:, 0] == k)[0] for k in sets], int)
        n = n[np.argsort(first)][:first_sets]
        return int((n * (n - 1) // 2).sum())

    def measurement_index_points_triangulated(self, i_set: int) -> int | None:
        n = len(np.unique(self.obs_rays[:, 0]))
        return self.num_measurements_boards() + self.num_measurements_points() + self.num_measurements_points_triangulated(i_set) if 0 <= i_set < n else None

    def decode_triangulated(self, measurement: int) -> dict[str, int]:
        """The two rays behind a measurement of a triangulated point, counted from the first such one, and the set they are of."""
        a, b = self.pairs()[measurement].tolist()
        mine = np.flatnonzero(self.obs_rays[:, 0] == self.obs_rays[a, 0])
        order = list(dict.fromkeys(self.obs_rays[:, 0].tolist()))
        return {"iobservation0": a, "iobservation1": b, "iobservation_point0": int(mine[0]), "Nobservations_this_point": len(mine), "Nmeasurements_this_point": len(mine) * (len(mine) - 1) // 2, "ipoint": order.index(int(self.obs_rays[a, 0]))}

    def num_measurements_regularization(self) -> int:
        each = (self.intrinsics.shape[1] - 4) * self.optimize_distortions + 2 * self.optimize_core
        return each * len(self.intrinsics) * self.regularize + self._has_unity()

    def _has_unity(self) -> int:
        return int(self.unity_cam01 and self.optimize_extrinsics and len(self.rt_cam_ref) > 0)

    def measurement_index_regularization(self) -> int | None:
        return self.num_measurements() - self.num_measurements_regularization() if self.num_measurements_regularization() else None

    def num_measurements(self) -> int:
        return self.num_measurements_boards() + self.num_measurements_points() + self.num_measurements_points_triangulated() + self.num_measurements_regularization()

    def num_j_nonzero(self) -> int:
        """Room for the entries of a sparse J that may differ from 0.

        A pixel's x has to do with one focal length and one centre coordinate, its y with the others; in splined models
        with the control points about it.  For rays, room is kept for both cameras' intrinsics, too.
        """
        m = lens.lensmodel(self.lensmodel)
        own = 2 * self.optimize_core + ((m.order + 1) ** 2 if m.nx else self.intrinsics.shape[1] - 4) * self.optimize_distortions
        e = 6 * self.optimize_extrinsics
        boards = len(self.obs) * (own + 6 * self.optimize_frames + self.num_states_calobject_warp()) + int((self.obs[:, 2] >= 0).sum()) * e
        free = self.obs_points[:, 0] < self.num_states_points() // 3
        points = len(self.obs_points) * own + int((self.obs_points[:, 2] >= 0).sum()) * e + 3 * int(free.sum())
        pairs = self.pairs()
        rays = int((self.obs_rays[:, 2][pairs] >= 0).sum()) * e + 2 * len(pairs) * own
        regular = sum(len(row) for row in self._regularization()[1])
        return int(2 * np.prod(self.seen.shape[1:3]) * boards + 2 * points + rays + regular)

    # -- state -----------------------------------------------------------------------------
    def scales(self) -> np.ndarray:
        core = [SCALE_FOCAL] * 2 + [SCALE_CENTER] * 2 if self.optimize_core else []
        one = [*core, *[SCALE_DISTORTION] * (self.n_intrinsics - len(core))]
        e = [SCALE_ROTATION_CAMERA] * 3 + [SCALE_TRANSLATION_CAMERA] * 3
        f = [SCALE_ROTATION_FRAME] * 3 + [SCALE_TRANSLATION_FRAME] * 3
        return np.array(one * len(self.intrinsics) + e * (self.num_states_extrinsics() // 6) + f * (self.num_states_frames() // 6) + [SCALE_POINT] * self.num_states_points() + [SCALE_WARP] * self.num_states_calobject_warp())

    def pack(self) -> np.ndarray:
        lo, hi = (0 if self.optimize_core else 4), (None if self.optimize_distortions else 4)
        parts = [self.intrinsics[:, lo:hi].ravel() if self.n_intrinsics else [], self.rt_cam_ref.ravel() if self.optimize_extrinsics else [], self.rt_ref_frame.ravel() if self.optimize_frames else [], self.points.ravel()[: self.num_states_points()], self.warp if self.num_states_calobject_warp() else []]
        return np.concatenate([np.asarray(p, float) for p in parts]) / self.scales()

    def ingest(self, packed: np.ndarray) -> Problem:
        b, at = packed * self.scales(), 0
        i = self.intrinsics.copy()
        if n := self.num_states_intrinsics():
            lo, hi = (0 if self.optimize_core else 4), (None if self.optimize_distortions else 4)
            i[:, lo:hi] = b[:n].reshape(len(i), -1)
            at = n
        out = replace(self, intrinsics=i)
        if n := self.num_states_extrinsics():
            out.rt_cam_ref = b[at : at + n].reshape(-1, 6)
            at += n
        if n := self.num_states_frames():
            out.rt_ref_frame = b[at : at + n].reshape(-1, 6)
            at += n
        if n := self.num_states_points():
            out.points = np.concatenate([b[at : at + n].reshape(-1, 3), self.points[n // 3 :]])
            at += n
        if self.num_states_calobject_warp():
            out.warp = b[at:]
        return out

    # -- measurements ------------------------------------------------------------------------
    def board(self) -> np.ndarray:
        h, w = self.seen.shape[1:3]
        y, x = np.mgrid[:h, :w].astype(float)
        return np.stack([x * self.spacing, y * self.spacing, 4 * x / (w - 1) * (1 - x / (w - 1)), 4 * y / (h - 1) * (1 - y / (h - 1))], -1).reshape(-1, 4)

    def _regularization(self) -> tuple[np.ndarray, list[list[tuple[int, float]]]]:
        """Residuals that pull distortions to 0, centres to the imager's middle and the first camera to distance 1, and the (state, slope) pairs of each.

        A splined model's corrections are split at each control point: along its direction from
        the middle, and across, which counts tenfold (but at the middle itself, where there is none).
        """
        x, rows = [], []
        m, core = lens.lensmodel(self.lensmodel), 4 * self.optimize_core

        def add(*terms: tuple[int, float, float], less: float = 0.0) -> None:
            x.append(sum(s * v for _, s, v in terms) - less)
            rows.append([(i, s) for i, s, _ in terms])

        if self.regularize and self.optimize_distortions:
            for c, row in enumerate(self.intrinsics):
                at, k = self.state_index_intrinsics(c) + core, row[4:]
                if m.nx:
                    s = PIXEL_ERROR / USUAL_SPLINE
                    for n in range(m.nx * m.ny):
                        u, v = n % m.nx - (m.nx - 1) / 2, n // m.nx - (m.ny - 1) / 2
                        away = math.hypot(u, v)
                        u, v, across = (u / away, v / away, s * TANGENTIAL) if away else (1.0, 0.0, s)
                        i = 2 * n
                        add((at + i, s * u, k[i]), (at + i + 1, s * v, k[i + 1]))
                        add((at + i, across * v, k[i]), (at + i + 1, -across * u, k[i + 1]))
                else:
                    rational = m.kind in ("LENSMODEL_OPENCV8", "LENSMODEL_OPENCV12")
                    for i, v in enumerate(k):
                        add((at + i, PIXEL_ERROR / USUAL_DISTORTION * (DENOMINATOR if rational and 5 <= i <= 7 else 1.0), v))
        if self.regularize and self.optimize_core:
            s = PIXEL_ERROR / (USUAL_CENTER * float(self.imagersizes[0][0]))
            for c, row in enumerate(self.intrinsics):
                for i in (0, 1):
                    add((self.state_index_intrinsics(c) + 2 + i, s, row[2 + i]), less=s * (self.imagersizes[c][i] - 1) / 2)
        if self._has_unity():
            s, t, at = PIXEL_ERROR / USUAL_UNITY, self.rt_cam_ref[0, 3:], self.state_index_extrinsics(0) + 3
            x.append(s * (float(t @ t) - 1))
            rows.append([(at + i, 2 * s * v) for i, v in enumerate(t)])
        return np.array(x, float), rows

    def _poses(self, which: np.ndarray) -> np.ndarray:
        return np.vstack([self.rt_cam_ref.reshape(-1, 6), np.zeros((1, 6))])[which]  # -1 takes the last

    def _pixels(self, p: list, cameras: np.ndarray, gradients: bool):
        pv = values(p)
        n = len(pv)
        q, dp, di = np.empty((n, 2)), np.empty((n, 2, 3)), np.empty((n, 2, self.intrinsics.shape[1]))
        for i in range(len(self.intrinsics)):
            at = cameras == i
            if gradients:
                q[at], dp[at], di[at] = lens.project_with_gradients(pv[at], self.lensmodel, self.intrinsics[i])
            else:
                q[at] = lens.project(pv[at], self.lensmodel, self.intrinsics[i])
        return q, dp, di

    def _shared(self, rows: slice, camera: int, extrinsics: int, di: np.ndarray, je: np.ndarray) -> tuple[list, list]:
        cols, parts = [], []
        if self.n_intrinsics:
            a = self.state_index_intrinsics(camera)
            cols += range(a, a + self.n_intrinsics)
            parts.append(di[rows][:, :, (0 if self.optimize_core else 4) : (None if self.optimize_distortions else 4)])
        if (a := self.state_index_extrinsics(extrinsics)) is not None:
            cols += range(a, a + 6)
            parts.append(je[rows])
        return cols, parts

    def _block(self, cols: list, parts: list, n: int, at: int | None = None, own: np.ndarray | None = None) -> Block:
        finite = lambda j: np.where(np.isfinite(j), j, 0.0).reshape(n, -1)
        j = finite(np.concatenate(parts, -1)) if parts else np.zeros((n, 0))
        return Block(np.array(cols, int), j, at, finite(own) if at is not None else None)

    def _boards(self, gradients: bool) -> tuple[np.ndarray, list[Block]]:
        n, k = len(self.obs), self.seen.shape[1] * self.seen.shape[2]
        if not n:
            return np.zeros(0), []
        frame, cam = np.repeat(self.rt_ref_frame[self.obs[:, 0]], k, 0), np.repeat(self._poses(self.obs[:, 2]), k, 0)
        pts, warp = np.tile(self.board(), (n, 1)), np.broadcast_to(self.warp, (n * k, 2))
        m = DUAL if gradients else NUMPY
        f, c, w = dual_inputs(frame, cam, warp) if gradients else ([a[:, i] for i in range(a.shape[1])] for a in (frame, cam, warp))
        p = [pts[:, 0], pts[:, 1], w[0] * pts[:, 2] + w[1] * pts[:, 3]]
        p = pose.transform_point_rt(m, c, pose.transform_point_rt(m, f, p))
        q, dp, di = self._pixels(p, np.repeat(self.obs[:, 1], k), gradients)
        x, weight = _weighted(q, self.seen.reshape(-1, 3))
        if not gradients:
            return x, []
        jp, di = (dp @ jacobian(p)) * weight, di * weight
        blocks = []
        for o, (iframe, ii, ie) in enumerate(self.obs.tolist()):
            s = slice(o * k, o * k + k)
            cols, parts = self._shared(s, ii, ie, di, jp[:, :, 6:12])
            if (a := self.state_index_calobject_warp()) is not None:
                cols += (a, a + 1)
                parts.append(jp[s][:, :, 12:])
            blocks.append(self._block(cols, parts, 2 * k, self.state_index_frames(iframe), jp[s][:, :, :6]))
        return x, blocks

    def _points(self, gradients: bool) -> tuple[np.ndarray, list[Block]]:
        if not len(self.obs_points):
            return np.zeros(0), []
        which, cam = self.points[self.obs_points[:, 0]], self._poses(self.obs_points[:, 2])
        m = DUAL if gradients else NUMPY
        c, p = dual_inputs(cam, which) if gradients else ([a[:, i] for i in range(a.shape[1])] for a in (cam, which))
        p = pose.transform_point_rt(m, c, p)
        q, dp, di = self._pixels(p, self.obs_points[:, 1], gradients)
        x, weight = _weighted(q, self.seen_points)
        if not gradients:
            return x, []
        jp, di = (dp @ jacobian(p)) * weight, di * weight
        blocks = []
        for o, (i, ii, ie) in enumerate(self.obs_points.tolist()):
            cols, parts = self._shared(slice(o, o + 1), ii, ie, di, jp[:, :, :6])
            blocks.append(self._block(cols, parts, 2, self.state_index_points(i), jp[o : o + 1, :, 6:]))
        return x, blocks

    def _rays(self, gradients: bool) -> tuple[np.ndarray, list[Block]]:
        """One angle a pair of rays: how far they miss each other, seen from the second camera."""
        pairs = self.pairs()
        if not len(pairs):
            return np.zeros(0), []
        a, b = pairs.T
        used = ~(self.rays_out[a] | self.rays_out[b])
        first, second = self._poses(self.obs_rays[a, 2]), self._poses(self.obs_rays[b, 2])
        m = DUAL if gradients else NUMPY
        c0, c1 = dual_inputs(first, second) if gradients else ([z[:, i] for i in range(6)] for z in (first, second))
        v0, v1 = ([z[:, i] for i in range(3)] for z in (self.rays[a], self.rays[b]))
        x = ray_error(m, c0, c1, v0, v1)
        value = np.where(used, np.nan_to_num(values([x])[:, 0]), 0.0)
        if not gradients:
            return value, []
        j = np.where(used[:, None, None], jacobian([x]), 0.0)
        blocks = []
        for k, (i, o) in enumerate(zip(self.obs_rays[a, 2].tolist(), self.obs_rays[b, 2].tolist(), strict=True)):
            cols, parts = [], []
            for e, part in ((i, j[k, :, :6]), (o, j[k, :, 6:])):
                if (at := self.state_index_extrinsics(e)) is not None:
                    cols += range(at, at + 6)
                    parts.append(part)
            blocks.append(self._block(cols, parts, 1))
        return value, blocks

    def measure(self, gradients: bool = True) -> tuple[np.ndarray, list[Block]]:
        """All measurements, and the gradients of those that are observations, by unpacked state."""
        found = [f(gradients) for f in (self._boards, self._points, self._rays)]
        total = np.concatenate([*[x for x, _ in found], self._regularization()[0]])
        return np.nan_to_num(total, nan=0.0, posinf=0.0, neginf=0.0), [b for _, blocks in found for b in blocks]

    def normal(self, observations_only: bool = False) -> Normal:
        return Normal(self, observations_only)

    def jacobian_table(self) -> pd.DataFrame:
        """J of unpacked variables as (row, col, value)."""
        rows, at = [], 0
        for cols, j in (b.all() for b in self.measure()[1]):
            r, c = np.indices(j.shape)
            rows.append(pd.DataFrame({"row": (r + at).ravel(), "col": cols[c.ravel()], "value": j.ravel()}))
            at += len(j)
        reg = [(at + k, i, s) for k, row in enumerate(self._regularization()[1]) for i, s in row]
        return pd.concat([*rows, pd.DataFrame(reg, columns=["row", "col", "value"])], ignore_index=True)


def _weighted(q: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    weight = np.maximum(seen[:, 2], 0)
    return np.where(weight[:, None] > 0, (q - seen[:, :2]) * weight[:, None], 0.0).ravel(), weight[:, None, None]


def ray_error(m, rt0, rt1, v0, v1):
    """The angle of two rays, each in its own camera's coordinates: triangulated as seen from the second camera."""
    to = [-x for x in pose.rotate_point_r_inverted(m, rt0[:3], rt0[3:])]
    turned = pose.rotate_point_r(m, rt1[:3], pose.rotate_point_r_inverted(m, rt0[:3], v0))
    return triangulation.reprojection_angle(m, v1, turned, pose.transform_point_rt(m, rt1, to))


class Normal:
    """J'J and J'x of packed variables.  States that all share are dense; frames and points have blocks of their own and meet only the shared ones."""

    def __init__(self, p: Problem, observations_only: bool = False):
        self.x, blocks = p.measure()
        self.n, scale = p.num_states(), p.scales()
        first = p.num_states_intrinsics() + p.num_states_extrinsics()
        # kinds of own blocks: (first state, states a block, number)
        self.kinds = [(first, 6, p.num_states_frames() // 6), (first + p.num_states_frames(), 3, p.num_states_points() // 3)]
        last = first + p.num_states_frames() + p.num_states_points()
        self.shared = np.concatenate([np.arange(first), np.arange(last, self.n)]).astype(int)
        place = np.zeros(self.n, int)
        place[self.shared] = np.arange(len(self.shared))
        ns = len(self.shared)
        self.a = np.zeros((ns, ns))
        self.own = [np.zeros((k, w, w)) for _, w, k in self.kinds]
        self.cross = [np.zeros((k, w, ns)) for _, w, k in self.kinds]
        self.g = np.zeros(self.n)
        at = 0
        for b in blocks:
            cols, js = place[b.cols], b.j * scale[b.cols]
            x = self.x[at : at + len(js)]
            self.a[np.ix_(cols, cols)] += js.T @ js
            self.g[b.cols] += js.T @ x
            if b.at is not None:
                kind = 0 if b.own.shape[1] == 6 else 1
                start, width, _ = self.kinds[kind]
                own, i = b.own * scale[b.at : b.at + width], (b.at - start) // width
                self.own[kind][i] += own.T @ own
                self.cross[kind][i][:, cols] += own.T @ js
                self.g[b.at : b.at + width] += own.T @ x
            at += len(js)
        if not observations_only:
            for r, row in zip(self.x[at:], p._regularization()[1], strict=True):
                i, s = np.array([i for i, _ in row]), np.array([v for _, v in row])
                s = s * scale[i]
                self.a[np.ix_(place[i], place[i])] += np.outer(s, s)
                self.g[i] += s * r

    def _parts(self, v: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for kind, (start, width, k) in enumerate(self.kinds):
            if k:
                yield kind, v[start : start + k * width].reshape(k, width, -1)

    def diagonal(self) -> np.ndarray:
        d = np.zeros(self.n)
        d[self.shared] = np.diag(self.a)
        for kind, (start, width, k) in enumerate(self.kinds):
            d[start : start + k * width] = np.einsum("kii->ki", self.own[kind]).ravel()
        return d

    def times(self, v: np.ndarray) -> np.ndarray:
        """J'J v, for a vector or for columns."""
        v2 = v.reshape(self.n, -1)
        out = np.zeros_like(v2)
        out[self.shared] = self.a @ v2[self.shared]
        for kind, own in self._parts(v2):
            start, width, k = self.kinds[kind]
            out[self.shared] += np.einsum("kws,kwm->sm", self.cross[kind], own)
            out[start : start + k * width] = (self.own[kind] @ own + self.cross[kind] @ v2[self.shared]).reshape(k * width, -1)
        return out.reshape(v.shape)

    def factor(self, damp: float = 0.0) -> Callable[[np.ndarray], np.ndarray]:
        """A solver of (J'J + damp diag) v = r that is made once and used for many r."""
        d = damp * np.maximum(self.diagonal(), 1e-12)
        inverse, folded = {}, {}
        s = self.a + np.diag(d[self.shared])
        for kind, own in self._parts(d):
            inverse[kind] = np.linalg.inv(self.own[kind] + own * np.eye(own.shape[1]))
            folded[kind] = inverse[kind] @ self.cross[kind]
            s = s - np.tensordot(self.cross[kind], folded[kind], ([0, 1], [0, 1]))
        # without damping, states that nothing measures make it singular
        scale = 1 / np.sqrt(np.maximum(np.diag(s), 1e-300))
        try:
            root = np.linalg.cholesky(s * np.outer(scale, scale))
        except np.linalg.LinAlgError:
            root = None

        def shared(r: np.ndarray) -> np.ndarray:
            if root is None:
                return np.linalg.lstsq(s, r, rcond=None)[0]
            return scale[:, None] * np.linalg.solve(root.T, np.linalg.solve(root, scale[:, None] * r))

        def solve(r: np.ndarray) -> np.ndarray:
            r2 = r.reshape(self.n, -1)
            out = np.zeros_like(r2)
            rest = r2[self.shared] - sum((np.tensordot(folded[kind], own, ([0, 1], [0, 1])) for kind, own in self._parts(r2)), 0.0)
            out[self.shared] = shared(rest)
            for kind, own in self._parts(r2):
                start, width, k = self.kinds[kind]
                out[start : start + k * width] = (inverse[kind] @ own - folded[kind] @ out[self.shared]).reshape(k * width, -1)
            return out.reshape(r.shape)

        return solve

    def dense(self) -> np.ndarray:
        return self.times(np.eye(self.n))


def conditioning(p: Problem, k: int = 5) -> list[dict]:
    """The k directions of packed states that measurements fix the least: eigenvalue of J'J, its share of the greatest, and the state that moves most."""
    w, v = np.linalg.eigh(p.normal().dense())
    return [{"eigenvalue": float(w[i]), "share": float(w[i] / w[-1]), "state": int(np.abs(v[:, i]).argmax())} for i in range(min(k, len(w)))]


def mark_outliers(p: Problem, x: np.ndarray) -> tuple[Problem, int]:
    """The problem with newly found outliers marked, and how many were found.

    Board corners and pairs of rays share one deviation about 0.  If any is beyond K1 of it, or two rays
    diverge, all beyond K0 go: corners by negated weights, pairs by marking both rays, as either may be wrong.
    """
    n, pairs = p.num_measurements_boards(), p.pairs()
    e = x[:n].reshape(*p.seen.shape[:3], 2)
    used = p.seen[..., 2] > 0
    angle = np.abs(x[n + p.num_measurements_points() :][: len(pairs)])
    out = p.rays_out.copy()
    diverging = np.zeros(len(pairs), bool)
    if len(pairs):
        a, b = pairs.T
        live = ~(out[a] | out[b])
        diverging = live & ~ray_convergent(p, pairs)
        # a ray that is marked takes its later pairs along
        for i in np.flatnonzero(diverging):
            if not (out[a[i]] or out[b[i]]):
                out[[a[i], b[i]]] = True
        live &= ~(out[a] | out[b])
    else:
        live = diverging
    total = 2 * int(used.sum()) + int(live.sum())
    if not total:
        return replace(p, rays_out=out), int(out.sum() - p.rays_out.sum())
    sigma = math.sqrt((float((e[used] ** 2).sum()) + float((angle[live] ** 2).sum())) / total)
    big = np.abs(e).max(-1) if e.size else np.zeros(p.seen.shape[:3])
    # residuals that are no more than rounding errors are no outliers
    big, angle = np.where(big > ROUNDING_PIXELS, big, 0.0), np.where(angle > ROUNDING_ANGLE, angle, 0.0)
    if not ((used & (big > K1 * sigma)).any() or (live & (angle > K1 * sigma)).any() or diverging.any()):
        return p, 0
    gone, seen = used & (big > K0 * sigma), p.seen.copy()
    seen[..., 2] = np.where(gone, -seen[..., 2], seen[..., 2])
    for i in np.flatnonzero(live & (angle > K0 * sigma)):
        if not (out[a[i]] or out[b[i]]):
            out[[a[i], b[i]]] = True
    return replace(p, seen=seen, rays_out=out), int(gone.sum()) + int(out.sum() - p.rays_out.sum())


def ray_convergent(p: Problem, pairs: np.ndarray) -> np.ndarray:
    a, b = pairs.T
    c0, c1 = ([z[:, i] for i in range(6)] for z in (p._poses(p.obs_rays[a, 2]), p._poses(p.obs_rays[b, 2])))
    v0, v1 = ([z[:, i] for i in range(3)] for z in (p.rays[a], p.rays[b]))
    to = [-x for x in pose.rotate_point_r_inverted(NUMPY, c0[:3], c0[3:])]
    turned = pose.rotate_point_r(NUMPY, c1[:3], pose.rotate_point_r_inverted(NUMPY, c0[:3], v0))
    return triangulation.is_convergent(NUMPY, v1, turned, pose.transform_point_rt(NUMPY, c1, to))


def optimize(p: Problem, reject_outliers: bool = True) -> tuple[Problem, dict]:
    """The solved problem and (rms over all measurements, outliers, iterations, b_packed, x)."""
    iterations, outliers = 0, int((p.seen[..., 2] <= 0).sum()) + int(p.rays_out.sum())
    while True:
        damp, b = 1e-6, p.pack()
        normal = p.normal()
        cost = float(normal.x @ normal.x)
        while iterations < MAX_ITERATIONS and len(b):
            iterations += 1
            step = normal.factor(damp)(-normal.g)
            trial = p.ingest(b + step)
            new = trial.measure(gradients=False)[0]
            new_cost = float(new @ new)
            if new_cost <= cost:
                p, b, damp = trial, b + step, max(damp * 0.1, 1e-12)
                small = np.abs(step).max() < UPDATE_THRESHOLD or cost - new_cost < 1e-12 * cost
                normal = p.normal()
                cost = float(normal.x @ normal.x)
                if small:
                    break
            elif damp > 1e8:
                break
            else:
                damp *= 10
        if not reject_outliers:
            break
        p, found = mark_outliers(p, normal.x)
        if not found:
            break
        outliers += found
    x = normal.x
    return p, {"rms": math.sqrt(float(x @ x) / max(len(x), 1)), "outliers": outliers, "iterations": iterations, "b_packed": p.pack(), "x": x}


# -- seeds -------------------------------------------------------------------------------------
def board_pose(pixels: np.ndarray, board: np.ndarray, lensmodel: str, intrinsics: np.ndarray) -> np.ndarray:
    """rt_cam_board of one planar board: homography of its plane to rays, then refinement on pixels."""
    ok = np.isfinite(pixels).all(-1) & (pixels[:, 2] > 0)
    v = lens.unproject(pixels[ok, :2], lensmodel, intrinsics)
    xy, b = v[:, :2] / v[:, 2:], board[ok, :2]
    rows = []
    for (x, y), (u, w) in zip(xy, b, strict=True):
        rows += [[u, w, 1, 0, 0, 0, -x * u, -x * w, -x], [0, 0, 0, u, w, 1, -y * u, -y * w, -y]]
    H = np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3)
    H = H / np.linalg.norm(H[:, 0]) * (1 if H[2, 2] > 0 else -1)
    a, c = H[:, 0], H[:, 1] / max(np.linalg.norm(H[:, 1]), 1e-12)
    u, _, w = np.linalg.svd(np.stack([a, c, np.cross(a, c)], 1))
    R = u @ np.diag([1, 1, np.linalg.det(u @ w)]) @ w
    rt = values(pose.rt_from_Rt(NUMPY, [np.array(z) for z in [*R.ravel(), *H[:, 2]]]))
    damp, last = 1e-6, np.inf
    for _ in range(30):
        d = dual_inputs(np.broadcast_to(rt, (ok.sum(), 6)))[0]
        p = pose.transform_point_rt(DUAL, d, [board[ok, 0], board[ok, 1], np.zeros(ok.sum())])
        q, dq, _ = lens.project_with_gradients(values(p), lensmodel, intrinsics)
        x, j = (q - pixels[ok, :2]).ravel(), (dq @ jacobian(p)).reshape(-1, 6)
        if not np.isfinite(x).all():
            break
        cost = float(x @ x)
        A = j.T @ j
        step = np.linalg.solve(A + damp * np.diag(np.diag(A)), -j.T @ x)
        rt = rt + step
        if abs(last - cost) < 1e-12 * cost or np.abs(step).max() < 1e-10:
            break
        last = cost
    return rt


def seed(lensmodel: str, imagersizes: np.ndarray, focal: float, obs: np.ndarray, seen: np.ndarray, spacing: float) -> Problem:
    """Board poses by camera, camera poses along the links with most shared frames, joint frame poses."""
    n = lens.lensmodel(lensmodel).num_params
    intrinsics = np.array([[focal, focal, (w - 1) / 2, (h - 1) / 2] + [0.0] * (n - 4) for w, h in imagersizes])
    start = "LENSMODEL_STEREOGRAPHIC" if lensmodel.startswith(("LENSMODEL_SPLINED", "LENSMODEL_STEREO")) else "LENSMODEL_PINHOLE"
    h, w = seen.shape[1:3]
    y, x = np.mgrid[:h, :w]
    board = np.stack([x * spacing, y * spacing, 0 * x], -1).reshape(-1, 3).astype(float)
    T = lambda rt, p: values(pose.transform_point_rt(NUMPY, [np.array(v) for v in rt], [p[:, i] for i in range(3)]))
    poses = {(f, c): board_pose(seen[k].reshape(-1, 3), board, start, intrinsics[c][:4]) for k, (f, c, _) in enumerate(obs.tolist())}
    cams = sorted({c for _, c in poses})
    frames = sorted({f for f, _ in poses})
    rt_cam_ref = {cams[0]: np.zeros(6)}
    while len(rt_cam_ref) < len(cams):  # the link with most shared frames to a camera already placed
        links = [(len([f for f in frames if (f, a) in poses and (f, b) in poses]), -a, -b) for a in rt_cam_ref for b in cams if b not in rt_cam_ref]
        shared, a, b = max(links)
        if shared < 2:
            raise ValueError("a camera shares fewer than two frames with the others")
        a, b = -a, -b
        both = [f for f in frames if (f, a) in poses and (f, b) in poses]
        Rt = align_procrustes_points_Rt01(np.vstack([T(poses[f, b], board) for f in both]), np.vstack([T(poses[f, a], board) for f in both]))
        rt_ba = values(pose.rt_from_Rt(NUMPY, [np.array(v) for v in Rt.ravel()]))
        rt_cam_ref[b] = values(pose.compose_rt(NUMPY, [np.array(v) for v in rt_ba], [np.array(v) for v in rt_cam_ref[a]]))
    rt_frames = []
    for f in frames:
        views = []
        for c in cams:
            if (f, c) in poses:
                inv = values(pose.invert_rt(NUMPY, [np.array(v) for v in rt_cam_ref[c]]))
                views.append(T(inv, T(poses[f, c], board)))
        Rt = align_procrustes_points_Rt01(np.mean(views, 0), board)
        rt_frames.append(values(pose.rt_from_Rt(NUMPY, [np.array(v) for v in Rt.ravel()])))
    return Problem(lensmodel, np.asarray(imagersizes), intrinsics, np.array([rt_cam_ref[c] for c in cams[1:]]).reshape(-1, 6), np.array(rt_frames), obs, seen, spacing)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows by problem over all shuffle partitions: a problem's rows are few but its solve is long, so tasks are not to be joined by their size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def solve_groups(rows: DataFrame, key: str, problem: Callable[[pd.DataFrame], Problem], schema: str, result: Callable[[Problem, dict], pd.DataFrame], reject_outliers: bool = True) -> DataFrame:
    """One solve a group: ``problem`` makes it from the group's rows, ``result`` tells of it (schema, beside the key)."""

    def solve(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = result(*optimize(problem(pdf), reject_outliers))
        out.insert(0, key, [k[0]] * len(out))
        return out

    return dealt(rows, key).groupBy(key).applyInPandas(solve, f"`{key}` {rows.schema[key].dataType.simpleString()}, {schema}")


def calibrate(corners: DataFrame, key: str, lensmodel: str, imagersize: tuple[int, int], focal: float, width_n: int, height_n: int, spacing: float, regularize: bool = True) -> DataFrame:
    """One row a camera and problem: (key, icam, intrinsics, rt_cam_ref, rms, outliers) from corners (key, frame, cam, idx, x, y, w)."""

    def solve(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p, s = solved(pdf, lensmodel, imagersize, focal, width_n, height_n, spacing, regularize)
        poses, n = np.vstack([np.zeros((1, 6)), p.rt_cam_ref]), len(p.intrinsics)
        return pd.DataFrame({key: [k[0]] * n, "icam": range(n), "intrinsics": list(p.intrinsics), "rt_cam_ref": list(poses), "rms": s["rms"], "outliers": s["outliers"]})

    kind = corners.schema[key].dataType.simpleString()
    return dealt(corners, key).groupBy(key).applyInPandas(solve, f"{key} {kind}, icam int, intrinsics array<double>, rt_cam_ref array<double>, rms double, outliers long")


def solved(pdf: pd.DataFrame, lensmodel: str, imagersize: tuple[int, int], focal: float, width_n: int, height_n: int, spacing: float, regularize: bool = True) -> tuple[Problem, dict]:
    """One problem's corners (frame, cam, idx, x, y, w), solved in stages: poses with a plain core first, then all parameters with outlier rejection.  Boards that are not whole do not count."""
    frames = {f: i for i, f in enumerate(sorted(pdf["frame"].unique()))}
    cams = {c: i for i, c in enumerate(sorted(pdf["cam"].unique()))}
    obs, seen = [], []
    for (f, c), g in pdf.sort_values(["frame", "cam", "idx"]).groupby(["frame", "cam"], sort=True):
        if len(g) == width_n * height_n:
            obs.append((frames[f], cams[c], cams[c] - 1))
            seen.append(g[["x", "y", "w"]].to_numpy(float).reshape(height_n, width_n, 3))
    p = seed(lensmodel, np.array([imagersize] * len(cams)), focal, np.array(obs), np.array(seen), spacing)
    p, _ = optimize(replace(p, optimize_distortions=False, optimize_core=False, optimize_warp=False, regularize=regularize), reject_outliers=False)
    p, _ = optimize(replace(p, optimize_core=True), reject_outliers=False)
    return optimize(replace(p, optimize_distortions=True, optimize_warp=True))
