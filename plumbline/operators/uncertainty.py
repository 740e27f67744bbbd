"""Uncertainty of projections, differences between models, triangulation with covariance, refits of lens models."""

from __future__ import annotations

import math

import numpy as np

from plumbline.functions import lens, pose, triangulation
from plumbline.functions.scalars import DUAL, NUMPY, dual_inputs, jacobian, values, with_gradients
from plumbline.operators.alignment import implied_rt10
from plumbline.operators.solver import Problem


def _parts(a: np.ndarray) -> list:
    return [a[..., i] for i in range(a.shape[-1])]


def worst_direction_stdev(cov: np.ndarray) -> np.ndarray:
    """sqrt of the largest eigenvalue; closed forms for 1x1 and 2x2."""
    if cov.shape[-1] == 1:
        return np.sqrt(cov[..., 0, 0])
    if cov.shape[-1] == 2:
        a, b, c = cov[..., 0, 0], cov[..., 0, 1], cov[..., 1, 1]
        return np.sqrt((a + c) / 2 + np.sqrt((a - c) ** 2 / 4 + b * b))
    return np.sqrt(np.linalg.eigvalsh(cov)[..., -1])


def sorted_eig(M: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, v = np.linalg.eig(M)
    order = np.argsort(w, axis=-1)
    return np.take_along_axis(w, order, -1), np.take_along_axis(v, order[..., None, :], -1)


def input_sigma(p: Problem, x: np.ndarray) -> float:
    """The pixel noise that the residuals of board corners and points in use imply."""
    n = p.num_measurements_boards() + p.num_measurements_points()
    used = np.repeat(np.concatenate([p.seen[..., 2].ravel() > 0, p.seen_points[:, 2] > 0]), 2)
    e = x[:n][used]
    return math.sqrt(float(e @ e) / len(e)) / math.sqrt(max(1 - p.num_states() / len(e), 1e-9))


def propagated(p: Problem, J: np.ndarray, sigma: float | None = None) -> np.ndarray:
    """Covariances (m, k, k) of m results with gradients J (m, k, states, packed) by input noise: J M Jo'Jo M J' s^2 with M = (J'J)^-1; only observations carry noise."""
    normal = p.normal()
    solve, observed = normal.factor(), p.normal(observations_only=True) if p.num_measurements_regularization() else normal
    s = input_sigma(p, normal.x) if sigma is None else sigma
    out = np.empty((*J.shape[:2], J.shape[1]))
    for at in range(0, len(J), 512):  # a block at a time, as its columns are dense
        part = J[at : at + 512]
        y = solve(part.reshape(-1, p.num_states()).T)
        z = observed.times(y)
        y, z = (c.T.reshape(part.shape) for c in (y, z))
        out[at : at + 512] = np.einsum("mia,mja->mij", y, z)
    return out * s * s


def state_covariance(p: Problem, sigma: float | None = None) -> np.ndarray:
    """Covariance of all packed variables; for few of them."""
    return propagated(p, np.eye(p.num_states())[None], sigma)[0]


def cross_reprojection(p: Problem) -> np.ndarray:
    """K (6, states): how a fitted motion of the reference follows small changes of packed variables.

    Residuals of frames moved by a small pose T of the reference are J_T T + J_f b; the best T
    for given b is -(J_T'J_T)^-1 J_T'J_f b, over frames and warp.
    """
    n, scale = p.num_states(), p.scales()
    _, blocks = p.measure()
    at_f = [p.state_index_frames(i) for i in range(len(p.rt_ref_frame))]
    A, B = np.zeros((6, 6)), np.zeros((6, n))
    d = dual_inputs(np.zeros((len(at_f), 6)), p.rt_ref_frame)
    moved = pose.compose_rt(DUAL, d[0], d[1])
    D = jacobian(moved)[..., :6]
    keep = np.zeros(n, bool)
    for a in at_f:
        keep[a : a + 6] = True
    if (w := p.state_index_calobject_warp()) is not None:
        keep[w:] = True
    for b, (iframe, _, _) in zip(blocks, p.obs.tolist(), strict=False):  # boards come first
        cols, j = b.all()
        f = np.flatnonzero(cols == at_f[iframe])[0]
        jt = j[:, f : f + 6] @ D[iframe]
        A += jt.T @ jt
        k = keep[cols]
        B[:, cols[k]] += jt.T @ (j * scale[cols])[:, k]
    return -np.linalg.solve(A, B)


def projection_uncertainty(p_cam: np.ndarray, p: Problem, icam: int, method: str = "cross-reprojection", at_infinity: bool = False, what: str = "worstdirection-stdev", sigma: float | None = None) -> np.ndarray:
    """Of points (..., 3) in a camera's coordinates: covariance, worst-direction or RMS deviation of the pixel.

    ``mean-pcam`` averages over frames that move as the boards do; ``cross-reprojection`` fits
    one motion of the reference to all observations.
    """
    n, scale = p.num_states(), p.scales()
    ie = int(p.obs[p.obs[:, 1] == icam][0, 2])
    rt = p.rt_cam_ref[ie] if ie >= 0 else np.zeros(6)
    flat = p_cam.reshape(-1, 3)
    _, dqp, dqi = lens.project_with_gradients(flat, p.lensmodel, p.intrinsics[icam])
    ref = values(pose.transform_point_rt_inverted(NUMPY, list(rt), _parts(flat)) if not at_infinity else pose.rotate_point_r_inverted(NUMPY, list(rt[:3]), _parts(flat)))
    J = np.zeros((len(flat), 2, n))
    if p.n_intrinsics:
        a = p.state_index_intrinsics(icam)
        lo, hi = (0 if p.optimize_core else 4), (None if p.optimize_distortions else 4)
        J[:, :, a : a + p.n_intrinsics] = dqi[:, :, lo:hi]
    d, x = dual_inputs(np.broadcast_to(rt, (len(flat), 6)), ref)
    moved = pose.transform_point_rt(DUAL, d, x) if not at_infinity else pose.rotate_point_r(DUAL, d[:3], x)
    jm = dqp @ jacobian(moved)
    if ie >= 0 and p.optimize_extrinsics:
        a = p.state_index_extrinsics(ie)
        J[:, :, a : a + 6] = jm[:, :, :6]
    dq_ref = jm[:, :, 6:]
    J = J * scale
    t, y = dual_inputs(np.zeros((len(flat), 6)), ref)
    tiny = pose.transform_point_rt(DUAL, t, y) if not at_infinity else pose.rotate_point_r(DUAL, t[:3], y)
    dref = jacobian(tiny)[..., :6]
    if p.optimize_frames and method.startswith("cross-reprojection"):
        J = J + dq_ref @ dref @ -cross_reprojection(p)
    elif p.optimize_frames and method == "mean-pcam":
        for f, rt_f in enumerate(p.rt_ref_frame):
            local = values(pose.transform_point_rt_inverted(NUMPY, list(rt_f), _parts(ref)))
            d, x = dual_inputs(np.broadcast_to(rt_f, (len(flat), 6)), local)
            a = p.state_index_frames(f)
            g = jacobian(pose.transform_point_rt(DUAL, d, x))[..., :6]
            if at_infinity:
                g[..., 3:] = 0
            J[:, :, a : a + 6] += dq_ref @ g * scale[a : a + 6] / len(p.rt_ref_frame)
    elif p.optimize_frames:
        raise ValueError(f"unknown method {method}")
    cov = propagated(p, J, sigma)
    out = {"covariance": lambda: cov, "worstdirection-stdev": lambda: worst_direction_stdev(cov), "rms-stdev": lambda: np.sqrt(np.trace(cov, axis1=-2, axis2=-1) / 2)}[what]()
    return out.reshape(p_cam.shape[:-1] + out.shape[1:])


# -- differences -------------------------------------------------------------------------------
def grid(imagersize, nx: int, ny: int | None = None) -> np.ndarray:
    w, h = imagersize
    ny = int(round(h / w * nx)) if ny is None else ny
    x, y = np.meshgrid(np.linspace(0, w - 1, nx), np.linspace(0, h - 1, ny))
    return np.stack([x, y], -1)


def projection_diff(models: list[tuple[str, np.ndarray]], imagersize, nx: int = 60, ny: int | None = None, distance: float | None = None, focus_radius: float | None = None, weights: list[np.ndarray] | None = None, intrinsics_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(difference, q0): for two models the pixel vectors, for more the RMS about the first over the others.

    The models' coordinates are matched by a robust fit in the focus radius (imager width / 6
    about the centre unless given; 0 or ``intrinsics_only`` for none).
    """
    kernel, _ = projection_difference(models, imagersize, nx, ny=ny, distance=distance, focus_radius=focus_radius, weights=weights, intrinsics_only=intrinsics_only)
    q0 = grid(imagersize, nx, ny)
    r = kernel(q0.reshape(-1, 2))
    return r.reshape(q0.shape[:2] + r.shape[1:]), q0


def projection_difference(models: list[tuple[str, np.ndarray]], imagersize, nx: int = 60, ny: int | None = None, distance: float | None = None, focus_radius: float | None = None, weights: list[np.ndarray] | None = None, intrinsics_only: bool = False):
    """(kernel, number of models): a function of pixels, with the poses between the models fitted on the grid."""
    flat = grid(imagersize, nx, ny).reshape(-1, 2)
    far = 1e5 if distance is None else distance
    center = (np.array(imagersize) - 1) / 2
    radius = min(imagersize) / 6 if focus_radius is None else focus_radius
    poses = [np.zeros(6) for _ in models[1:]]
    if not intrinsics_only and radius > 0:
        near = (((flat - center) ** 2).sum(1) < radius**2).astype(float)
        v = [lens.unproject(flat, m, i, normalize=True) for m, i in models]
        for k, (m, i) in enumerate(models[1:]):
            w = near if weights is None else near * weights[k].ravel()
            poses[k] = implied_rt10(v[0] * far, v[k + 1] * far, flat, lambda p, m=m, i=i: lens.project_with_gradients(p, m, i)[:2], w)

    def kernel(q: np.ndarray) -> np.ndarray:
        p = lens.unproject(q, *models[0], normalize=True) * far
        d = np.array([lens.project(values(pose.transform_point_rt(NUMPY, list(rt), _parts(p))), m, i) - q for rt, (m, i) in zip(poses, models[1:], strict=True)])
        return d[0] if len(d) == 1 else np.sqrt((d**2).sum(-1).mean(0))

    return kernel, len(models)


def stereo_pair_diff(pairs: list[tuple], imagersize, nx: int = 60, ny: int | None = None, distance: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two camera pairs ((model, intrinsics, rt_cam_ref) twice each): where the second camera sees what the first does, pair against pair."""
    q0 = grid(imagersize, nx, ny)
    return stereo_pair_difference(pairs, distance)(q0.reshape(-1, 2)).reshape(q0.shape), q0


def stereo_pair_difference(pairs: list[tuple], distance: float | None = None):
    """The same as a function of pixels."""
    far = 1e5 if distance is None else distance

    def kernel(q: np.ndarray) -> np.ndarray:
        seen = []
        for (m0, i0, rt0), (m1, i1, rt1) in pairs:
            p = lens.unproject(q, m0, np.asarray(i0, float), normalize=True) * far
            ref = values(pose.transform_point_rt_inverted(NUMPY, list(rt0), _parts(p)))
            seen.append(lens.project(values(pose.transform_point_rt(NUMPY, list(rt1), _parts(ref))), m1, np.asarray(i1, float)))
        return seen[1] - seen[0]

    return kernel


def graft(intrinsics_model: dict, extrinsics_model: dict) -> dict:
    """The intrinsics of one model at the pose of another."""
    return {**intrinsics_model, "rt_cam_ref": extrinsics_model["rt_cam_ref"]}


def convert_lensmodel(model: str, intrinsics: np.ndarray, imagersize, to: str, nx: int = 30, distance: float = 1.0, trials: int = 10, seed: int = 0) -> tuple[np.ndarray, float]:
    """Intrinsics of another model fitted to sampled rays of this one; the best of several seeded starts, and its RMS."""
    q = grid(imagersize, nx).reshape(-1, 2)
    p = lens.unproject(q, model, intrinsics, normalize=True) * distance
    ok = np.isfinite(p).all(1)
    q, p = q[ok], p[ok]
    n, rng, best = lens.lensmodel(to).num_params, np.random.default_rng(seed), (None, np.inf)
    for _ in range(trials):
        b = np.concatenate([intrinsics[:4], rng.standard_normal(n - 4) * 1e-3])
        damp, last = 1e-6, np.inf
        x, _, j = _fit_terms(p, q, to, b)
        last = float(x @ x)
        for _ in range(100):
            A = j.T @ j
            step = np.linalg.solve(A + damp * np.diag(np.diag(A) + 1e-9), -j.T @ x)
            x2, _, j2 = _fit_terms(p, q, to, b + step)
            cost = float(x2 @ x2)
            if np.isfinite(cost) and cost <= last:
                done = last - cost < 1e-12 * last
                b, x, j, last, damp = b + step, x2, j2, cost, damp * 0.1
                if done:
                    break
            else:
                damp *= 10
                if damp > 1e10:
                    break
        rms = math.sqrt(last / len(x))
        if rms < best[1]:
            best = (b, rms)
    return best


def _fit_terms(p, q, model, b):
    got, dp, di = lens.project_with_gradients(p, model, b)
    x = (got - q).ravel()
    return np.where(np.isfinite(x), x, 1e3), dp, np.nan_to_num(di.reshape(len(x), -1))


# -- triangulation with covariance -----------------------------------------------------------------
def pixel_covariance(sigma: float, correlation_stdev: float = 0.0) -> np.ndarray:
    """Covariance of a pixel pair's four coordinates; nearby pixels in both cameras share noise as exp of a correlation width."""
    c = correlation_stdev
    out = np.eye(4)
    for i in range(2):
        out[i, 2 + i] = out[2 + i, i] = c
    return out * sigma**2


def triangulate(q: np.ndarray, models: list[tuple], method: str = "leecivera-mid2", q_observation_stdev: float | None = None, correlation: float = 0.0):
    """Points (..., 3) in the first camera's coordinates of pixel pairs (..., 2, 2); with a pixel deviation also their covariances (..., 3, 3)."""
    (m0, i0, rt0), (m1, i1, rt1) = models
    rt01 = pose.compose_rt(NUMPY, list(np.asarray(rt0, float)), pose.invert_rt(NUMPY, list(np.asarray(rt1, float))))
    rt01 = values([np.asarray(x) for x in rt01])
    v0 = lens.unproject(q[..., 0, :], m0, i0)
    v1 = lens.unproject(q[..., 1, :], m1, i1)
    f = triangulation.METHODS[method]

    def both(m, a, b):
        return f(m, a, pose.rotate_point_r(m, [m.num(x) for x in rt01[:3]], b), [m.num(x) for x in rt01[3:]])

    p, j0, j1 = with_gradients(both)(v0, v1)
    if q_observation_stdev is None:
        return p
    J = []
    for v, j, (m, i) in ((v0, j0, (m0, i0)), (v1, j1, (m1, i1))):
        dq = lens.project_with_gradients(v, m, i)[1]
        J.append(j @ np.linalg.pinv(dq))  # the ray's length does not matter to the point
    J = np.concatenate(J, -1)
    return p, J @ pixel_covariance(q_observation_stdev, correlation) @ np.swapaxes(J, -1, -2)


def triangulate_solved(q: np.ndarray, p: Problem, cameras: tuple[int, int], method: str = "leecivera-mid2", q_observation_stdev: float = 0.0, correlation: float = 0.0, sigma: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, covariances by the noise of the solve, covariances by that of the pixels), (..., 3) and (..., 3, 3), in the first camera's coordinates.

    ``q``: pixel pairs (..., 2, 2) of two cameras of a solved problem.  What the solve's noise does to both
    lenses and poses moves a point; ``sigma`` is its pixels' deviation (by its residuals if None).
    """
    flat = q.reshape(-1, 2, 2)
    e = [int(p.obs[p.obs[:, 1] == c][0, 2]) for c in cameras]
    rt = p._poses(np.array(e))
    rays = [lens.unproject_with_gradients(flat[:, k], p.lensmodel, p.intrinsics[c], normalize=True) for k, c in enumerate(cameras)]
    n = len(flat)
    v0, v1, rt0, rt1 = dual_inputs(rays[0][0], rays[1][0], *[np.broadcast_to(x, (n, 6)) for x in rt])
    rt01 = pose.compose_rt(DUAL, rt0, pose.invert_rt(DUAL, rt1))
    found = triangulation.METHODS[method](DUAL, v0, pose.rotate_point_r(DUAL, rt01[:3], v1), rt01[3:])
    j, points = jacobian(found), values(found)
    J = np.zeros((n, 3, p.num_states()))
    lo, hi = (0 if p.optimize_core else 4), (None if p.optimize_distortions else 4)
    for k, c in enumerate(cameras):
        if p.n_intrinsics:
            a = p.state_index_intrinsics(c)
            J[:, :, a : a + p.n_intrinsics] += (j[:, :, 3 * k : 3 * k + 3] @ rays[k][2])[:, :, lo:hi]
        if (a := p.state_index_extrinsics(e[k])) is not None:
            J[:, :, a : a + 6] += j[:, :, 6 + 6 * k : 12 + 6 * k]
    by_solve = propagated(p, J * p.scales(), sigma)
    jq = np.concatenate([j[:, :, :3] @ rays[0][1], j[:, :, 3:6] @ rays[1][1]], -1)
    by_pixels = jq @ pixel_covariance(q_observation_stdev, correlation) @ np.swapaxes(jq, -1, -2)
    shape = q.shape[:-2]
    return points.reshape(*shape, 3), by_solve.reshape(*shape, 3, 3), by_pixels.reshape(*shape, 3, 3)
