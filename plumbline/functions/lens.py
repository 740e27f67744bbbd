"""Lens models: names and configurations, projection and its inverse, resolution.

Closed forms are formulas over scalars (column expressions, arrays, SQL text or dual
numbers); CAHVORE and splined models are array kernels, run on Spark in Arrow batches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.pose import dot, norm
from plumbline.functions.scalars import DUAL, NUMPY, SPARK, Dual, dual_inputs, jacobian, on_frame, values

# Model names and their numbers of parameters.
NUM_PARAMS = {
    "LENSMODEL_PINHOLE": 4,
    "LENSMODEL_STEREOGRAPHIC": 4,
    "LENSMODEL_LONLAT": 4,
    "LENSMODEL_LATLON": 4,
    "LENSMODEL_OPENCV4": 8,
    "LENSMODEL_OPENCV5": 9,
    "LENSMODEL_OPENCV8": 12,
    "LENSMODEL_OPENCV12": 16,
    "LENSMODEL_CAHVOR": 9,
    "LENSMODEL_CAHVORE": 12,
}
_CAHVORE = re.compile(r"^LENSMODEL_CAHVORE_linearity=([-+0-9.eE]+)$")
_SPLINED = re.compile(r"^LENSMODEL_SPLINED_STEREOGRAPHIC_order=(\d+)_Nx=(\d+)_Ny=(\d+)_fov_x_deg=(\d+)$")
BAD_CONFIG, MISSING_CONFIG, UNKNOWN = -2, -3, -4


@dataclass(frozen=True)
class LensModel:
    kind: str
    linearity: float = 0.0
    order: int = 0
    nx: int = 0
    ny: int = 0
    fov_x_deg: int = 0

    @property
    def name(self) -> str:
        if self.kind == "LENSMODEL_CAHVORE":
            return f"{self.kind}_linearity={self.linearity:.2f}"
        if self.kind == "LENSMODEL_SPLINED_STEREOGRAPHIC":
            return f"{self.kind}_order={self.order}_Nx={self.nx}_Ny={self.ny}_fov_x_deg={self.fov_x_deg}"
        return self.kind

    @property
    def num_params(self) -> int:
        return 4 + 2 * self.nx * self.ny if self.nx else NUM_PARAMS[self.kind]

    @property
    def segments_per_u(self) -> float:
        margin = 2 if self.order == 3 else 1
        return (self.nx - 1 - margin) / (4 * math.tan(math.radians(self.fov_x_deg) / 4))

    @property
    def metadata(self) -> dict:
        behind = self.kind in ("LENSMODEL_SPLINED_STEREOGRAPHIC", "LENSMODEL_STEREOGRAPHIC", "LENSMODEL_LONLAT", "LENSMODEL_LATLON")
        return {"has_core": True, "can_project_behind_camera": behind, "has_gradients": True, "noncentral": self.kind == "LENSMODEL_CAHVORE"}

    @property
    def config(self) -> dict:
        if self.kind == "LENSMODEL_CAHVORE":
            return {"linearity": self.linearity}
        return {"order": self.order, "Nx": self.nx, "Ny": self.ny, "fov_x_deg": self.fov_x_deg} if self.nx else {}


def parse_name(name: str) -> LensModel | int:
    """A model from its name, or an error code: bad configuration, missing configuration, unknown type."""
    if name in NUM_PARAMS:
        return MISSING_CONFIG if name == "LENSMODEL_CAHVORE" else LensModel(name)
    if name == "LENSMODEL_SPLINED_STEREOGRAPHIC":
        return MISSING_CONFIG
    if m := _CAHVORE.match(name):
        try:
            return LensModel("LENSMODEL_CAHVORE", linearity=float(m[1]))
        except ValueError:
            return BAD_CONFIG
    if m := _SPLINED.match(name):
        order, nx, ny, fov = map(int, m.groups())
        return LensModel("LENSMODEL_SPLINED_STEREOGRAPHIC", order=order, nx=nx, ny=ny, fov_x_deg=fov) if order in (2, 3) and nx > 3 and ny > 3 else BAD_CONFIG
    return BAD_CONFIG if name.startswith(("LENSMODEL_CAHVORE_", "LENSMODEL_SPLINED_STEREOGRAPHIC_")) else UNKNOWN


def lensmodel(name: str | LensModel) -> LensModel:
    m = name if isinstance(name, LensModel) else parse_name(name)
    if isinstance(m, int):
        raise ValueError(f"{name}: " + {BAD_CONFIG: "bad configuration", MISSING_CONFIG: "configuration is missing", UNKNOWN: "unknown lens model"}[m])
    return m


def supported_lensmodels() -> tuple[str, ...]:
    return (*[n for n in NUM_PARAMS if n != "LENSMODEL_CAHVORE"], "LENSMODEL_CAHVORE_linearity=...", "LENSMODEL_SPLINED_STEREOGRAPHIC_order=..._Nx=..._Ny=..._fov_x_deg=...")


def num_params_column(name: Column) -> Column:
    """The number of parameters of a column of model names; null where a name is none."""
    nx, ny = (F.regexp_extract(name, _SPLINED.pattern, i).try_cast("int") for i in (2, 3))
    out = F.when(name.rlike(_SPLINED.pattern), 4 + 2 * nx * ny).when(name.rlike(_CAHVORE.pattern), 12)
    for n, k in NUM_PARAMS.items():
        if n != "LENSMODEL_CAHVORE":
            out = out.when(name == n, k)
    return out


# -- closed forms ----------------------------------------------------------------------------
def _core(m, i, x, y):
    return [x * i[0] + i[2], y * i[1] + i[3]]


def project_pinhole(m, i, p):
    return _core(m, i, m.div(p[0], p[2]), m.div(p[1], p[2]))


def project_pinhole_late(m, i, p):
    """The same, divided last: a product of short decimals is exact or nearly so, and only the quotient is rounded."""
    return [m.div(p[0] * i[0], p[2]) + i[2], m.div(p[1] * i[1], p[2]) + i[3]]


def unproject_pinhole(m, i, q):
    return [m.div(q[0] - i[2], i[0]), m.div(q[1] - i[3], i[1]), m.num(1)]


def stereographic_u(m, p):
    k = m.div(2.0, norm(m, p) + p[2])
    return [p[0] * k, p[1] * k]


def project_stereographic(m, i, p):
    return _core(m, i, *stereographic_u(m, p))


def ray_of_u(m, u):
    return [u[0], u[1], 1 - (u[0] * u[0] + u[1] * u[1]) * 0.25]


def unproject_stereographic(m, i, q):
    return ray_of_u(m, [m.div(q[0] - i[2], i[0]), m.div(q[1] - i[3], i[1])])


def project_lonlat(m, i, p):
    return _core(m, i, m.atan2(p[0], p[2]), m.asin(m.div(p[1], norm(m, p))))


def unproject_lonlat(m, i, q):
    lon, lat = m.div(q[0] - i[2], i[0]), m.div(q[1] - i[3], i[1])
    return [m.cos(lat) * m.sin(lon), m.sin(lat), m.cos(lat) * m.cos(lon)]


def project_latlon(m, i, p):
    return _core(m, i, m.asin(m.div(p[0], norm(m, p))), m.atan2(p[1], p[2]))


def unproject_latlon(m, i, q):
    lat, lon = m.div(q[0] - i[2], i[0]), m.div(q[1] - i[3], i[1])
    return [m.sin(lat), m.cos(lat) * m.sin(lon), m.cos(lat) * m.cos(lon)]


def project_opencv(m, i, p):
    """Radial rational, tangential and thin-prism terms; coefficients a model lacks are 0."""
    k = [*i[4:], *[None] * (16 - len(i))]
    x, y = m.div(p[0], p[2]), m.div(p[1], p[2])
    r2 = x * x + y * y
    r4 = r2 * r2

    def series(*terms):
        total = None
        for c, power in terms:
            if c is not None:
                total = c * power if total is None else total + c * power
        return total

    radial = 1 + series((k[0], r2), (k[1], r4), (k[4], r4 * r2))
    down = series((k[5], r2), (k[6], r4), (k[7], r4 * r2))
    if down is not None:
        radial = m.div(radial, 1 + down)
    xd = x * radial + k[2] * (2 * x * y) + k[3] * (r2 + 2 * x * x)
    yd = y * radial + k[2] * (r2 + 2 * y * y) + k[3] * (2 * x * y)
    if k[8] is not None:
        xd, yd = xd + k[8] * r2 + k[9] * r4, yd + k[10] * r2 + k[11] * r4
    return _core(m, i, xd, yd)


def _axis(m, alpha, beta):
    return [m.sin(alpha) * m.cos(beta), m.sin(beta), m.cos(alpha) * m.cos(beta)]


def project_cahvor(m, i, p):
    """The point moves off the optical axis o in proportion to mu(tau), tau the squared tangent of its angle to o."""
    o = _axis(m, i[4], i[5])
    w = dot(p, o)
    tau = m.div(dot(p, p), w * w) - 1
    mu = i[6] + i[7] * tau + i[8] * tau * tau
    return project_pinhole(m, i, [x + (x - w * a) * mu for x, a in zip(p, o, strict=True)])


CLOSED = {
    "LENSMODEL_PINHOLE": (project_pinhole, unproject_pinhole),
    "LENSMODEL_STEREOGRAPHIC": (project_stereographic, unproject_stereographic),
    "LENSMODEL_LONLAT": (project_lonlat, unproject_lonlat),
    "LENSMODEL_LATLON": (project_latlon, unproject_latlon),
    **{f"LENSMODEL_OPENCV{n}": (project_opencv, None) for n in (4, 5, 8, 12)},
    "LENSMODEL_CAHVOR": (project_cahvor, None),
}


# -- iterative and splined models --------------------------------------------------------------
def entry_angle(zeta: np.ndarray, size: np.ndarray, pupil: tuple, top: float) -> np.ndarray:
    """The least angle to the axis, up to ``top``, under which a point enters a pupil that moves along the axis; NaN where there is none.

    A point at depth zeta and at a distance from the axis enters at theta if
    zeta sin(theta) - size cos(theta) = (theta - sin(theta)) E(theta).  The difference of both sides
    is negative at 0.  It is bracketed about the angle to a fixed pupil and narrowed by Newton's steps
    that stay in the bracket, else by halves.
    """
    e0, e1, e2 = pupil

    def gap(t):
        return zeta * np.sin(t) - size * np.cos(t) - (t - np.sin(t)) * (e0 + t * t * (e1 + t * t * e2))

    def slope(t):
        return zeta * np.cos(t) + size * np.sin(t) - (1 - np.cos(t)) * (e0 + t * t * (e1 + t * t * e2)) - (t - np.sin(t)) * t * (2 * e1 + 4 * e2 * t * t)

    fixed = np.arctan2(size, zeta)
    low, high, width = np.zeros_like(fixed), np.minimum(fixed, top), np.full_like(fixed, 1e-3)
    for _ in range(40):
        short = gap(high) < 0
        if not np.any(short & (high < top)):
            break
        low = np.where(short, high, low)
        high = np.where(short, np.minimum(high + width, top), high)
        width = np.where(short, width * 1.5, width)
    found, theta = gap(high) >= 0, np.minimum(fixed, high)
    for _ in range(80):
        y = gap(theta)
        low, high = np.where(y < 0, theta, low), np.where(y < 0, high, theta)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = theta - y / slope(theta)
        following = np.where((step >= low) & (step <= high), step, (low + high) / 2)
        if np.nanmax(np.abs(following - theta), initial=0.0) <= 1e-15:
            break
        theta = following
    return np.where(found, theta, np.nan)


def project_cahvore(m, i, p, linearity: float):
    """CAHVOR with an entrance pupil that moves along the axis; NaN where no ray enters.

    From the pupil on, the distance off the axis counts as chi, a sine, tangent or multiple of the
    entry angle by ``linearity``; mu(chi^2) moves the point off the axis.
    """
    plain = lambda v: v.x if isinstance(v, Dual) else np.asarray(v, float)
    o = _axis(m, i[4], i[5])
    zeta = dot(p, o)
    off = [a - zeta * b for a, b in zip(p, o, strict=True)]
    size = norm(m, off)
    top = np.pi if linearity == 0 else min(np.pi, np.pi / 2 / abs(linearity))
    z, r, *e = np.broadcast_arrays(plain(zeta), plain(size), *map(plain, i[9:12]))
    theta0 = entry_angle(z, r, tuple(e), top)
    lost, central = np.isnan(theta0), theta0 <= 1e-8
    theta0 = np.where(lost | central, 1e-3, theta0)
    # one step from the root changes nothing but brings in the derivatives of what it hangs on
    sin, cos, sq = np.sin(theta0), np.cos(theta0), theta0 * theta0
    pupil = i[9] + i[10] * sq + i[11] * (sq * sq)
    rest = zeta * sin - size * cos - pupil * (theta0 - sin)
    slope = plain(zeta) * cos + plain(size) * sin - (1 - cos) * plain(pupil) - (theta0 - sin) * theta0 * (2 * plain(i[10]) + 4 * plain(i[11]) * sq)
    theta = theta0 - m.div(rest, np.where(slope == 0, np.nan, slope))
    bend = {-1: m.sin, 0: lambda t: t, 1: m.tan}[int(np.sign(linearity)) if abs(linearity) > 1e-15 else 0]
    chi = bend(theta * linearity) * (1 / linearity) if abs(linearity) > 1e-15 else theta
    chi2 = chi * chi
    mu = i[6] + chi2 * (i[7] + chi2 * i[8])
    depth = m.div(size, chi)
    bent = [m.where(central, a, b * depth + c * (1 + mu)) for a, b, c in zip(p, o, off, strict=True)]
    return [m.where(lost, m.num(np.nan), q) for q in project_pinhole(m, i, bent)]


def spline_weights(x, order: int):
    """B-spline weights of the control points around an interval, x from its left knot (cubic) or from its middle knot (quadratic)."""
    x2 = x * x
    if order == 3:
        x3 = x2 * x
        return [(1 - 3 * x + 3 * x2 - x3) * (1 / 6), (4 - 6 * x2 + 3 * x3) * (1 / 6), (1 + 3 * x + 3 * x2 - 3 * x3) * (1 / 6), x3 * (1 / 6)]
    return [(1 - 4 * x + 4 * x2) * (1 / 8), (3 - 4 * x2) * (1 / 4), (1 + 4 * x + 4 * x2) * (1 / 8)]


def spline_cell(model: LensModel, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(knot the weights count from, first control point) of a coordinate in knots; clamped to the grid."""
    if model.order == 3:
        k = np.clip(np.trunc(at).astype(int), 1, n - 3)
    else:
        k = np.clip(np.trunc(at + 0.5).astype(int), 1, n - 2)
    return k, k - 1


def project_splined(m, model: LensModel, intrinsics: np.ndarray, p, core=None):
    """(q, index of the first control point's x parameter, weights over the patch); ``core`` may hold dual numbers."""
    u = stereographic_u(m, p)
    value = lambda v: v.x if isinstance(v, Dual) else np.asarray(v)
    ix = u[0] * model.segments_per_u + (model.nx - 1) / 2
    iy = u[1] * model.segments_per_u + (model.ny - 1) / 2
    kx, x0 = spline_cell(model, np.nan_to_num(value(ix)), model.nx)
    ky, y0 = spline_cell(model, np.nan_to_num(value(iy)), model.ny)
    wx, wy = spline_weights(ix - kx.astype(float), model.order), spline_weights(iy - ky.astype(float), model.order)
    du, weights = [0.0, 0.0], []
    for a, wa in enumerate(wy):
        for b, wb in enumerate(wx):
            w = wa * wb
            at = 4 + 2 * ((y0 + a) * model.nx + x0 + b)
            weights.append((at, value(w)))
            du = [d + w * np.take(intrinsics, at + c) for c, d in enumerate(du)]
    i = core if core is not None else list(intrinsics[:4])
    return _core(m, i, u[0] + du[0], u[1] + du[1]), weights


def splined_formula(model: LensModel, intrinsics):
    """The projection of one splined model as a formula of a point, for column expressions and arrays; its control points are a table in it."""
    core, at = [float(x) for x in intrinsics[:4]], tuple(float(x) for x in intrinsics[4:])
    tables = at[0::2], at[1::2]
    first, last = (1, 3) if model.order == 3 else (1, 2)

    def cell(m, x, n):
        k = m.floor(x if model.order == 3 else x + 0.5)
        return m.where(k < first, m.num(first), m.where(k > n - last, m.num(n - last), k))

    def formula(m, p):
        u = stereographic_u(m, p)
        ix, iy = (c * model.segments_per_u + (n - 1) / 2 for c, n in zip(u, (model.nx, model.ny), strict=True))
        kx, ky = cell(m, ix, model.nx), cell(m, iy, model.ny)
        wx, wy = spline_weights(ix - kx, model.order), spline_weights(iy - ky, model.order)
        corner = (ky - 1) * float(model.nx) + (kx - 1)
        moved = []
        for c, table in zip(u, tables, strict=True):
            total = c
            for a, wa in enumerate(wy):
                row = None
                for b, wb in enumerate(wx):
                    term = wb * m.take(table, corner + float(a * model.nx + b))
                    row = term if row is None else row + term
                total = total + wa * row
            moved.append(total)
        return _core(m, core, *moved)

    return formula


def project_splined_arrays(p: np.ndarray, model: LensModel, intrinsics: np.ndarray) -> np.ndarray:
    """The same as ``project_splined``, for pixels alone: a control point's two coordinates are fetched and weighted as one complex number."""
    i = np.ascontiguousarray(intrinsics, float)
    u = stereographic_u(NUMPY, _parts(p))
    at = [c * model.segments_per_u + (n - 1) / 2 for c, n in zip(u, (model.nx, model.ny), strict=True)]
    (kx, x0), (ky, y0) = (spline_cell(model, np.nan_to_num(c), n) for c, n in zip(at, (model.nx, model.ny), strict=True))
    wx, wy = spline_weights(at[0] - kx, model.order), spline_weights(at[1] - ky, model.order)
    points, first = i[4:].view(np.complex128), y0 * model.nx + x0
    moved = u[0] + 1j * u[1]
    for a, w in enumerate(wy):
        row = wx[0] * points[first + a * model.nx]
        for b in range(1, len(wx)):
            row = row + wx[b] * points[first + (a * model.nx + b)]
        moved = moved + w * row
    return np.stack(_core(NUMPY, i, moved.real, moved.imag), -1)


def project(p: np.ndarray, model: str | LensModel, intrinsics: np.ndarray) -> np.ndarray:
    """Pixels (..., 2) of points (..., 3); intrinsics (n) or, but for splined models, broadcast (..., n)."""
    if (m := lensmodel(model)).nx:
        return project_splined_arrays(np.asarray(p, float), m, intrinsics)
    return values(_project(NUMPY, lensmodel(model), np.asarray(intrinsics, float), _parts(p)))


def _parts(p: np.ndarray) -> list:
    p = np.asarray(p, float)
    return [p[..., k] for k in range(p.shape[-1])]


def _project(m, model: LensModel, intrinsics: np.ndarray, p: list, i: list | None = None) -> list:
    if model.nx:
        return project_splined(m, model, intrinsics, p, i and i[:4])[0]
    i = _parts(intrinsics) if i is None else i
    return project_cahvore(m, i, p, model.linearity) if model.kind == "LENSMODEL_CAHVORE" else CLOSED[model.kind][0](m, i, p)


def project_with_gradients(p: np.ndarray, model: str | LensModel, intrinsics: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, dq/dp, dq/dintrinsics)."""
    model, p, intrinsics = lensmodel(model), np.asarray(p, float), np.asarray(intrinsics, float)
    if not model.nx:
        dp, di = dual_inputs(p, np.broadcast_to(intrinsics, p.shape[:-1] + intrinsics.shape[-1:]))
        out = _project(DUAL, model, intrinsics, dp, di)
        j = jacobian(out)
        return values(out), j[..., :3], j[..., 3:]
    dp, core = dual_inputs(p, np.broadcast_to(intrinsics[:4], p.shape[:-1] + (4,)))
    out, weights = project_splined(DUAL, model, intrinsics, dp, core)
    j = jacobian(out)
    di = np.zeros((*j.shape[:-1], model.num_params))
    di[..., :4] = j[..., 3:]
    for at, w in weights:
        for c in (0, 1):
            np.put_along_axis(di[..., c, :], (np.asarray(at) + c)[..., None], (w * intrinsics[c])[..., None], -1)
    return values(out), j[..., :3], di


MAX_STEPS, GOOD_ENOUGH = 100, 1e-4


def unproject(q: np.ndarray, model: str | LensModel, intrinsics: np.ndarray, normalize: bool = False) -> np.ndarray:
    """Rays (..., 3) of pixels; closed forms where there are any, else damped Newton steps in stereographic coordinates.  A pixel that no ray meets gives NaN in all components."""
    model, q, intrinsics = lensmodel(model), np.asarray(q, float), np.asarray(intrinsics, float)
    if model.metadata["noncentral"] and np.any(intrinsics[..., 9:12] != 0):
        raise ValueError("a noncentral model has no unprojection")
    if model.kind in CLOSED and (f := CLOSED[model.kind][1]):
        v = values(f(NUMPY, _parts(intrinsics), _parts(q)))
    else:
        f2 = intrinsics[..., :2]
        u = np.broadcast_to((q - intrinsics[..., 2:4]) / f2, q.shape).copy()
        if not model.metadata["can_project_behind_camera"]:  # start from a pinhole's ray
            u = values(stereographic_u(NUMPY, [u[..., 0], u[..., 1], np.ones(u.shape[:-1])]))

        def residual(u):
            dual = dual_inputs(u)[0]
            out = _project(DUAL, model, intrinsics, ray_of_u(DUAL, dual), None)
            return values(out) - q, jacobian(out)

        damp = np.full(u.shape[:-1], 1e-9)
        r, j = residual(u)
        for _ in range(MAX_STEPS):
            a = np.einsum("...ki,...kj->...ij", j, j)
            a = a + damp[..., None, None] * (np.eye(2) * np.trace(a, axis1=-2, axis2=-1)[..., None, None] + 1e-300 * np.eye(2))
            a = np.where(np.isfinite(a), a, np.eye(2))
            step = np.linalg.solve(a, np.nan_to_num(np.einsum("...ki,...k->...i", j, r))[..., None])[..., 0]
            r2, j2 = residual(u - step)
            better = (r2**2).sum(-1) <= (r**2).sum(-1)
            u = np.where(better[..., None], u - step, u)
            r, j = np.where(better[..., None], r2, r), np.where(better[..., None, None], j2, j)
            damp = np.where(better, damp * 0.1, np.minimum(damp * 10 + 1e-6, 1e6))
            if not np.any(np.abs(np.where(better[..., None], step, 1.0)).max(-1) > 1e-12) or np.all((r**2).sum(-1) < 1e-24):
                break
        v = values(ray_of_u(NUMPY, _parts(u)))
        v = np.where(((r**2).sum(-1) / 2 > GOOD_ENOUGH)[..., None] | ~np.isfinite(r).all(-1)[..., None], np.nan, v)
    return v / np.linalg.norm(v, axis=-1, keepdims=True) if normalize else v


def unproject_with_gradients(q: np.ndarray, model: str | LensModel, intrinsics: np.ndarray, normalize: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(v, dv/dq, dv/dintrinsics), of the ray as ``unproject`` gives it or of unit length."""
    model, q, intrinsics = lensmodel(model), np.asarray(q, float), np.asarray(intrinsics, float)
    v = unproject(q, model, intrinsics)
    if model.kind in CLOSED and (f := CLOSED[model.kind][1]):
        i = np.broadcast_to(intrinsics, q.shape[:-1] + intrinsics.shape[-1:])
        dq, di = dual_inputs(q, i)
        j = jacobian([Dual.of(x, dq[0]) for x in f(DUAL, di, dq)])
        vq, vi = j[..., :2], j[..., 2:]
    else:
        # rays by their stereographic coordinates: a pixel that stays, stays where dq/du du + dq/di di = 0
        _, qv, qi = project_with_gradients(v, model, intrinsics)
        u = values(stereographic_u(NUMPY, _parts(v)))
        vu = jacobian(ray_of_u(DUAL, dual_inputs(u)[0]))
        vq = vu @ np.linalg.inv(qv @ vu)
        vi = -vq @ qi
    if normalize:
        size = np.linalg.norm(v, axis=-1)[..., None]
        v = v / size
        flat = (np.eye(3) - v[..., :, None] * v[..., None, :]) / size[..., None]
        vq, vi = flat @ vq, flat @ vi
    return v, vq, vi


# -- Spark -----------------------------------------------------------------------------------
def project_column(p: Column, model: str, intrinsics: Column) -> Column:
    """An expression for the closed-form models; null where the point can't be projected."""
    k = lensmodel(model)
    return F.array(*CLOSED[k.kind][0](SPARK, [intrinsics[j] for j in range(k.num_params)], [p[j] for j in range(3)]))


def unproject_column(q: Column, model: str, intrinsics: Column) -> Column:
    f = CLOSED[lensmodel(model).kind][1]
    if f is None:
        raise ValueError(f"{model} has no closed form; use with_unprojections")
    return F.array(*f(SPARK, [intrinsics[j] for j in range(4)], [q[j] for j in range(2)]))


def with_kernel(df: DataFrame, inputs: list[str], kernel, names: list[str]) -> DataFrame:
    """``df`` with the columns that ``kernel`` makes of (rows, inputs), a batch of rows at a time; null where a result is not finite or an input is null."""
    keep = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([np.asarray(b.column(c).cast(pa.float64()).fill_null(np.nan)) for c in inputs], -1)
            with np.errstate(all="ignore"):
                out = np.asarray(kernel(x), float).reshape(b.num_rows, len(names)) if b.num_rows else np.zeros((0, len(names)))
            yield pa.record_batch([*b.columns, *[pa.array(c, mask=~np.isfinite(c)) for c in _parts(out)]], names=[*keep, *names])

    return df.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], *[f"`{n}` double" for n in names]]))


def with_pixels(df: DataFrame, point: list[Column], model: str, intrinsics, names: tuple[str, str] = ("qx", "qy")) -> DataFrame:
    """One model for all rows: the pixel of a point as two columns; null where there is none.

    Closed forms are generated code.  Splined models and CAHVORE are array kernels on flat columns: as
    generated code (``splined_formula``) a spline's sixteen terms are too much for one method, and slower.
    """
    k = lensmodel(model)
    if k.kind in CLOSED:
        return on_frame(df, lambda m, p: CLOSED[k.kind][0](m, [float(x) for x in intrinsics], p), [point], names=list(names))
    i, own = np.asarray(intrinsics, float), ["__px", "__py", "__pz"]
    rows = df.withColumns({n: c.cast("double") for n, c in zip(own, point, strict=True)})
    return with_kernel(rows, own, lambda p: project(p, k, i), list(names)).drop(*own)


def matrix_of(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values of the whole lists, one row each; which rows they are): lists that are null, hold nulls or differ from the first in length are left out."""
    n = np.asarray(a.value_lengths().fill_null(-1)) if len(a) else np.zeros(0, int)
    ok = n == (n.max(initial=0))
    flat = a.flatten()
    if flat.null_count:
        whole = np.ones(len(a), bool)
        row = np.repeat(np.arange(len(a)), np.maximum(n, 0))
        whole[row[np.asarray(flat.is_null())]] = False
        ok &= whole
        flat = a.filter(pa.array(ok)).flatten()
    elif not ok.all():
        flat = a.filter(pa.array(ok)).flatten()
    return np.asarray(flat, float).reshape(int(ok.sum()), -1), np.flatnonzero(ok)


def lists_of(values: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """``values``, one row a list, at their places among n rows; null elsewhere and where a value is not finite."""
    good = np.isfinite(values).all(-1)
    mask, width = np.ones(n, bool), values.shape[-1]
    mask[at[good]] = False
    offsets = np.zeros(n + 1, np.int32)
    offsets[1:] = np.cumsum(~mask) * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[good].ravel()), mask=pa.array(mask))


def _with(df: DataFrame, source: str, model_col: str, intrinsics_col: str, out: str, kernel) -> DataFrame:
    """A kernel of points with a model each: rows of one camera go through it together."""
    names = df.columns

    def run(a: pa.Array, models: pa.Array, intrinsics: pa.Array) -> pa.Array:
        x, at = matrix_of(a)
        kinds = models.dictionary_encode()
        kind, rows, found = np.asarray(kinds.indices.fill_null(-1)), [], []
        for k, name in enumerate(kinds.dictionary.to_pylist()):
            here = np.flatnonzero(kind == k)
            i, whole = matrix_of(intrinsics.take(pa.array(here)))
            here = here[whole]
            same, camera = np.unique(i, axis=0, return_inverse=True) if len(i) and (i != i[:1]).any() else (i[:1], np.zeros(len(i), int))
            for c, one in enumerate(same):
                mine = np.flatnonzero(np.isin(at, here[camera == c], assume_unique=True))
                if len(mine):
                    rows.append(at[mine])
                    found.append(kernel(x[mine], name, one))
        got = np.concatenate(found) if found else np.zeros((0, 1))
        where = np.concatenate(rows) if rows else np.zeros(0, int)
        order = np.argsort(where, kind="stable")
        return lists_of(got[order], where[order], len(a))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.record_batch([*b.columns, run(b.column(source), b.column(model_col), b.column(intrinsics_col))], names=[*names, out])

    return df.mapInArrow(batches, df.withColumn(out, F.lit(None).cast("array<double>")).schema)


def with_projections(df: DataFrame, point: str = "p", model: str = "lensmodel", intrinsics: str = "intrinsics", out: str = "q") -> DataFrame:
    """Any model, one camera a row: rows gain the pixel (null where it can't be found).  Where all rows share a model, see ``with_pixels``."""
    return _with(df, point, model, intrinsics, out, project)


def with_unprojections(df: DataFrame, pixel: str = "q", model: str = "lensmodel", intrinsics: str = "intrinsics", out: str = "v") -> DataFrame:
    return _with(df, pixel, model, intrinsics, out, unproject)


# -- derived -----------------------------------------------------------------------------------
def knots(model: str | LensModel) -> tuple[np.ndarray, np.ndarray]:
    m = lensmodel(model)
    return tuple((np.arange(n) - (n - 1) / 2) / m.segments_per_u for n in (m.nx, m.ny))


def splined_domain(model: str | LensModel) -> np.ndarray:
    """Corners, in u, of the region where the spline is fully supported; closed."""
    m = lensmodel(model)
    edge = 1 if m.order == 3 else 0.5
    (x, y), s = knots(m), m.segments_per_u
    x0, x1, y0, y1 = x[0] + edge / s, x[-1] - edge / s, y[0] + edge / s, y[-1] - edge / s
    return np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]])


def model_resolution_deg_pixel(q: np.ndarray, model: str | LensModel, intrinsics: np.ndarray, mode: str = "mean") -> np.ndarray:
    """Degrees a pixel from the singular values of dq/dangle: mode min, max, mean or eccentricity."""
    v = unproject(q, model, intrinsics, normalize=True)
    _, dp, _ = project_with_gradients(v, model, intrinsics)
    helper = np.where(np.abs(v[..., :1]) < 0.9, [1.0, 0, 0], [0, 1.0, 0])
    a = np.cross(helper, v)
    a /= np.linalg.norm(a, axis=-1, keepdims=True)
    t = np.stack([a, np.cross(v, a)], -1)
    j = np.nan_to_num(np.einsum("...ij,...jk->...ik", dp, t))
    s = np.linalg.svd(j, compute_uv=False)
    low, high = np.degrees(1 / np.maximum(s[..., 0], 1e-6)), np.degrees(1 / np.maximum(s[..., 1], 1e-6))
    return {"min": low, "max": high, "mean": (low + high) / 2, "eccentricity": high / low}[mode]


def edge_angles(model: str | LensModel, intrinsics: np.ndarray, imagersize) -> dict[str, np.ndarray]:
    """Angles off the axis, in degrees, of the corners and of the imager's edges above and beside the centre pixel; pixels that don't unproject are left out."""
    (w, h), (cx, cy) = imagersize, intrinsics[2:4]
    sets = {"horizontal": [[0, cy], [w - 1, cy]], "vertical": [[cx, 0], [cx, h - 1]], "diagonal": [[0, 0], [0, h - 1], [w - 1, 0], [w - 1, h - 1]]}
    out = {}
    for k, q in sets.items():
        v = unproject(np.array(q, float), model, np.asarray(intrinsics, float))
        v = v[np.isfinite(v).all(-1)]
        out[k] = np.degrees(np.arctan2(np.hypot(v[:, 0], v[:, 1]), v[:, 2]))
    return out


def report_fov(model: str | LensModel, intrinsics: np.ndarray, imagersize) -> dict[str, float]:
    """Twice the mean of the edge angles across, down and to the corners."""
    return {k: float(2 * a.mean()) if len(a) else math.nan for k, a in edge_angles(model, intrinsics, imagersize).items()}


__all__ = [n for n in dir() if not n.startswith("_")]
