"""Pose algebra as formulas over scalars.

A rotation is R (9 numbers, rows first) or r (3, axis times angle); a pose is Rt (12: R,
then t), rt (6: r, then t) or qt (7: unit quaternion w, x, y, z, then t).  ``T_ab`` maps
points of b to a.  Small angles use series, half turns go through quaternions, so no branch
loses digits.
"""

from __future__ import annotations

IDENTITY_R = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
IDENTITY_r = [0.0] * 3
IDENTITY_Rt = [*IDENTITY_R, 0.0, 0.0, 0.0]
IDENTITY_rt = [0.0] * 6
SMALL = 1e-10  # of a squared angle


def identity_R(m):
    return [m.num(x) for x in IDENTITY_R]


def identity_r(m):
    return [m.num(x) for x in IDENTITY_r]


def identity_Rt(m):
    return [m.num(x) for x in IDENTITY_Rt]


def identity_rt(m):
    return [m.num(x) for x in IDENTITY_rt]


def dot(a, b):
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        total = total + x * y
    return total


def cross(a, b):
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def add(a, b):
    return [x + y for x, y in zip(a, b, strict=True)]


def sub(a, b):
    return [x - y for x, y in zip(a, b, strict=True)]


def scale(a, s):
    return [x * s for x in a]


def norm(m, a):
    return m.sqrt(dot(a, a))


def skew_symmetric(m, a):
    z = m.num(0)
    return [z, -a[2], a[1], a[2], z, -a[0], -a[1], a[0], z]


def _angle_terms(m, r):
    """cos, sin / angle, (1 - cos) / angle^2 of a rotation vector."""
    th2 = dot(r, r)
    small = th2 < SMALL
    safe = m.where(small, m.num(1), th2)
    th = m.sqrt(safe)
    c = m.where(small, 1 - th2 * 0.5, m.cos(th))
    s = m.where(small, 1 - th2 * (1 / 6), m.div(m.sin(th), th))
    k = m.where(small, 0.5 - th2 * (1 / 24), m.div(1 - m.cos(th), safe))
    return c, s, k


def R_from_r(m, r):
    c, s, k = _angle_terms(m, r)
    x, y, z = r
    return [c + k * x * x, k * x * y - s * z, k * x * z + s * y, k * x * y + s * z, c + k * y * y, k * y * z - s * x, k * x * z - s * y, k * y * z + s * x, c + k * z * z]


def invert_R(m, R):
    return [R[3 * j + i] for i in range(3) for j in range(3)]


def quat_from_R(m, R):
    """Unit quaternion (w, x, y, z), w not negative; the largest component is found first."""
    t = R[0] + R[4] + R[8]
    n = {"w": 1 + t, "x": 1 + R[0] - R[4] - R[8], "y": 1 - R[0] + R[4] - R[8], "z": 1 - R[0] - R[4] + R[8]}
    a, b, c = R[7] - R[5], R[2] - R[6], R[3] - R[1]  # 4wx, 4wy, 4wz
    d, e, f = R[1] + R[3], R[2] + R[6], R[5] + R[7]  # 4xy, 4xz, 4yz
    rows = {"w": [n["w"], a, b, c], "x": [a, n["x"], d, e], "y": [b, d, n["y"], f], "z": [c, e, f, n["z"]]}
    q = rows["w"]
    # the trace decides for w; else the largest diagonal
    xy = m.both(R[0] >= R[4], R[0] >= R[8])
    yy = R[4] >= R[8]
    out = []
    for i in range(4):
        v = m.where(t > 0, q[i], m.where(xy, rows["x"][i], m.where(yy, rows["y"][i], rows["z"][i])))
        out.append(v)
    size = norm(m, out)
    size = m.where(out[0] < 0, -size, size)
    return [m.div(x, size) for x in out]


def R_from_quat(m, q):
    w, x, y, z = q
    return [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]


def r_from_quat(m, q):
    w, v = q[0], q[1:]
    n2 = dot(v, v)
    small = n2 < SMALL
    n = m.sqrt(m.where(small, m.num(1), n2))
    # the angle over the length of the vector part, to either side of a half turn
    k = m.where(small, m.where(w < 0, m.num(-2), m.num(2)) * (1 + n2 * (1 / 6)), m.div(2 * m.atan2(m.where(w < 0, -n, n), m.abs(w)), n))
    return [x * k for x in v]


def quat_from_r(m, r):
    h = scale(r, 0.5)
    c, s, _ = _angle_terms(m, h)
    return [c, *scale(h, s)]


def r_from_R(m, R):
    return r_from_quat(m, quat_from_R(m, R))


def quat_multiply(a, b):
    w = a[0] * b[0] - dot(a[1:], b[1:])
    v = add(add(scale(b[1:], a[0]), scale(a[1:], b[0])), cross(a[1:], b[1:]))
    return [w, *v]


def rotate_point_R(m, R, x):
    return [dot(R[3 * i : 3 * i + 3], x) for i in range(3)]


def rotate_point_r(m, r, x):
    c, s, k = _angle_terms(m, r)
    rx, along = cross(r, x), dot(r, x)
    return [c * x[i] + s * rx[i] + k * along * r[i] for i in range(3)]


def transform_point_Rt(m, Rt, x):
    return add(rotate_point_R(m, Rt[:9], x), Rt[9:])


def transform_point_rt(m, rt, x):
    return add(rotate_point_r(m, rt[:3], x), rt[3:])


def rotate_point_R_inverted(m, R, x):
    return rotate_point_R(m, invert_R(m, R), x)


def rotate_point_r_inverted(m, r, x):
    return rotate_point_r(m, [-v for v in r], x)


def transform_point_Rt_inverted(m, Rt, x):
    return rotate_point_R_inverted(m, Rt[:9], sub(x, Rt[9:]))


def transform_point_rt_inverted(m, rt, x):
    return rotate_point_r_inverted(m, rt[:3], sub(x, rt[3:]))


def multiply_R(m, A, B):
    return [dot(A[3 * i : 3 * i + 3], [B[j], B[3 + j], B[6 + j]]) for i in range(3) for j in range(3)]


def Rt_from_rt(m, rt):
    return [*R_from_r(m, rt[:3]), *rt[3:]]


def rt_from_Rt(m, Rt):
    return [*r_from_R(m, Rt[:9]), *Rt[9:]]


def qt_from_Rt(m, Rt):
    return [*quat_from_R(m, Rt[:9]), *Rt[9:]]


def Rt_from_qt(m, qt):
    return [*R_from_quat(m, qt[:4]), *qt[4:]]


def invert_Rt(m, Rt):
    R = invert_R(m, Rt[:9])
    return [*R, *[-x for x in rotate_point_R(m, R, Rt[9:])]]


def invert_rt(m, rt):
    r = [-x for x in rt[:3]]
    return [*r, *[-x for x in rotate_point_r(m, r, rt[3:])]]


def compose_r(m, a, b):
    return r_from_quat(m, quat_multiply(quat_from_r(m, a), quat_from_r(m, b)))


def compose_Rt(m, a, b):
    return [*multiply_R(m, a[:9], b[:9]), *add(rotate_point_R(m, a[:9], b[9:]), a[9:])]


def compose_rt(m, a, b):
    return [*compose_r(m, a[:3], b[:3]), *add(rotate_point_r(m, a[:3], b[3:]), a[3:])]


def compose_r_inverted(m, a, b, inverted0: bool = False, inverted1: bool = False):
    return compose_r(m, [-x for x in a] if inverted0 else a, [-x for x in b] if inverted1 else b)


def compose_rt_inverted(m, a, b, inverted0: bool = False, inverted1: bool = False):
    return compose_rt(m, invert_rt(m, a) if inverted0 else a, invert_rt(m, b) if inverted1 else b)


def compose_Rt_inverted(m, a, b, inverted0: bool = False, inverted1: bool = False):
    return compose_Rt(m, invert_Rt(m, a) if inverted0 else a, invert_Rt(m, b) if inverted1 else b)


def R_aligned_to_vector(m, v):
    """A rotation that takes v to the z axis: its rows are the x axis (y where v is near x) less its part along v, the third perpendicular, and v."""
    z = scale(v, m.div(1.0, norm(m, v)))
    by_x = m.abs(z[0]) < 0.9
    start = [m.where(by_x, m.num(1), m.num(0)), m.where(by_x, m.num(0), m.num(1)), m.num(0)]
    flat = sub(start, scale(z, dot(start, z)))
    x = scale(flat, m.div(1.0, norm(m, flat)))
    return [*x, *cross(z, x), *z]


def apply_homography(m, H, v):
    h = [*v, m.num(1)]
    w = dot(H[6:9], h)
    return [m.div(dot(H[0:3], h), w), m.div(dot(H[3:6], h), w)]
