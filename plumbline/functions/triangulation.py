"""Two-view triangulation as formulas: rays v0 and v1 in the coordinates of camera 0, t01 the place of camera 1.

The angular methods follow Lee and Civera, "Closed-Form Optimal Two-View Triangulation Based
on Angular Errors" (2019) and "Triangulation: Why Optimize?" (2019); ``lindstrom`` follows
Lindstrom, "Triangulation Made Easy" (2010).  Rays that diverge give the point (0, 0, 0).
"""

from __future__ import annotations

from plumbline.functions.pose import add, cross, dot, norm, rotate_point_R, scale, sub

PARALLEL = 1e-10


def _zero_unless(m, ok, p):
    return [m.where(ok, x, m.num(0)) for x in p]


def geometric(m, v0, v1, t):
    """The midpoint of the shortest segment between the rays."""
    a, b, c = dot(v0, v0), dot(v1, v1), dot(v0, v1)
    d, e = dot(v0, t), dot(v1, t)
    den = a * b - c * c
    k0 = m.div(b * d - c * e, den)
    k1 = m.div(c * d - a * e, den)
    p = scale(add(add(scale(v0, k0), scale(v1, k1)), t), 0.5)
    ok = m.both(m.both(k0 > 0, k1 > 0), m.abs(den) > PARALLEL)
    return _zero_unless(m, ok, p)


def intersect(m, v0, v1, t):
    """The point of two rays that meet, seen along v0."""
    n = cross(v0, v1)
    n2 = dot(n, n)
    k0 = m.div(dot(cross(t, v1), n), n2)
    k1 = m.div(dot(cross(t, v0), n), n2)
    return _zero_unless(m, m.both(k0 > 0, k1 > 0), scale(v0, k0))


def _unit(m, v):
    n = norm(m, v)
    return [m.div(x, n) for x in v]


def _into_plane(m, v, n):
    k = m.div(dot(v, n), dot(n, n))
    return sub(v, scale(n, k))


def leecivera_l1(m, v0, v1, t):
    """Least sum of angles: only the ray that is nearer to the baseline's direction is moved."""
    a, b = _unit(m, v0), _unit(m, v1)
    da, db = dot(a, t), dot(b, t)
    move_a = da * da > db * db
    na, nb = cross(b, t), cross(a, t)
    p = _into_plane(m, a, na)
    q = _into_plane(m, b, nb)
    a2 = [m.where(move_a, x, y) for x, y in zip(p, a, strict=True)]
    b2 = [m.where(move_a, y, x) for x, y in zip(q, b, strict=True)]
    return intersect(m, a2, b2, t)


def leecivera_linf(m, v0, v1, t):
    """Least greatest angle: both rays turn equally into a common plane through the baseline."""
    a, b = _unit(m, v0), _unit(m, v1)
    n0, n1 = cross(add(a, b), t), cross(sub(a, b), t)
    first = dot(n0, n0) > dot(n1, n1)
    n = [m.where(first, x, y) for x, y in zip(n0, n1, strict=True)]
    return intersect(m, _into_plane(m, a, n), _into_plane(m, b, n), t)


def _depths(m, v0, v1, t):
    n = norm(m, cross(v0, v1))
    return m.div(norm(m, cross(v1, t)), n), m.div(norm(m, cross(v0, t)), n)


def widening(m, l0, v0, l1, v1, t):
    """By how much turning round the first ray, the second, or both brings the two estimates of the point apart (squared)."""

    def gap(s0, s1):
        d = sub(add(scale(v1, l1 * s1), t), scale(v0, l0 * s0))
        return dot(d, d)

    g = gap(1.0, 1.0)
    return [gap(-1.0, 1.0) - g, gap(1.0, -1.0) - g, gap(-1.0, -1.0) - g]


def convergent(m, l0, v0, l1, v1, t):
    """Whether any such turn would bring them further apart."""
    a, b, c = widening(m, l0, v0, l1, v1, t)
    return m.both(m.both(a > 0, b > 0), c > 0)


def leecivera_mid2(m, v0, v1, t):
    """The midpoint at the depths of the law of sines."""
    l0, l1 = _depths(m, v0, v1, t)
    p = scale(add(add(scale(v0, l0), scale(v1, l1)), t), 0.5)
    return _zero_unless(m, convergent(m, l0, v0, l1, v1, t), p)


def leecivera_wmid2(m, v0, v1, t):
    """The same, weighted by inverse depth."""
    a, b = _unit(m, v0), _unit(m, v1)
    l0, l1 = _depths(m, a, b, t)
    p = add(scale(add(a, b), l0 * l1), scale(t, l0))
    p = [m.div(x, l0 + l1) for x in p]
    return _zero_unless(m, convergent(m, l0, a, l1, b, t), p)


def is_convergent(m, v0, v1, t):
    l0, l1 = _depths(m, v0, v1, t)
    return convergent(m, l0, v0, l1, v1, t)


def lindstrom(m, v0, v1, Rt01):
    """Least reprojection error on the image planes; v1 in camera 1's own coordinates."""
    R, t = Rt01[:9], Rt01[9:]
    x = [m.div(v0[0], v0[2]), m.div(v0[1], v0[2]), m.num(1)]
    y = [m.div(v1[0], v1[2]), m.div(v1[1], v1[2]), m.num(1)]
    # essential matrix: x' E y = 0 with E = [t]x R
    col = [cross(t, [R[j], R[3 + j], R[6 + j]]) for j in range(3)]
    E = [[col[j][i] for j in range(3)] for i in range(3)]
    n0 = [dot(E[0], y), dot(E[1], y)]
    n1 = [dot([E[i][0] for i in range(3)], x), dot([E[i][1] for i in range(3)], x)]

    def E2(a, b):
        return a[0] * (E[0][0] * b[0] + E[0][1] * b[1]) + a[1] * (E[1][0] * b[0] + E[1][1] * b[1])

    a = E2(n0, n1)
    b = 0.5 * (dot(n0, n0) + dot(n1, n1))
    c = dot(x, [dot(E[i], y) for i in range(3)])
    d = m.sqrt(b * b - a * c)
    k = m.div(c, b + d)
    d0, d1 = scale(n0, k), scale(n1, k)
    n0 = [n0[0] - (E[0][0] * d1[0] + E[0][1] * d1[1]), n0[1] - (E[1][0] * d1[0] + E[1][1] * d1[1])]
    n1 = [n1[0] - (E[0][0] * d0[0] + E[1][0] * d0[1]), n1[1] - (E[0][1] * d0[0] + E[1][1] * d0[1])]
    # the second step, from the tangents at the first
    d0 = scale(n0, m.div(dot(d0, n0), dot(n0, n0)))
    d1 = scale(n1, m.div(dot(d1, n1), dot(n1, n1)))
    p = [x[0] - d0[0], x[1] - d0[1], x[2]]
    q = rotate_point_R(m, R, [y[0] - d1[0], y[1] - d1[1], y[2]])
    return intersect(m, p, q, t)


def angle_small(m, a, b):
    """The angle between two vectors, by the chord of their cosine: fit for small angles."""
    c = m.div(dot(a, b), norm(m, a) * norm(m, b))
    c = m.where(c > 1, m.num(1), c)
    return m.sqrt(2 - 2 * c)


KNEE = 3.0


def smooth_step(m, x, knee: float = KNEE):
    """0 below 0, 1 beyond the knee, and between them two parabolas that meet half way."""
    u = x * (1 / knee)
    rest = 1 - u
    between = m.where(u < 0.5, 2 * u * u, 1 - 2 * rest * rest)
    return m.where(u <= 0, m.num(0), m.where(u >= 1, m.num(1), between))


def reprojection_angle(m, v0, v1, t):
    """Twice the angle between a ray and the triangulated midpoint.

    Rays that diverge are also pulled towards their vanishing point: the angle between them is added
    as far as turning either or both would bring them together.
    """
    l0, l1 = _depths(m, v0, v1, t)
    p = scale(add(add(scale(v0, l0), scale(v1, l1)), t), 0.5)
    steps = [smooth_step(m, -w) for w in widening(m, l0, v0, l1, v1, t)]
    return angle_small(m, v0, p) * 2.0 + angle_small(m, v0, v1) * (steps[0] + steps[1] + steps[2])


METHODS = {"geometric": geometric, "leecivera-l1": leecivera_l1, "leecivera-linf": leecivera_linf, "leecivera-mid2": leecivera_mid2, "leecivera-wmid2": leecivera_wmid2}
