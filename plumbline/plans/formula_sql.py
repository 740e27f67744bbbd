"""SQL for the formula queries, written from each formula's definition and independent of the formulas' own code.

Rotations use Rodrigues' matrix or half angles of the given vectors, lenses and stereo their
angles, triangulation the vector identities of the published methods.  ``V`` names the inputs.
"""

from __future__ import annotations


def _e(i: int, k: float = 1.0, c: float = 0.0) -> str:
    return f"(CAST(embedding[{i + 1}] AS DOUBLE) * {k!r} + {c!r})"


def _xyz(name: str, first: int, k: float = 1.0) -> dict[str, str]:
    return {f"{name}{a}": _e(first + i, k) for i, a in enumerate("xyz")}


_INPUTS = {
    **_xyz("a", 0, 6.0),  # rotation vectors a and bb, translations s and t, a point p
    **_xyz("s", 3),
    **_xyz("p", 6),
    **_xyz("bb", 9, 6.0),
    **_xyz("t", 12),
    **{"hx": _e(6), "hy": _e(7), "hz": _e(8, 0.5, 2.0)},  # a point ahead of the camera
    **{"qx": _e(6, 900.0, 1000.0), "qy": _e(7, 900.0, 800.0)},
    **{"fx": _e(20, 20.0, 1500.0), "fy": _e(21, 20.0, 1480.0), "cx": _e(22, 10.0, 1000.0), "cy": _e(23, 10.0, 800.0)},
    **{f"k{i}": _e(24 + i, 0.05) for i in range(12)},
    **{"fx0": _e(6, 0.3), "fy0": _e(7, 0.3), "fz0": _e(8, 0.1, 1.0)},  # two rays and the baseline
    **{"gx": _e(9, 0.3, -0.1), "gy": _e(10, 0.3), "gz": _e(11, 0.1, 1.0)},
    **{"ux": _e(12, 0.1, 1.0), "uy": _e(13, 0.1), "uz": _e(14, 0.1)},
    **_xyz("ro", 15, 0.2),
    "disparity": _e(9, 200.0, 30.0),
    "value": _e(0),
    **{f"m{i}": _e(9 + i, 0.1, 1.0 if i % 4 == 0 else 0.0) for i in range(9)},
}


def vec(name: str) -> list[str]:
    return ["fx0", "fy0", "fz0"] if name == "f" else [f"{name}{a}" for a in "xyz"]


def dot(a: list[str], b: list[str]) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"


def cross(a: list[str], b: list[str]) -> list[str]:
    return [f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]


def named(name: str, parts: list[str]) -> dict[str, str]:
    return {f"{name}{a}": x for a, x in zip("xyz", parts, strict=True)}


def select(outputs: list[str], *stages: dict[str, str]) -> str:
    """The inputs, then each stage's columns from those before it, then the rounded outputs."""
    sql = f"SELECT vec_id, {', '.join(f'{x} AS {n}' for n, x in _INPUTS.items())} FROM embeddings"
    for i, stage in enumerate(stages):
        sql = f"SELECT *, {', '.join(f'{x} AS {n}' for n, x in stage.items())} FROM ({sql}) s{i}"
    return f"SELECT vec_id, {', '.join(f'CAST(round({x}, 6) + 0.0 AS DOUBLE) AS o{i}' for i, x in enumerate(outputs))} FROM ({sql}) o"


# -- rotations: a vector n = angle * axis ------------------------------------------------------
def axis(n: str) -> list[dict[str, str]]:
    """Stages: the angle ``n_angle`` and the unit axis ``n_0`` to ``n_2``."""
    x, y, z = vec(n)
    return [{f"{n}_angle": f"sqrt({x} * {x} + {y} * {y} + {z} * {z})"}, {f"{n}_{i}": f"{v} / {n}_angle" for i, v in enumerate((x, y, z))}]


def matrix(n: str) -> list[str]:
    """Rodrigues' matrix, rows first."""
    k = [f"{n}_{i}" for i in range(3)]
    skew = ["0", f"-{k[2]}", k[1], k[2], "0", f"-{k[0]}", f"-{k[1]}", k[0], "0"]
    return [f"({'1' if i == j else '0'} * cos({n}_angle) + (1 - cos({n}_angle)) * {k[i]} * {k[j]} + sin({n}_angle) * ({skew[3 * i + j]}))" for i in range(3) for j in range(3)]


def transposed(m: list[str]) -> list[str]:
    return [m[3 * j + i] for i in range(3) for j in range(3)]


def apply(m: list[str], v: list[str]) -> list[str]:
    return [dot(m[3 * i : 3 * i + 3], v) for i in range(3)]


def product(a: list[str], b: list[str]) -> list[str]:
    return [dot(a[3 * i : 3 * i + 3], [b[j], b[3 + j], b[6 + j]]) for i in range(3) for j in range(3)]


def plus(a: list[str], b: list[str], sign: str = "+") -> list[str]:
    return [f"({x} {sign} {y})" for x, y in zip(a, b, strict=True)]


A, B, S, T, P = vec("a"), vec("bb"), vec("s"), vec("t"), vec("p")
RA, RB = matrix("a"), matrix("bb")
#: A vector's rotation by an angle from -pi to pi.
SHORTEST = [f"{x} * (a_angle - 2 * pi() * round(a_angle / (2 * pi()))) / a_angle" for x in A]
#: Its unit quaternion, the first part not negative.
QUATERNION = ["abs(cos(a_angle / 2))", *[f"a_{i} * sin(a_angle / 2) * (CASE WHEN cos(a_angle / 2) < 0 THEN -1 ELSE 1 END)" for i in range(3)]]


def composed() -> list[dict[str, str]]:
    """Stages: the rotation vector ``r`` of a after b, by half angles."""
    k, j = [f"a_{i}" for i in range(3)], [f"bb_{i}" for i in range(3)]
    ca, sa, cb, sb = "cos(a_angle / 2)", "sin(a_angle / 2)", "cos(bb_angle / 2)", "sin(bb_angle / 2)"
    across = cross(k, j)
    half = {"qw": f"{ca} * {cb} - {sa} * {sb} * {dot(k, j)}", **{f"q{i}": f"{sa} * {cb} * {k[i]} + {ca} * {sb} * {j[i]} + {sa} * {sb} * {across[i]}" for i in range(3)}}
    length = {"qn": "sqrt(q0 * q0 + q1 * q1 + q2 * q2)"}
    turn = {"turn": "2 * atan2(qn, qw) - (CASE WHEN qw < 0 THEN 2 * pi() ELSE 0 END)"}
    return [*axis("a"), *axis("bb"), half, length, turn, {f"r{x}": f"q{i} / qn * turn" for i, x in enumerate("xyz")}]


ALIGNED = {
    "zx": "px / pn",
    "zy": "py / pn",
    "zz": "pz / pn",
}

# -- lenses ------------------------------------------------------------------------------------
H = vec("h")
OFF = {"off": "atan2(sqrt(hx * hx + hy * hy), hz)", "around": "sqrt(hx * hx + hy * hy)"}


def pixel(x: str, y: str) -> list[str]:
    return [f"fx * ({x}) + cx", f"fy * ({y}) + cy"]


def opencv(n: int) -> str:
    """Radial k0 k1 k4 over 1 + k5 k6 k7, tangential k2 k3, thin prism k8 to k11."""
    up = "1 + k0 * r2 + k1 * r2 * r2" + (" + k4 * r2 * r2 * r2" if n > 4 else "")
    down = "1 + k5 * r2 + k6 * r2 * r2 + k7 * r2 * r2 * r2" if n > 5 else "1"
    prism = (" + k8 * r2 + k9 * r2 * r2", " + k10 * r2 + k11 * r2 * r2") if n > 8 else ("", "")
    x = "nx * radial + 2 * k2 * nx * ny + k3 * (r2 + 2 * nx * nx)" + prism[0]
    y = "ny * radial + k2 * (r2 + 2 * ny * ny) + 2 * k3 * nx * ny" + prism[1]
    return select(pixel(x, y), {"nx": "hx / hz", "ny": "hy / hz"}, {"r2": "nx * nx + ny * ny"}, {"radial": f"({up}) / ({down})"})


def cahvor() -> str:
    o = ["sin(k0) * cos(k1)", "sin(k1)", "cos(k0) * cos(k1)"]
    moved = {f"v{a}": f"h{a} + (k2 + k3 * tau + k4 * tau * tau) * l{a}" for a in "xyz"}
    return select(
        pixel("vx / vz", "vy / vz"),
        named("o", o),
        {"zeta": dot(H, vec("o"))},
        named("l", [f"h{a} - zeta * o{a}" for a in "xyz"]),
        {"tau": "(lx * lx + ly * ly + lz * lz) / (zeta * zeta)"},
        moved,
    )


# -- triangulation: rays f and g from (0, 0, 0) and u ------------------------------------------
F, G, U = vec("f"), vec("g"), vec("u")


def unit(name: str, v: list[str]) -> list[dict[str, str]]:
    return [{f"{name}_n": f"sqrt({dot(v, v)})"}, named(name, [f"{x} / {name}_n" for x in v])]


def meeting(f: list[str], g: list[str]) -> list[dict[str, str]]:
    """Stages: the depths d0 and d1 of the nearest points of two rays, by triple products."""
    return [named("n", cross(f, g)), {"n2": dot(vec("n"), vec("n"))}, {"d0": f"{dot(cross(U, g), vec('n'))} / n2", "d1": f"{dot(cross(U, f), vec('n'))} / n2"}]


def where(condition: str, parts: list[str]) -> list[str]:
    return [f"CASE WHEN {condition} THEN {x} ELSE 0 END" for x in parts]


def flattened(name: str, v: list[str], normal: list[str]) -> list[str]:
    """A vector less its part along a normal."""
    return [f"{x} - {dot(v, normal)} / {dot(normal, normal)} * {n}" for x, n in zip(v, normal, strict=True)]


def sines(f: list[str], g: list[str]) -> list[dict[str, str]]:
    """Stages: depths by the law of sines, the squared gap of the two points, and by how much a turn of either ray or both widens it."""

    def gap(i: str, j: str) -> str:
        d = [f"({j}d1 * {y} + {w} - ({i}d0) * {x})" for x, y, w in zip(f, g, U, strict=True)]
        return dot(d, d)

    size = lambda v: f"sqrt({dot(v, v)})"
    return [
        named("n", cross(f, g)),
        {"d0": f"{size(cross(g, U))} / {size(vec('n'))}", "d1": f"{size(cross(f, U))} / {size(vec('n'))}"},
        {"gap": gap("", "")},
        {"wider0": f"{gap('-', '')} - gap", "wider1": f"{gap('', '-')} - gap", "wider01": f"{gap('-', '-')} - gap"},
    ]


CONVERGENT = "wider0 > 0 AND wider1 > 0 AND wider01 > 0"
MIDDLE = [f"(d0 * {x} + d1 * {y} + {w}) / 2" for x, y, w in zip(F, G, U, strict=True)]


def lee_l1() -> str:
    i, j = vec("i"), vec("j")
    nearer = {"first": f"abs({dot(i, U)}) > abs({dot(j, U)})"}
    turned = {**named("v", [f"CASE WHEN first THEN {x} ELSE {y} END" for x, y in zip(flattened("v", i, cross(j, U)), i, strict=True)]), **named("w", [f"CASE WHEN first THEN {y} ELSE {x} END" for x, y in zip(flattened("w", j, cross(i, U)), j, strict=True)])}
    return select(where("d0 > 0 AND d1 > 0", [f"d0 * v{a}" for a in "xyz"]), *unit("i", F), *unit("j", G), nearer, turned, *meeting(vec("v"), vec("w")))


def lee_linf() -> str:
    i, j = vec("i"), vec("j")
    planes = {**named("y", cross(plus(i, j), U)), **named("z", cross(plus(i, j, "-"), U))}
    first = {"first": f"{dot(vec('y'), vec('y'))} > {dot(vec('z'), vec('z'))}"}
    normal = named("w", [f"CASE WHEN first THEN y{a} ELSE z{a} END" for a in "xyz"])
    turned = {**named("v", flattened("v", i, vec("w"))), **named("r", flattened("r", j, vec("w")))}
    return select(where("d0 > 0 AND d1 > 0", [f"d0 * v{a}" for a in "xyz"]), *unit("i", F), *unit("j", G), planes, first, normal, turned, *meeting(vec("v"), vec("r")))


def lindstrom() -> str:
    """Two steps along the epipolar gradients, with E = [u] R; the second ray is in its own camera."""
    R = matrix("ro")
    E = {}
    for j in range(3):
        E |= {f"e{i}{j}": x for i, x in enumerate(cross(U, [R[j], R[3 + j], R[6 + j]]))}
    e = lambda i, j: f"e{i}{j}"
    image = {"x0": "fx0 / fz0", "x1": "fy0 / fz0", "y0": "gx / gz", "y1": "gy / gz"}
    lines = {"l0": "e00 * y0 + e01 * y1 + e02", "l1": "e10 * y0 + e11 * y1 + e12", "l2": "e20 * y0 + e21 * y1 + e22", "r0": "e00 * x0 + e10 * x1 + e20", "r1": "e01 * x0 + e11 * x1 + e21"}
    step = {"qa": "l0 * (e00 * r0 + e01 * r1) + l1 * (e10 * r0 + e11 * r1)", "qb": "(l0 * l0 + l1 * l1 + r0 * r0 + r1 * r1) / 2", "qc": "x0 * l0 + x1 * l1 + l2"}
    lam = {"lam": "qc / (qb + sqrt(qb * qb - qa * qc))"}
    again = {"ll0": f"l0 - lam * ({e(0, 0)} * r0 + {e(0, 1)} * r1)", "ll1": f"l1 - lam * ({e(1, 0)} * r0 + {e(1, 1)} * r1)", "rr0": f"r0 - lam * ({e(0, 0)} * l0 + {e(1, 0)} * l1)", "rr1": f"r1 - lam * ({e(0, 1)} * l0 + {e(1, 1)} * l1)"}
    scale = {"sl": "lam * (l0 * ll0 + l1 * ll1) / (ll0 * ll0 + ll1 * ll1)", "sr": "lam * (r0 * rr0 + r1 * rr1) / (rr0 * rr0 + rr1 * rr1)"}
    mended = {"vx": "x0 - sl * ll0", "vy": "x1 - sl * ll1", "vz": "CAST(1 AS DOUBLE)", "ox": "y0 - sr * rr0", "oy": "y1 - sr * rr1", "oz": "CAST(1 AS DOUBLE)"}
    turned = named("w", apply(R, vec("o")))
    return select(where("d0 > 0 AND d1 > 0", [f"d0 * v{a}" for a in "xyz"]), *axis("ro"), E, image, lines, step, lam, again, scale, mended, turned, *meeting(vec("v"), vec("w")))


def ramp(x: str) -> str:
    """0 below 0, 1 above 3, and between them two parabolas that meet at 1.5."""
    return f"(CASE WHEN {x} <= 0 THEN 0 WHEN {x} >= 3 THEN 1 WHEN {x} < 1.5 THEN 2 * ({x} / 3) * ({x} / 3) ELSE 1 - 2 * (1 - {x} / 3) * (1 - {x} / 3) END)"


def chord(a: list[str], b: list[str]) -> str:
    """The small-angle measure of the angle between two vectors: the chord of their directions."""
    return f"sqrt(2 - 2 * least(1, {dot(a, b)} / sqrt({dot(a, a)} * {dot(b, b)})))"


IMAGE_X, IMAGE_Y = "(qx - cx) / fx", "(qy - cy) / fy"
VISIBLE = "disparity > 0 AND disparity >= 1 AND disparity <= 80"
LATLON_RANGE = f"0.5 * cos({IMAGE_X} - disparity / fx) / sin(disparity / fx)"
LIMITS = "least(1, greatest(0, (value + 0.2) / 0.4))"

SQL: dict[str, str] = {
    "identity_R": select(list("100010001")),
    "identity_r": select(["0"] * 3),
    "identity_Rt": select([*"100010001", *["0"] * 3]),
    "identity_rt": select(["0"] * 6),
    "R_from_r": select(RA, *axis("a")),
    "r_from_R": select(SHORTEST, *axis("a")),
    "invert_R": select(transposed(RA), *axis("a")),
    "rt_from_Rt": select([*SHORTEST, *S], *axis("a")),
    "Rt_from_rt": select([*RA, *S], *axis("a")),
    "invert_Rt": select([*transposed(RA), *[f"-{x}" for x in apply(transposed(RA), S)]], *axis("a")),
    "invert_rt": select([*[f"-{x}" for x in A], *[f"-{x}" for x in apply(transposed(RA), S)]], *axis("a")),
    "compose_Rt": select([*product(RA, RB), *plus(apply(RA, T), S)], *axis("a"), *axis("bb")),
    "compose_r": select(vec("r"), *composed()),
    "compose_rt": select([*vec("r"), *plus(apply(RA, T), S)], *composed()),
    "rotate_point_R": select(apply(RA, P), *axis("a")),
    "rotate_point_r": select(apply(RA, P), *axis("a")),
    "rotate_point_R_inverted": select(apply(transposed(RA), P), *axis("a")),
    "rotate_point_r_inverted": select(apply(transposed(RA), P), *axis("a")),
    "transform_point_Rt": select(plus(apply(RA, P), S), *axis("a")),
    "transform_point_rt": select(plus(apply(RA, P), S), *axis("a")),
    "transform_point_Rt_inverted": select(apply(transposed(RA), plus(P, S, "-")), *axis("a")),
    "transform_point_rt_inverted": select(apply(transposed(RA), plus(P, S, "-")), *axis("a")),
    "quat_from_R": select(QUATERNION, *axis("a")),
    "R_from_quat": select(RA, *axis("a")),
    "qt_from_Rt": select([*QUATERNION, *S], *axis("a")),
    "Rt_from_qt": select([*RA, *S], *axis("a")),
    "skew_symmetric": select(["0", "-pz", "py", "pz", "0", "-px", "-py", "px", "0"]),
    # the first axis is x, or y where the vector is near x, less its part along the vector
    "R_aligned_to_vector": select(
        [
            *[f"CASE WHEN near THEN {x} ELSE {y} END" for x, y in zip(("-zx * zy / sqrt(1 - zy * zy)", "sqrt(1 - zy * zy)", "-zz * zy / sqrt(1 - zy * zy)"), ("sqrt(1 - zx * zx)", "-zy * zx / sqrt(1 - zx * zx)", "-zz * zx / sqrt(1 - zx * zx)"), strict=True)],
            *[f"CASE WHEN near THEN {x} ELSE {y} END" for x, y in zip(("-zz / sqrt(1 - zy * zy)", "0", "zx / sqrt(1 - zy * zy)"), ("0", "zz / sqrt(1 - zx * zx)", "-zy / sqrt(1 - zx * zx)"), strict=True)],
            "zx",
            "zy",
            "zz",
        ],
        {"pn": "sqrt(px * px + py * py + pz * pz)"},
        ALIGNED,
        {"near": "abs(zx) >= 0.9"},
    ),
    "multiply_R": select([x for b in (RB, transposed(RB)) for a in (RA, transposed(RA)) for x in product(a, b)], *axis("a"), *axis("bb")),
    "apply_homography": select(["(m0 * px + m1 * py + m2) / (m6 * px + m7 * py + m8)", "(m3 * px + m4 * py + m5) / (m6 * px + m7 * py + m8)"]),
    "project_pinhole": select(pixel("hx / hz", "hy / hz")),
    "unproject_pinhole": select([IMAGE_X, IMAGE_Y, "1"]),
    "project_stereographic": select(pixel("2 * tan(off / 2) * hx / around", "2 * tan(off / 2) * hy / around"), OFF),
    "unproject_stereographic": select([IMAGE_X, IMAGE_Y, f"1 - (power({IMAGE_X}, 2) + power({IMAGE_Y}, 2)) / 4"]),
    "project_lonlat": select(pixel("atan2(px, pz)", "atan2(py, sqrt(px * px + pz * pz))")),
    "unproject_lonlat": select([f"cos({IMAGE_Y}) * sin({IMAGE_X})", f"sin({IMAGE_Y})", f"cos({IMAGE_Y}) * cos({IMAGE_X})"]),
    "project_latlon": select(pixel("atan2(px, sqrt(py * py + pz * pz))", "atan2(py, pz)")),
    "unproject_latlon": select([f"sin({IMAGE_X})", f"cos({IMAGE_X}) * sin({IMAGE_Y})", f"cos({IMAGE_X}) * cos({IMAGE_Y})"]),
    **{f"project_opencv{n}": opencv(n) for n in (4, 5, 8, 12)},
    "project_cahvor": cahvor(),
    "triangulate_geometric": select(where("d0 > 0 AND d1 > 0 AND abs(n2) > 1e-10", MIDDLE), *meeting(F, G)),
    "triangulate_leecivera_l1": lee_l1(),
    "triangulate_leecivera_linf": lee_linf(),
    "triangulate_leecivera_mid2": select(where(CONVERGENT, MIDDLE), *sines(F, G)),
    "triangulate_leecivera_wmid2": select(where(CONVERGENT, [f"(d0 * d1 * ({x} + {y}) + d0 * {w}) / (d0 + d1)" for x, y, w in zip(vec("i"), vec("j"), U, strict=True)]), *unit("i", F), *unit("j", G), *sines(vec("i"), vec("j"))),
    "triangulate_lindstrom": lindstrom(),
    "triangulated_angle": select([f"2 * {chord(F, vec('v'))} + {chord(F, G)} * ({ramp('(-wider0)')} + {ramp('(-wider1)')} + {ramp('(-wider01)')})"], *sines(F, G), named("v", MIDDLE)),
    # a point at depth z has the disparity 0.5 / z, as a share of the focal length
    "stereo_range_pinhole": select([f"CASE WHEN {VISIBLE} THEN 0.5 * fx / disparity * sqrt(1 + power({IMAGE_X}, 2) + power({IMAGE_Y}, 2)) ELSE 0 END"]),
    "stereo_range_latlon": select([f"CASE WHEN {VISIBLE} THEN {LATLON_RANGE} ELSE 0 END"]),
    "stereo_unproject": select([f"CASE WHEN disparity > 0 THEN ({x}) * {LATLON_RANGE} ELSE 0 END" for x in (f"sin({IMAGE_X})", f"cos({IMAGE_X}) * sin({IMAGE_Y})", f"cos({IMAGE_X}) * cos({IMAGE_Y})")]),
    "color_map": select([f"floor(0.5 + 255 * {x})" for x in (f"sqrt({LIMITS})", f"power({LIMITS}, 3)", f"greatest(0, sin(2 * pi() * {LIMITS}))")]),
}
