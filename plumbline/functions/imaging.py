"""Formulas of rectified stereo, colour maps, polygons and imager grids."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import SPARK

# The 37 colour components of gnuplot's rgbformulae, by number.
_D = math.pi / 180


def color_component(m, n: int, x):
    """Component ``n`` (0 to 36; negative: of 1 - x) at x, before clipping."""
    if n < 0:
        n, x = -n, 1 - x
    forms = {
        0: lambda: m.num(0),
        1: lambda: m.num(0.5),
        2: lambda: m.num(1),
        3: lambda: x,
        4: lambda: x * x,
        5: lambda: x * x * x,
        6: lambda: x * x * x * x,
        7: lambda: m.sqrt(x),
        8: lambda: m.sqrt(m.sqrt(x)),
        9: lambda: m.sin(x * (90 * _D)),
        10: lambda: m.cos(x * (90 * _D)),
        11: lambda: m.abs(x - 0.5),
        12: lambda: (2 * x - 1) * (2 * x - 1),
        13: lambda: m.sin(x * (180 * _D)),
        14: lambda: m.abs(m.cos(x * (180 * _D))),
        15: lambda: m.sin(x * (360 * _D)),
        16: lambda: m.cos(x * (360 * _D)),
        17: lambda: m.abs(m.sin(x * (360 * _D))),
        18: lambda: m.abs(m.cos(x * (360 * _D))),
        19: lambda: m.abs(m.sin(x * (720 * _D))),
        20: lambda: m.abs(m.cos(x * (720 * _D))),
        21: lambda: 3 * x,
        22: lambda: 3 * x - 1,
        23: lambda: 3 * x - 2,
        24: lambda: m.abs(3 * x - 1),
        25: lambda: m.abs(3 * x - 2),
        26: lambda: (3 * x - 1) * 0.5,
        27: lambda: (3 * x - 2) * 0.5,
        28: lambda: m.abs((3 * x - 1) * 0.5),
        29: lambda: m.abs((3 * x - 2) * 0.5),
        30: lambda: x * (1 / 0.32) - 0.78125,
        31: lambda: 2 * x - 0.84,
        32: lambda: m.where(x < 0.25, 4 * x, m.where(x < 0.42, m.num(1), m.where(x < 0.92, 1.84 - 2 * x, x * (1 / 0.08) - 11.5))),
        33: lambda: m.abs(2 * x - 0.5),
        34: lambda: 2 * x,
        35: lambda: 2 * x - 0.5,
        36: lambda: 2 * x - 1,
    }
    return forms[n]()


def color(m, x, low, high, functions: tuple[int, int, int] = (7, 5, 15)):
    """[red, green, blue], 0 to 255: x at or under ``low`` is 0, at or over ``high`` 1."""
    t = m.where(x <= low, m.num(0), m.where(x >= high, m.num(1), m.div(x - low, high - low)))
    out = []
    for n in functions:
        c = color_component(m, n, t)
        c = m.where(c < 0, m.num(0), m.where(c > 1, m.num(1), c))
        out.append(m.floor(c * 255 + 0.5))
    return out


def apply_color_map(df: DataFrame, value: str, low: float | None = None, high: float | None = None, functions: tuple[int, int, int] = (7, 5, 15)) -> DataFrame:
    """Adds red, green, blue.  Bounds not given are the column's least and greatest value."""
    names = df.columns
    if low is None or high is None:
        bounds = df.agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
        df = df.crossJoin(F.broadcast(bounds))  # one row
    a = F.lit(float(low)) if low is not None else F.col("__low").cast("double")
    b = F.lit(float(high)) if high is not None else F.col("__high").cast("double")
    rgb = color(SPARK, F.col(value).cast("double"), a, b, functions)
    return df.select(*names, *[c.cast("int").alias(n) for c, n in zip(rgb, ("red", "green", "blue"), strict=True)])


def stereo_range(m, model: str, disparity, q, core, baseline, low=0.0, high=math.inf):
    """Range of a disparity at a pixel of the first rectified image; 0 where the disparity is not positive, out of bounds, or the range isn't finite."""
    fx, fy, cx, cy = core
    if model == "LENSMODEL_LATLON":
        a, d = m.div(q[0] - cx, fx), m.div(disparity, fx)
        r = m.div(baseline * m.cos(a - d), m.sin(d))
    else:
        a, e, d = m.div(q[0] - cx, fx), m.div(q[1] - cy, fy), m.div(disparity, fx)
        s = e * e + 1
        r = m.div(baseline, m.sqrt(s + a * a)) * (m.div(s + a * (a - d), d) + a)
    ok = m.both(disparity > 0, disparity >= low)
    if math.isfinite(high):
        ok = m.both(ok, disparity <= high)
    return m.where(m.both(ok, m.abs(r) < 1e300), r, m.num(0))


def stereo_unproject(m, model: str, disparity, q, core, baseline):
    """The point of a disparity in the first rectified camera's coordinates; (0, 0, 0) where there is none."""
    from plumbline.functions.lens import unproject_latlon, unproject_pinhole
    from plumbline.functions.pose import norm

    v = (unproject_latlon if model == "LENSMODEL_LATLON" else unproject_pinhole)(m, core, q)
    r = stereo_range(m, model, disparity, q, core, baseline)
    return [m.div(x * r, norm(m, v)) for x in v]


# -- polygons ----------------------------------------------------------------------------------
def within_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Whether a point lies inside a polygon (array of struct x, y; closed or not), its border excluded.  A null polygon gives null, an empty one false."""
    n = F.size(polygon)
    at = F.sequence(F.lit(0), n - 1)

    def ends(i: Column) -> tuple[Column, Column]:
        return polygon[i], polygon[F.pmod(i + 1, n)]

    def on_edge(i: Column) -> Column:
        a, b = ends(i)
        turn = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        return (turn == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    def crossing(i: Column) -> Column:
        a, b = ends(i)
        cut = a["x"] + F.try_divide((y - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
        return F.when(((a["y"] > y) != (b["y"] > y)) & (x < cut), 1).otherwise(0)

    inside = F.pmod(F.aggregate(F.transform(at, crossing), F.lit(0), lambda s, c: s + c), F.lit(2)) == 1
    return F.when(polygon.isNull(), F.lit(None).cast("boolean")).when(n < 3, False).otherwise(inside & ~F.exists(at, on_edge))


def close_contour(polygon: Column) -> Column:
    """The first vertex appended unless the contour is closed to 1e-6; null stays null, empty stays empty."""
    a, b = F.get(polygon, F.lit(0)), F.get(polygon, F.size(polygon) - 1)
    near = (F.abs(a["x"] - b["x"]) <= 1e-6) & (F.abs(a["y"] - b["y"]) <= 1e-6)
    return F.when((F.size(polygon) < 2) | near, polygon).otherwise(F.concat(polygon, F.slice(polygon, 1, 1)))


def densify(polygon: Column, spacing: float) -> Column:
    """Vertices inserted so that no segment is longer than ``spacing``."""
    n = F.size(polygon)

    def segment(i: Column) -> Column:
        a, b = polygon[i], polygon[i + 1]
        k = F.greatest(F.lit(1), F.ceil(F.hypot(b["x"] - a["x"], b["y"] - a["y"]) / spacing).cast("int"))
        return F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct((a["x"] + (b["x"] - a["x"]) * j / k).alias("x"), (a["y"] + (b["y"] - a["y"]) * j / k).alias("y")))

    return F.when(n < 2, polygon).otherwise(F.concat(F.flatten(F.transform(F.sequence(F.lit(0), n - 2), segment)), F.slice(polygon, -1, 1)))


def clip_half_plane(poly: np.ndarray, a: np.ndarray, b: np.ndarray, keep_left: bool) -> np.ndarray:
    """The part of a convex or simple polygon on one side of the line a-b (Sutherland-Hodgman step)."""
    side = ((b[0] - a[0]) * (poly[:, 1] - a[1]) - (b[1] - a[1]) * (poly[:, 0] - a[0])) * (1 if keep_left else -1)
    out = []
    for k in range(len(poly)):
        j = (k + 1) % len(poly)
        if side[k] >= 0:
            out.append(poly[k])
        if (side[k] > 0 > side[j]) or (side[k] < 0 < side[j]):
            out.append(poly[k] + (poly[j] - poly[k]) * side[k] / (side[k] - side[j]))
    return np.array(out).reshape(-1, 2)


def polygon_area(p: np.ndarray) -> float:
    return float(0.5 * np.sum(p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1])) if len(p) > 2 else 0.0


def polygon_difference(positive: np.ndarray, negative: np.ndarray) -> list[np.ndarray]:
    """positive minus a convex negative, in hole-free pieces: what lies outside of one edge and inside of all before it."""
    p, n = (np.asarray(x, float) for x in (positive, negative))
    if len(n) > 1 and np.allclose(n[0], n[-1]):
        n = n[:-1]
    if len(p) > 1 and np.allclose(p[0], p[-1]):
        p = p[:-1]
    if len(n) < 3 or len(p) < 3:
        return [p] if len(p) else []
    if polygon_area(n) < 0:
        n = n[::-1]
    out = []
    for k in range(len(n)):
        a, b = n[k], n[(k + 1) % len(n)]
        piece = clip_half_plane(p, a, b, keep_left=False)
        if abs(polygon_area(piece)) > 1e-12:
            out.append(piece)
        p = clip_half_plane(p, a, b, keep_left=True)
        if len(p) < 3:
            break
    return out


# -- grids -------------------------------------------------------------------------------------
def grid_height(gridn_width: int, gridn_height: int | None, width: int, height: int) -> int:
    """Half to even, as Python rounds."""
    return gridn_height if gridn_height is not None else int(round(height / width * gridn_width))


def sample_imager(spark, gridn_width: int, gridn_height: int | None, width: int, height: int) -> DataFrame:
    """(iy, ix, x, y): an even grid over the imager, both borders included."""
    n = grid_height(gridn_width, gridn_height, width, height)
    rows = spark.range(n * gridn_width)
    rows = rows.select(F.floor(F.col("id") / gridn_width).cast("int").alias("iy"), (F.col("id") % gridn_width).cast("int").alias("ix"))
    return rows.select("iy", "ix", (F.col("ix") * ((width - 1) / max(gridn_width - 1, 1))).alias("x"), (F.col("iy") * ((height - 1) / max(n - 1, 1))).alias("y"))
