"""Queries of iterative lens models, rectification, lens names, boards and streams, each with SQL by hand."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import fixtures
from plumbline.functions import lens, pose
from plumbline.functions.scalars import on_frame
from plumbline.operators import alignment, stereo, views
from plumbline.operators.synthetic import ref_calibration_object
from plumbline.plans import formula_sql as S
from plumbline.streaming import culling

SPLINED = "LENSMODEL_SPLINED_STEREOGRAPHIC_order=3_Nx=11_Ny=8_fov_x_deg=100"
CORE = [1500.0, 1480.0, 1000.0, 800.0]
OPENCV8 = [*CORE, -0.05, 0.02, 0.001, -0.001, 0.0, 0.01, 0.0, 0.0]


OPENCV12 = [*OPENCV8, 0.0, 0.0, 0.0, 0.0]
CAHVORE = [*CORE, 0.01, -0.02, 0.01, 0.02, -0.01, 0.01, 0.02, 0.01]


def splined_intrinsics() -> list[float]:
    n = lens.lensmodel(SPLINED).num_params - 4
    return CORE + [0.01 * ((7 * k) % 11 - 5) / 5 for k in range(n)]


def _ahead(spark, d) -> tuple[DataFrame, list]:
    e = F.col("e")
    return fixtures.vectors(spark, d), [e[0], e[1], e[2] * 0.5 + 1.0]


def _projected(spark, d, model: str, intrinsics: list[float]) -> DataFrame:
    rows, p = _ahead(spark, d)
    return lens.with_pixels(rows, p, model, intrinsics)


def _pixels(df: DataFrame) -> DataFrame:
    return df.select("vec_id", *[(F.round(c, 6) + 0.0).alias(f"o{i}") for i, c in enumerate(("qx", "qy"))])


def _unprojected(spark, d, model: str, intrinsics: list[float]) -> DataFrame:
    rows = _projected(spark, d, model, intrinsics).select("vec_id", F.array("qx", "qy").alias("q"), F.lit(model).alias("lensmodel"), F.array(*map(F.lit, intrinsics)).alias("intrinsics"))
    return lens.with_unprojections(rows).select("vec_id", *[(F.round(F.col("v")[i], 6) + 0.0).alias(f"o{i}") for i in range(3)])


def project_splined(spark, d) -> DataFrame:
    return _pixels(_projected(spark, d, SPLINED, splined_intrinsics()))


def project_cahvore(spark, d) -> DataFrame:
    return _pixels(_projected(spark, d, "LENSMODEL_CAHVORE_linearity=0.40", CAHVORE))


def project_by_row(spark, d) -> DataFrame:
    """A camera a row: two pinholes in turn."""
    rows, p = _ahead(spark, d)
    cores = [F.array(*map(F.lit, i)) for i in (CORE, [900.0, 910.0, 500.0, 400.0])]
    rows = rows.select("vec_id", F.array(*p).alias("p"), F.lit("LENSMODEL_PINHOLE").alias("lensmodel"), F.when(F.col("vec_id") % 2 == 0, cores[0]).otherwise(cores[1]).alias("intrinsics"))
    return lens.with_projections(rows).select("vec_id", *[(F.round(F.col("q")[i], 6) + 0.0).alias(f"o{i}") for i in range(2)])


def unproject_opencv8(spark, d) -> DataFrame:
    return _unprojected(spark, d, "LENSMODEL_OPENCV8", OPENCV8)


def unproject_splined(spark, d) -> DataFrame:
    return _unprojected(spark, d, SPLINED, splined_intrinsics())


def procrustes_groups(spark, d) -> DataFrame:
    """Points of each label, moved by a pose of the label's own; the fit finds the pose again."""
    e = fixtures.read(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e"))
    rt = [F.col("label") * 0.1, F.col("label") * -0.05, F.lit(0.2), F.col("label") * 1.0, F.lit(2.0), F.lit(3.0)]
    rows = on_frame(e.select("label", F.slice("e", 1, 3).alias("p1")), pose.transform_point_rt, [[c.cast("double") for c in rt], [F.col("p1")[i] for i in range(3)]], out="p0")
    return alignment.align_groups(rows, ["label"], "p0", "p1").select("label", "n", *[(F.round(F.col("Rt01")[i], 6) + 0.0).alias(f"o{i}") for i in range(12)])


def projection_difference(spark, d) -> DataFrame:
    """(iy, ix, dx, dy) between a lens and the same lens written as a larger model, after a fit of their coordinates."""
    models = [("LENSMODEL_OPENCV8", np.array(OPENCV8)), ("LENSMODEL_OPENCV12", np.array(OPENCV12))]
    return views.projection_difference(spark, models, (2000, 1600)).select("iy", "ix", *[(F.round(c, 4) + 0.0).alias(c) for c in ("dx", "dy")])


def lens_names(spark, d) -> DataFrame:
    """What names of lens models say, or why they say nothing."""
    k = F.col("n_nationkey")
    spline = F.concat(F.lit("LENSMODEL_SPLINED_STEREOGRAPHIC_order="), k % 4, F.lit("_Nx="), k + 2, F.lit("_Ny="), F.lit(9), F.lit("_fov_x_deg=120"))
    name = F.when(k % 5 == 0, "LENSMODEL_OPENCV8").when(k % 5 == 1, F.concat(F.lit("LENSMODEL_CAHVORE_linearity=0."), k)).when(k % 5 == 2, spline).when(k % 5 == 3, "LENSMODEL_CAHVORE").otherwise("LENSMODEL_OTHER")
    names = fixtures.read(spark, d, "nation").select(k, name.alias("name"))

    def run(batches):
        for pdf in batches:
            rows = []
            for key, n in zip(pdf["n_nationkey"], pdf["name"], strict=True):
                m = lens.parse_name(n)
                rows.append((key, m, None, None, None, None) if isinstance(m, int) else (key, 0, m.num_params, m.metadata["can_project_behind_camera"], m.metadata["noncentral"], str(m.config.get("linearity", m.config.get("Nx", "")))))
            yield pd.DataFrame(rows, columns=["n_nationkey", "error", "num_params", "behind", "noncentral", "config"]).astype({"num_params": "Int64", "behind": "boolean", "noncentral": "boolean"})

    kind = names.schema["n_nationkey"].dataType.simpleString()
    return names.mapInPandas(run, f"n_nationkey {kind}, error int, num_params long, behind boolean, noncentral boolean, config string")


def rectification_map(spark, d) -> DataFrame:
    models = [{"lensmodel": "LENSMODEL_OPENCV8", "intrinsics": OPENCV8, "imagersize": [2000, 1600], "rt_cam_ref": x} for x in ([0.0] * 6, [0.01, 0.02, -0.01, -0.5, 0.01, 0.0])]
    return stereo.rectification_table(spark, models, stereo.rectified_system(models, 40.0, 30.0, pixels_per_deg_az=3.0, pixels_per_deg_el=3.0)).selectExpr("y", "x", *[f"round(CAST({c} AS DOUBLE), 3) + 0.0 AS {c}" for c in ("x0", "y0", "x1", "y1")])


def calibration_object(spark, d) -> DataFrame:
    return ref_calibration_object(spark, 10, 14, 0.1, (0.002, -0.005)).select("iy", "ix", *[(F.round(c, 6) + 0.0).alias(c) for c in "xyz"])


def splined_num_params(spark, d) -> DataFrame:
    names = F.concat(F.lit("LENSMODEL_SPLINED_STEREOGRAPHIC_order=3_Nx="), F.col("n_nationkey") + 4, F.lit("_Ny="), F.col("n_regionkey") + 5, F.lit("_fov_x_deg=120"))
    return fixtures.read(spark, d, "nation").select("n_nationkey", lens.num_params_column(names).cast("long").alias("num_params"))


def windowed_events(spark, d) -> DataFrame:
    out = culling.windowed(fixtures.read(spark, d, "events"), "ts", "value")
    return out.select("start", "n", (F.round("mean", 6) + 0.0).alias("mean"), (F.round("stdev", 6) + 0.0).alias("stdev"))


_AHEAD = "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) * 0.5 + 1 AS z FROM embeddings"
_U = f"SELECT *, 2 * x / (sqrt(x * x + y * y + z * z) + z) AS ux, 2 * y / (sqrt(x * x + y * y + z * z) + z) AS uy FROM ({_AHEAD}) p"
_RAYS = f"SELECT vec_id, round(ux, 6) + 0.0 AS o0, round(uy, 6) + 0.0 AS o1, round(1 - (ux * ux + uy * uy) / 4, 6) + 0.0 AS o2 FROM ({_U}) u"


def _basis(f: str, i: str) -> str:
    """The cubic B-spline's four weights at f past a knot."""
    return f"CASE {i} WHEN 0 THEN power(1 - {f}, 3) WHEN 1 THEN 3 * power({f}, 3) - 6 * power({f}, 2) + 4 WHEN 2 THEN 1 + 3 * {f} + 3 * power({f}, 2) - 3 * power({f}, 3) ELSE power({f}, 3) END / 6"


_SPLINE = f"""WITH u AS ({_U}), g AS (SELECT *, ux * 8 / (4 * tan(radians(100) / 4)) + 5 AS gx, uy * 8 / (4 * tan(radians(100) / 4)) + 3.5 AS gy FROM u),
    k AS (SELECT *, greatest(1, least(8, floor(gx))) AS kx, greatest(1, least(5, floor(gy))) AS ky FROM g),
    t AS (SELECT vec_id, ux, uy, ({_basis('(gx - kx)', 'b.i')}) * ({_basis('(gy - ky)', 'a.i')}) AS w, CAST(2 * ((ky - 1 + a.i) * 11 + kx - 1 + b.i) AS BIGINT) AS n FROM k, range(4) a(i), range(4) b(i))
    SELECT vec_id, round(1500 * (min(ux) + sum(w * 0.01 * ((7 * n) % 11 - 5) / 5)) + 1000, 6) + 0.0 AS o0, round(1480 * (min(uy) + sum(w * 0.01 * ((7 * (n + 1)) % 11 - 5) / 5)) + 800, 6) + 0.0 AS o1 FROM t GROUP BY vec_id"""


def _cahvore() -> str:
    """The entry angle by halving a bracket sixty times."""
    alpha, beta, r0, r1, r2, e0, e1, e2 = CAHVORE[4:]
    pupil = f"({e0} + {e1} * m * m + {e2} * m * m * m * m)"
    return f"""WITH RECURSIVE p AS ({_AHEAD}), o AS (SELECT *, sin({alpha}) * cos({beta}) AS ox, sin({beta}) AS oy, cos({alpha}) * cos({beta}) AS oz FROM p),
    a AS (SELECT *, x * ox + y * oy + z * oz AS zeta FROM o), l AS (SELECT *, x - zeta * ox AS lx, y - zeta * oy AS ly, z - zeta * oz AS lz FROM a), s AS (SELECT *, sqrt(lx * lx + ly * ly + lz * lz) AS size FROM l),
    h(vec_id, zeta, size, low, high, n) AS (SELECT vec_id, zeta, size, CAST(0 AS DOUBLE), atan2(size, zeta) + 0.5, 0 FROM s UNION ALL
        SELECT vec_id, zeta, size, CASE WHEN gap < 0 THEN m ELSE low END, CASE WHEN gap < 0 THEN high ELSE m END, n + 1 FROM (SELECT *, zeta * sin(m) - size * cos(m) - (m - sin(m)) * {pupil} AS gap FROM (SELECT *, (low + high) / 2 AS m FROM h WHERE n < 60) x) y),
    c AS (SELECT s.*, tan(0.4 * (low + high) / 2) / 0.4 AS chi FROM s JOIN h ON h.vec_id = s.vec_id AND h.n = 60),
    v AS (SELECT *, size / chi AS depth, 1 + {r0} + {r1} * chi * chi + {r2} * power(chi, 4) AS k FROM c)
    SELECT vec_id, round(1500 * (ox * depth + k * lx) / (oz * depth + k * lz) + 1000, 6) + 0.0 AS o0, round(1480 * (oy * depth + k * ly) / (oz * depth + k * lz) + 800, 6) + 0.0 AS o1 FROM v"""


def _rectified() -> str:
    """Axes: along the baseline, as far ahead as both cameras look, and across; 3 pixels a degree."""
    ray = ["sin(lat)", "cos(lat) * sin(lon)", "cos(lat) * cos(lon)"]
    bx, by, bz, w = S.vec("bx"), S.vec("by"), S.vec("bz"), S.vec("w")
    m = [f"m{i}" for i in range(9)]
    lit = lambda v: f"CAST({v} AS DOUBLE)"
    sql = f"SELECT CAST(i // 120 AS INTEGER) AS y, CAST(i % 120 AS INTEGER) AS x, {lit(0.01)} AS ax, {lit(0.02)} AS ay, {lit(-0.01)} AS az, {lit(-0.5)} AS tx, {lit(0.01)} AS ty, {lit(0)} AS tz FROM range(10800) t(i)"
    stages = [
        *S.axis("a"),
        {f"m{i}": x for i, x in enumerate(S.matrix("a"))},
        S.named("g", [f"-({x})" for x in S.apply(S.transposed(m), ["tx", "ty", "tz"])]),
        {"length": f"sqrt({S.dot(S.vec('g'), S.vec('g'))})"},
        {**S.named("bx", [f"{x} / length" for x in S.vec("g")]), **S.named("w", ["m6", "m7", "1 + m8"])},
        S.named("f", [f"{a} - {S.dot(w, bx)} * {b}" for a, b in zip(w, bx, strict=True)]),
        S.named("bz", [f"f{c} / sqrt(fx * fx + fy * fy + fz * fz)" for c in "xyz"]),
        {**S.named("by", S.cross(bz, bx)), "az0": f"asin({S.dot(w, bx)} / sqrt({S.dot(w, w)}))"},
        {"lat": "(x - 59.5) / (degrees(1) * 3) + az0", "lon": "(y - 44.5) / (degrees(1) * 3)"},
        S.named("v", ray),
        S.named("p", [S.dot(["vx", "vy", "vz"], [f"b{a}{c}" for a in "xyz"]) for c in "xyz"]),
        S.named("q", S.apply(m, ["px", "py", "pz"])),
    ]
    k = OPENCV8
    out = []
    for n, c in enumerate("pq"):
        stages += [{f"u{n}": f"{c}x / {c}z", f"w{n}": f"{c}y / {c}z"}, {f"r{n}": f"u{n} * u{n} + w{n} * w{n}"}]
        r, u, v = f"r{n}", f"u{n}", f"w{n}"
        stages.append({f"d{n}": f"(1 + {k[4]} * {r} + {k[5]} * {r} * {r} + {k[8]} * {r} * {r} * {r}) / (1 + {k[9]} * {r} + {k[10]} * {r} * {r} + {k[11]} * {r} * {r} * {r})"})
        at = (f"{k[0]} * ({u} * d{n} + 2 * ({k[6]}) * {u} * {v} + ({k[7]}) * ({r} + 2 * {u} * {u})) + {k[2]}", f"{k[1]} * ({v} * d{n} + ({k[6]}) * ({r} + 2 * {v} * {v}) + 2 * ({k[7]}) * {u} * {v}) + {k[3]}")
        out += [f"round(CAST(CAST({x} AS FLOAT) AS DOUBLE), 3) + 0.0 AS {a}{n}" for a, x in zip("xy", at, strict=True)]
    for i, stage in enumerate(stages):
        sql = f"SELECT *, {', '.join(f'{x} AS {n}' for n, x in stage.items())} FROM ({sql}) s{i}"
    return f"SELECT y, x, {', '.join(out)} FROM ({sql}) o"


SQL = {
    "project_splined": _SPLINE,
    "project_cahvore": _cahvore(),
    "project_by_row": f"SELECT vec_id, round(CASE WHEN vec_id % 2 = 0 THEN 1500 * x / z + 1000 ELSE 900 * x / z + 500 END, 6) + 0.0 AS o0, round(CASE WHEN vec_id % 2 = 0 THEN 1480 * y / z + 800 ELSE 910 * y / z + 400 END, 6) + 0.0 AS o1 FROM ({_AHEAD}) p",
    "unproject_opencv8": _RAYS,  # the ray that was projected
    "unproject_splined": _RAYS,
    "projection_difference": "SELECT CAST(i // 60 AS INTEGER) AS iy, CAST(i % 60 AS INTEGER) AS ix, CAST(0 AS DOUBLE) AS dx, CAST(0 AS DOUBLE) AS dy FROM range(2880) t(i)",
    "rectification_map": _rectified(),
    "lens_names": """SELECT n_nationkey, CASE WHEN fits THEN 0 WHEN k = 2 THEN -2 WHEN k = 3 THEN -3 ELSE -4 END AS error, CAST(CASE WHEN fits THEN CASE k WHEN 0 THEN 12 WHEN 1 THEN 12 ELSE 4 + 2 * (n_nationkey + 2) * 9 END END AS BIGINT) AS num_params,
        CASE WHEN fits THEN k = 2 END AS behind, CASE WHEN fits THEN k = 1 END AS noncentral, CASE WHEN fits THEN CASE k WHEN 0 THEN '' WHEN 1 THEN CASE WHEN n_nationkey = 1 THEN '0.1' WHEN n_nationkey = 6 THEN '0.6' ELSE '0.' || n_nationkey END ELSE CAST(n_nationkey + 2 AS VARCHAR) END END AS config
        FROM (SELECT *, n_nationkey % 5 AS k, n_nationkey % 5 < 2 OR (n_nationkey % 5 = 2 AND n_nationkey % 4 >= 2 AND n_nationkey + 2 > 3) AS fits FROM nation) n""",
    "calibration_object": "SELECT CAST(i // 10 AS INTEGER) AS iy, CAST(i % 10 AS INTEGER) AS ix, round((i % 10) * 0.1, 6) + 0.0 AS x, round((i // 10) * 0.1, 6) + 0.0 AS y, round(0.002 * 4 * ((i % 10) / 9.0) * (1 - (i % 10) / 9.0) - 0.005 * 4 * ((i // 10) / 13.0) * (1 - (i // 10) / 13.0), 6) + 0.0 AS z FROM range(140) t(i)",
    "splined_num_params": "SELECT n_nationkey, CAST(4 + 2 * (n_nationkey + 4) * (n_regionkey + 5) AS BIGINT) AS num_params FROM nation",
    "windowed_events": "SELECT date_trunc('hour', ts) AS start, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS stdev FROM events GROUP BY 1",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (project_splined, project_cahvore, project_by_row, unproject_opencv8, unproject_splined, procrustes_groups, projection_difference, rectification_map, lens_names, calibration_object, splined_num_params, windowed_events)}


def oracle_sql() -> dict[str, str]:
    return SQL
