"""Queries that apply each scalar formula to vectors taken from the embeddings; their SQL is in ``formula_sql``."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.fixtures import vectors
from plumbline.functions import imaging, lens, pose, triangulation
from plumbline.functions.scalars import graph, on_frame
from plumbline.plans import formula_sql


class Source:
    """Scalars made of components of a vector: ``k * e[i] + c``."""

    def __init__(self, *parts: tuple[int, float, float]):
        self.parts = parts

    def columns(self) -> list:
        return [F.col("e")[i] * k + c for i, k, c in self.parts]


def at(first: int, n: int, k: float = 1.0, c: float = 0.0) -> Source:
    return Source(*[(first + i, k, c) for i in range(n)])


R3, T3, P3 = at(0, 3, 6.0), at(3, 3), at(6, 3)
RT0 = Source(*R3.parts, *T3.parts)
RT1 = Source(*[(9 + i, 6.0, 0.0) for i in range(3)], *[(12 + i, 1.0, 0.0) for i in range(3)])
AHEAD = Source((6, 1.0, 0.0), (7, 1.0, 0.0), (8, 0.5, 2.0))
PIXEL = Source((6, 900.0, 1000.0), (7, 900.0, 800.0))
CORE = Source((20, 20.0, 1500.0), (21, 20.0, 1480.0), (22, 10.0, 1000.0), (23, 10.0, 800.0))
RAY0, RAY1, BASE = Source((6, 0.3, 0.0), (7, 0.3, 0.0), (8, 0.1, 1.0)), Source((9, 0.3, -0.1), (10, 0.3, 0.0), (11, 0.1, 1.0)), Source((12, 0.1, 1.0), (13, 0.1, 0.0), (14, 0.1, 0.0))


def distortion(n: int) -> Source:
    return Source(*CORE.parts, *[(24 + i, 0.05, 0.0) for i in range(n - 4)])


def _R(m, r):
    return pose.R_from_r(m, r)


def _via_R(f, m, rt, x):
    return f(m, pose.Rt_from_rt(m, rt) if len(rt) == 6 else pose.R_from_r(m, rt), x)


def _compose_Rt(m, a, b):
    return pose.compose_Rt(m, pose.Rt_from_rt(m, a), pose.Rt_from_rt(m, b))


def _multiplied(m, a, b):
    """A B, A' B, A B', A' B'"""
    A, B = pose.R_from_r(m, a), pose.R_from_r(m, b)
    pairs = ((x, y) for y in (B, pose.invert_R(m, B)) for x in (A, pose.invert_R(m, A)))
    return [c for x, y in pairs for c in pose.multiply_R(m, x, y)]


#: name: (formula, sources)
FORMULAS: dict[str, tuple[Callable, tuple[Source, ...]]] = {
    "identity_R": (lambda m, v: pose.identity_R(m), (P3,)),
    "identity_r": (lambda m, v: pose.identity_r(m), (P3,)),
    "identity_Rt": (lambda m, v: pose.identity_Rt(m), (P3,)),
    "identity_rt": (lambda m, v: pose.identity_rt(m), (P3,)),
    "R_from_r": (pose.R_from_r, (R3,)),
    "r_from_R": (lambda m, r: pose.r_from_R(m, _R(m, r)), (R3,)),
    "invert_R": (lambda m, r: pose.invert_R(m, _R(m, r)), (R3,)),
    "rt_from_Rt": (lambda m, rt: pose.rt_from_Rt(m, pose.Rt_from_rt(m, rt)), (RT0,)),
    "Rt_from_rt": (pose.Rt_from_rt, (RT0,)),
    "invert_Rt": (lambda m, rt: pose.invert_Rt(m, pose.Rt_from_rt(m, rt)), (RT0,)),
    "invert_rt": (pose.invert_rt, (RT0,)),
    "compose_Rt": (_compose_Rt, (RT0, RT1)),
    "compose_r": (pose.compose_r, (R3, at(9, 3, 6.0))),
    "compose_rt": (pose.compose_rt, (RT0, RT1)),
    "rotate_point_R": (partial(_via_R, pose.rotate_point_R), (R3, P3)),
    "rotate_point_R_inverted": (partial(_via_R, pose.rotate_point_R_inverted), (R3, P3)),
    "rotate_point_r": (pose.rotate_point_r, (R3, P3)),
    "rotate_point_r_inverted": (pose.rotate_point_r_inverted, (R3, P3)),
    "transform_point_Rt": (partial(_via_R, pose.transform_point_Rt), (RT0, P3)),
    "transform_point_Rt_inverted": (partial(_via_R, pose.transform_point_Rt_inverted), (RT0, P3)),
    "transform_point_rt": (pose.transform_point_rt, (RT0, P3)),
    "transform_point_rt_inverted": (pose.transform_point_rt_inverted, (RT0, P3)),
    "quat_from_R": (lambda m, r: pose.quat_from_R(m, _R(m, r)), (R3,)),
    "R_from_quat": (lambda m, r: pose.R_from_quat(m, pose.quat_from_r(m, r)), (R3,)),
    "qt_from_Rt": (lambda m, rt: pose.qt_from_Rt(m, pose.Rt_from_rt(m, rt)), (RT0,)),
    "Rt_from_qt": (lambda m, rt: pose.Rt_from_qt(m, [*pose.quat_from_r(m, rt[:3]), *rt[3:]]), (RT0,)),
    "skew_symmetric": (pose.skew_symmetric, (P3,)),
    "R_aligned_to_vector": (pose.R_aligned_to_vector, (P3,)),
    "multiply_R": (_multiplied, (R3, at(9, 3, 6.0))),
    "apply_homography": (pose.apply_homography, (Source(*[(9 + i, 0.1, 1.0 if i % 4 == 0 else 0.0) for i in range(9)]), at(6, 2))),
    "project_pinhole": (lens.project_pinhole, (CORE, AHEAD)),
    "unproject_pinhole": (lens.unproject_pinhole, (CORE, PIXEL)),
    "project_stereographic": (lens.project_stereographic, (CORE, AHEAD)),
    "unproject_stereographic": (lens.unproject_stereographic, (CORE, PIXEL)),
    "project_lonlat": (lens.project_lonlat, (CORE, P3)),
    "unproject_lonlat": (lens.unproject_lonlat, (CORE, PIXEL)),
    "project_latlon": (lens.project_latlon, (CORE, P3)),
    "unproject_latlon": (lens.unproject_latlon, (CORE, PIXEL)),
    **{f"project_opencv{n - 4}": (lens.project_opencv, (distortion(n), AHEAD)) for n in (8, 9, 12, 16)},
    "project_cahvor": (lens.project_cahvor, (distortion(9), AHEAD)),
    **{f"triangulate_{k.replace('-', '_')}": (f, (RAY0, RAY1, BASE)) for k, f in triangulation.METHODS.items()},
    "triangulate_lindstrom": (lambda m, a, b, rt: triangulation.lindstrom(m, a, b, pose.Rt_from_rt(m, rt)), (RAY0, RAY1, Source(*[(15 + i, 0.2, 0.0) for i in range(3)], *BASE.parts))),
    "triangulated_angle": (lambda m, a, b, t: [triangulation.reprojection_angle(m, a, b, t)], (RAY0, RAY1, BASE)),
    "stereo_range_pinhole": (lambda m, q, d, c: [imaging.stereo_range(m, "LENSMODEL_PINHOLE", d[0], q, c, 0.5, 1.0, 80.0)], (PIXEL, Source((9, 200.0, 30.0)), CORE)),
    "stereo_range_latlon": (lambda m, q, d, c: [imaging.stereo_range(m, "LENSMODEL_LATLON", d[0], q, c, 0.5, 1.0, 80.0)], (PIXEL, Source((9, 200.0, 30.0)), CORE)),
    "stereo_unproject": (lambda m, q, d, c: imaging.stereo_unproject(m, "LENSMODEL_LATLON", d[0], q, c, 0.5), (PIXEL, Source((9, 200.0, 30.0)), CORE)),
    "color_map": (lambda m, v: imaging.color(m, v[0], m.num(-0.2), m.num(0.2)), (at(0, 1),)),
}


def _query(formula: Callable, sources: tuple[Source, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = on_frame(vectors(spark, sf_dir), formula, [s.columns() for s in sources], out="o")
        return out.select("vec_id", *[(F.round(F.col("o")[i], 6) + 0.0).alias(f"o{i}") for i in range(_count(formula, sources))])

    return run


def _count(formula: Callable, sources: tuple[Source, ...]) -> int:
    return len(graph(formula, [len(s.parts) for s in sources]))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _query(f, s) for n, (f, s) in FORMULAS.items()}


def oracle_sql() -> dict[str, str]:
    return formula_sql.SQL
