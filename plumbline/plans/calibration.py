"""Queries over calibration-shaped tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline import fixtures
from plumbline.fixtures import CORNER_SQL, RESIDUAL_SQL
from plumbline.functions import imaging
from plumbline.operators import observations as obs
from plumbline.operators import relations as rel

GRID_X, GRID_Y, WIDTH, HEIGHT = 20, 10, 4000, 2000


def _r(*names: str):
    return [(F.round(n, 6) + 0.0).alias(n) for n in names]


def corner_table(spark, d) -> DataFrame:
    return fixtures.corners(spark, d)


def residual_board(spark, d) -> DataFrame:
    return fixtures.residuals(spark, d).select("frame", "cam", "idx", "w", *_r("x", "y", "dx", "dy"))


def measurements_board_cam1(spark, d) -> DataFrame:
    return obs.measurements_board(fixtures.residuals(spark, d), 1).select("frame", "idx", *_r("dx", "dy"))


def pixel_uncertainty(spark, d) -> DataFrame:
    return obs.observed_pixel_uncertainty(fixtures.residuals(spark, d), 100).select(*_r("sigma"))


def solve_report(spark, d) -> DataFrame:
    return obs.solve_report(fixtures.residuals(spark, d)).select("measurements", *_r("rms", "worst", "outlier_ratio"))


def mark_outliers(spark, d) -> DataFrame:
    return obs.mark_outliers(fixtures.residuals(spark, d), 1.5, 2.0).select("frame", "cam", "idx", "w", "outlier")


def regional_statistics(spark, d) -> DataFrame:
    grid = spark.range(GRID_X * GRID_Y).select((F.col("id") % GRID_X).cast("int").alias("ix"), F.floor(F.col("id") / GRID_X).cast("int").alias("iy"))
    out = obs.regional_statistics(fixtures.residuals(spark, d), obs.cell_of(F.col("x"), GRID_X, WIDTH), obs.cell_of(F.col("y"), GRID_Y, HEIGHT), grid)
    return out.select("ix", "iy", *_r("mean", "stdev"), "count")


def residual_histogram(spark, d) -> DataFrame:
    return obs.histogram(fixtures.residuals(spark, d), 50.0)


def residual_gaussian(spark, d) -> DataFrame:
    return obs.gaussian_fit(fixtures.residuals(spark, d), 50.0).select(*_r("mean", "sigma", "height"), "n")


def per_observation(spark, d) -> DataFrame:
    return obs.per_observation(fixtures.residuals(spark, d)).select("frame", "cam", "inliers", *_r("rms", "sum2"))


def worst_observations(spark, d) -> DataFrame:
    return obs.worst_observations(fixtures.residuals(spark, d), 20).select("frame", "cam", "inliers", "rank", *_r("sum2"))


def cull_left_of(spark, d) -> DataFrame:
    return obs.cull_left_of(fixtures.corners(spark, d), 1000.0)


def cull_off_center(spark, d) -> DataFrame:
    return obs.cull_off_center(fixtures.corners(spark, d), 900.0, WIDTH, HEIGHT)


def cull_off_board_center(spark, d) -> DataFrame:
    return obs.cull_off_board_center(fixtures.corners(spark, d), 1.2, 3, 3)


def _single(turns: int):
    def run(spark, d) -> DataFrame:
        rows = fixtures.corners(spark, d)
        full = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("frame", "cam"))).filter("n = 4").drop("n")
        return obs.rotate_corners(full, 2, 2, turns, ["frame", "cam"])

    return run


def images_with_points(spark, d) -> DataFrame:
    return obs.images_with_points(fixtures.corners(spark, d), ["frame", "cam"], 3)


def exclude_images(spark, d) -> DataFrame:
    names = fixtures.read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("frame"))
    return obs.exclude_images(fixtures.corners(spark, d), names, ["frame"])


def frame_numbering(spark, d) -> DataFrame:
    return obs.renumber(fixtures.corners(spark, d).select("frame", "cam").distinct(), "frame").select("frame", "cam", F.col("iframe").cast("long").alias("iframe"))


def whole_boards(spark, d) -> DataFrame:
    rows = obs.boards(fixtures.corners(spark, d), 2, 2, 2)
    return rows.select("frame", "cam", F.col("iframe").cast("long").alias("iframe"), F.size("corners").cast("long").alias("n"), (F.round(F.aggregate("corners", F.lit(0.0), lambda a, c: a + c["x"]), 4) + 0.0).alias("sum_x"))


def shared_frames(spark, d) -> DataFrame:
    return rel.shared_frames(fixtures.corners(spark, d))


def supplier_links(spark, d) -> DataFrame:
    seen = fixtures.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_suppkey").alias("cam"))
    return rel.shared_frames(seen)


def traverse_links(spark, d) -> DataFrame:
    return rel.traverse_links(supplier_links(spark, d), 0, 29).select("node", "cost", "hops")


def corresponding_extrinsics(spark, d) -> DataFrame:
    rows = fixtures.corners(spark, d).withColumn("e", F.when(F.col("cam") > 0, F.col("cam") - 1))
    return rel.corresponding_extrinsics(rows, "cam", "e")


def cull_tracks(spark, d) -> DataFrame:
    seen = fixtures.read(spark, d, "lineitem").select(F.col("l_partkey").alias("point"), F.col("l_suppkey").alias("cam"))
    return rel.cull_tracks(seen, "point", "cam", 28, 150).groupBy("cam").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("point").alias("points"))


def point_sets(spark, d) -> DataFrame:
    rows = fixtures.read(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("last"))
    return rel.point_sets(rows, F.col("event_id"), "last", "user_id").select("user_id", "event_id", "set_id")


def triangulated_pairs(spark, d) -> DataFrame:
    rows = fixtures.read(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("last"))
    sets = rel.point_sets(rows, F.col("event_id"), "last", "user_id")
    return rel.pairs_in_sets(sets, ["user_id", "set_id"], "event_id").groupBy("user_id", "set_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("i1") - F.col("i0")).alias("gap"))


def worst_direction(spark, d) -> DataFrame:
    return fixtures.residuals(spark, d).groupBy("cam").agg(obs.worst_direction_stdev(F.col("dx"), F.col("dy")).alias("sigma")).select("cam", *_r("sigma"))


def covariance_ellipse(spark, d) -> DataFrame:
    return fixtures.residuals(spark, d).groupBy("cam").agg(*obs.covariance_ellipse(F.col("dx"), F.col("dy"))).select("cam", *_r("mean_x", "mean_y", "major", "minor", "angle"))


def _jacobian(spark, d) -> DataFrame:
    return fixtures.vectors(spark, d).select(F.col("vec_id").alias("row"), F.posexplode("e").alias("col", "value"))


def jt_x(spark, d) -> DataFrame:
    x = fixtures.vectors(spark, d).select(F.col("vec_id").alias("row"), (F.col("vec_id") % 7 - 3).cast("double").alias("x"))
    return rel.jt_x(_jacobian(spark, d), x).select(F.col("col").cast("long").alias("col"), *_r("value"))


def a_jt_j_at(spark, d) -> DataFrame:
    a = spark.range(3 * 64).select((F.col("id") % 3).alias("i"), F.floor(F.col("id") / 3).cast("int").alias("col"))
    a = a.withColumn("value", ((F.col("i") * 7 + F.col("col")) % 5 - 2).cast("double"))
    return rel.a_jt_j_at(a, _jacobian(spark, d)).select("i", "k", *_r("value"))


def block_offsets(spark, d) -> DataFrame:
    blocks = fixtures.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("block"), (F.length("n_name") * 6).cast("long").alias("size"))
    return rel.block_offsets(blocks, "block", "size").select("block", "size", F.col("offset").cast("long").alias("offset"))


def sample_imager(spark, d) -> DataFrame:
    return imaging.sample_imager(spark, GRID_X, None, WIDTH, HEIGHT).select("ix", "iy", *_r("x", "y"))


def within_region(spark, d) -> DataFrame:
    corners = [(500.0, 300.0), (3000.0, 100.0), (3600.0, 1500.0), (1200.0, 1800.0)]
    polygon = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in corners])
    return fixtures.corners(spark, d).select("frame", "cam", "idx", imaging.within_polygon(F.col("x"), F.col("y"), polygon).alias("inside"))


def distinct_extrinsics(spark, d) -> DataFrame:
    rows = fixtures.corners(spark, d)
    both = rows.select("cam", "frame").unionByName(rows.select("cam", (F.col("frame") + 1).alias("frame")))
    return both.distinct().groupBy("cam").agg(F.count(F.lit(1)).alias("n"), (F.max("frame") - F.min("frame") + 1).alias("span"))


def vignette_color_map(spark, d) -> DataFrame:
    return imaging.apply_color_map(fixtures.corners(spark, d).select("frame", "cam", "idx", "y"), "y")


def stretch_equalization(spark, d) -> DataFrame:
    rows = fixtures.corners(spark, d).select("frame", "cam", "idx", "y")
    ends = rows.agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    return rows.crossJoin(F.broadcast(ends)).select("frame", "cam", "idx", F.floor(0.5 + F.try_divide((F.col("y") - F.col("lo")) * 255, F.col("hi") - F.col("lo"))).cast("int").alias("level"))


_X, _Y = f"(x * (CAST({GRID_X - 1} AS DOUBLE) / {WIDTH - 1}) + 0.5)", f"(y * (CAST({GRID_Y - 1} AS DOUBLE) / {HEIGHT - 1}) + 0.5)"
_BOARD = "(SELECT *, count(*) OVER (PARTITION BY frame, cam) AS n FROM ({0}) c)".format(CORNER_SQL)
_SETS = "SELECT user_id, event_id, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS set_id FROM (SELECT user_id, event_id, coalesce(lag(CAST(event_type = 'purchase' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS b FROM events) e"
_J = "(SELECT vec_id AS row, unnest(range(64)) AS col, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
_LINKS = "SELECT p.c AS a, q.c AS b, count(*) AS shared FROM s p JOIN s q ON p.f = q.f AND p.c < q.c GROUP BY 1, 2"


def _rot(expr: str) -> str:
    return f"SELECT frame, cam, CAST({expr} AS INTEGER) AS idx, x, y, w FROM {_BOARD} b WHERE n = 4"


def _edge(a: tuple, b: tuple) -> str:
    return f"CASE WHEN (({a[1]} > y) <> ({b[1]} > y)) AND x < {a[0]} + (y - {a[1]}) * ({b[0] - a[0]}) / nullif({b[1] - a[1]}, 0) THEN 1 ELSE 0 END"


_POLY = [(500.0, 300.0), (3000.0, 100.0), (3600.0, 1500.0), (1200.0, 1800.0)]
_EDGES = list(zip(_POLY, _POLY[1:] + _POLY[:1], strict=True))
_ON = " OR ".join(f"(({b[0] - a[0]}) * (y - {a[1]}) - ({b[1] - a[1]}) * (x - {a[0]}) = 0 AND x BETWEEN {min(a[0], b[0])} AND {max(a[0], b[0])} AND y BETWEEN {min(a[1], b[1])} AND {max(a[1], b[1])})" for a, b in _EDGES)

_R = f"({RESIDUAL_SQL}) r"
_ROUND = "round({0}, 6) + 0.0 AS {0}"
_E2 = "(dx * dx + dy * dy)"

SQL: dict[str, str] = {
    "corner_table": CORNER_SQL,
    "residual_board": f"SELECT frame, cam, idx, w, {', '.join(_ROUND.format(c) for c in ('x', 'y', 'dx', 'dy'))} FROM {_R}",
    "measurements_board_cam1": f"SELECT frame, idx, {_ROUND.format('dx')}, {_ROUND.format('dy')} FROM {_R} WHERE w > 0 AND cam = 1",
    "pixel_uncertainty": f"SELECT round(sqrt(sum{_E2} / (2 * count(*))) / sqrt(1 - 100.0 / (2 * count(*))), 6) + 0.0 AS sigma FROM {_R} WHERE w > 0",
    "solve_report": f"SELECT 2 * count(*) AS measurements, round(sqrt(sum{_E2} / (2 * count(*))), 6) AS rms, round(sqrt(max{_E2}), 6) AS worst, round(count(*) FILTER (w <= 0) / count(*), 6) AS outlier_ratio FROM {_R}",
    "mark_outliers": f"""WITH r AS ({RESIDUAL_SQL}), s AS (SELECT sqrt(sum{_E2} / (2 * count(*))) AS sigma, max(greatest(abs(dx), abs(dy))) AS most FROM r WHERE w > 0)
        SELECT frame, cam, idx, CASE WHEN w > 0 AND most > 2.0 * sigma AND greatest(abs(dx), abs(dy)) > 1.5 * sigma THEN -w ELSE w END AS w,
               (w > 0 AND most > 2.0 * sigma AND greatest(abs(dx), abs(dy)) > 1.5 * sigma) AS outlier FROM r, s""",
    "regional_statistics": f"""WITH r AS (SELECT CASE WHEN {_X} > floor({_X}) AND {_X} > 0 AND {_X} < {GRID_X} THEN CAST(floor({_X}) AS INTEGER) END AS ix,
               CASE WHEN {_Y} > floor({_Y}) AND {_Y} > 0 AND {_Y} < {GRID_Y} THEN CAST(floor({_Y}) AS INTEGER) END AS iy, dx, dy FROM {_R} WHERE w > 0),
             s AS (SELECT ix, iy, avg(v) AS m, stddev_pop(v) AS s, count(*) AS n FROM (SELECT ix, iy, dx AS v FROM r UNION ALL SELECT ix, iy, dy FROM r) u WHERE ix IS NOT NULL AND iy IS NOT NULL GROUP BY ix, iy),
             g AS (SELECT CAST(i % {GRID_X} AS INTEGER) AS ix, CAST(i // {GRID_X} AS INTEGER) AS iy FROM range({GRID_X * GRID_Y}) t(i))
        SELECT g.ix, g.iy, round(CASE WHEN n > 5 THEN m ELSE 0 END, 6) + 0.0 AS mean, round(CASE WHEN n > 5 THEN s ELSE 0 END, 6) + 0.0 AS stdev, coalesce(n, 0) AS count FROM g LEFT JOIN s USING (ix, iy)""",
    "residual_histogram": f"SELECT CAST(floor(v / 50.0) AS BIGINT) AS bin, count(*) AS count FROM (SELECT dx AS v FROM {_R} WHERE w > 0 UNION ALL SELECT dy FROM {_R} WHERE w > 0) u GROUP BY 1",
    "residual_gaussian": f"SELECT round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS sigma, count(*) AS n, round(count(*) * 50.0 / (stddev_pop(v) * sqrt(2 * pi())), 6) AS height FROM (SELECT dx AS v FROM {_R} WHERE w > 0 UNION ALL SELECT dy FROM {_R} WHERE w > 0) u",
    "per_observation": f"SELECT frame, cam, count(*) FILTER (w > 0) AS inliers, round(sqrt(sum{_E2} FILTER (w > 0) / nullif(count(*) FILTER (w > 0), 0)), 6) + 0.0 AS rms, round(sum{_E2}, 6) + 0.0 AS sum2 FROM {_R} GROUP BY frame, cam",
    "worst_observations": f"SELECT frame, cam, inliers, CAST(row_number() OVER (ORDER BY s DESC, frame, cam) - 1 AS INTEGER) AS rank, round(s, 6) + 0.0 AS sum2 FROM (SELECT frame, cam, count(*) FILTER (w > 0) AS inliers, sum{_E2} AS s FROM {_R} GROUP BY frame, cam) t ORDER BY s DESC, frame, cam LIMIT 20",
    "cull_left_of": f"SELECT frame, cam, idx, x, y, CASE WHEN x > 1000 THEN w END AS w FROM ({CORNER_SQL}) c",
    "cull_off_center": f"SELECT frame, cam, idx, x, y, CASE WHEN (x - 1999.5) * (x - 1999.5) + (y - 999.5) * (y - 999.5) < 810000 THEN w END AS w FROM ({CORNER_SQL}) c",
    "cull_off_board_center": f"SELECT frame, cam, idx, x, y, CASE WHEN (idx % 3 - 1) * (idx % 3 - 1) + (idx // 3 - 1) * (idx // 3 - 1) < 1.2 * 1.2 THEN w END AS w FROM ({CORNER_SQL}) c",
    "rotate_corners_90": _rot("(1 - idx % 2) * 2 + idx // 2"),
    "rotate_corners_180": _rot("3 - idx"),
    "rotate_corners_270": _rot("(idx % 2) * 2 + 1 - idx // 2"),
    "images_with_points": f"WITH c AS ({CORNER_SQL}) SELECT * FROM c WHERE (frame, cam) IN (SELECT (frame, cam) FROM c WHERE w > 0 GROUP BY frame, cam HAVING count(*) > 3)",
    "exclude_images": f"SELECT * FROM ({CORNER_SQL}) c WHERE frame NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "frame_numbering": f"SELECT frame, cam, dense_rank() OVER (ORDER BY frame) - 1 AS iframe FROM (SELECT DISTINCT frame, cam FROM ({CORNER_SQL}) c) t",
    "whole_boards": f"SELECT frame, cam, dense_rank() OVER (ORDER BY frame) - 1 AS iframe, n, round(sx, 4) + 0.0 AS sum_x FROM (SELECT frame, cam, count(*) AS n, sum(x) AS sx FROM ({CORNER_SQL}) c GROUP BY frame, cam HAVING count(*) = 4 AND count(*) FILTER (w > 0) > 2) t",
    "shared_frames": f"WITH s AS (SELECT DISTINCT frame AS f, cam AS c FROM ({CORNER_SQL}) c) {_LINKS}",
    "supplier_links": f"WITH s AS (SELECT DISTINCT l_orderkey AS f, l_suppkey AS c FROM lineitem) {_LINKS}",
    "traverse_links": f"""WITH RECURSIVE s AS (SELECT DISTINCT l_orderkey AS f, l_suppkey AS c FROM lineitem), e AS ({_LINKS} HAVING count(*) >= 29),
        u AS (SELECT a, b, shared FROM e UNION ALL SELECT b, a, shared FROM e),
        t(node, cost, hops) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0 UNION SELECT u.b, min(t.cost + 65536 - u.shared), t.hops + 1 FROM t JOIN u ON u.a = t.node WHERE t.hops < 6 GROUP BY u.b, t.hops)
        SELECT node, min(cost) AS cost, CAST(arg_min(hops, cost) AS INTEGER) AS hops FROM t GROUP BY node""",
    "corresponding_extrinsics": f"SELECT DISTINCT cam AS icam_intrinsics, cam - 1 AS icam_extrinsics FROM ({CORNER_SQL}) c",
    "point_sets": _SETS,
    "triangulated_pairs": f"WITH s AS ({_SETS}) SELECT p.user_id, p.set_id, count(*) AS pairs, CAST(sum(q.event_id - p.event_id) AS BIGINT) AS gap FROM s p JOIN s q ON p.user_id = q.user_id AND p.set_id = q.set_id AND p.event_id < q.event_id GROUP BY 1, 2",
    "worst_direction": f"SELECT cam, round(sqrt((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b)), 6) AS sigma FROM (SELECT cam, var_pop(dx) AS a, covar_pop(dx, dy) AS b, var_pop(dy) AS c FROM {_R} GROUP BY cam) t",
    "covariance_ellipse": f"SELECT cam, round(mx, 6) + 0.0 AS mean_x, round(my, 6) + 0.0 AS mean_y, round(sqrt((a + c) / 2 + d), 6) AS major, round(sqrt((a + c) / 2 - d), 6) AS minor, round(atan2(2 * b, a - c) / 2, 6) + 0.0 AS angle FROM (SELECT *, sqrt((a - c) * (a - c) / 4 + b * b) AS d FROM (SELECT cam, avg(dx) AS mx, avg(dy) AS my, var_pop(dx) AS a, covar_pop(dx, dy) AS b, var_pop(dy) AS c FROM {_R} GROUP BY cam) t) u",
    "jt_x": f"SELECT col, round(sum(value * (row % 7 - 3)), 6) + 0.0 AS value FROM {_J} j GROUP BY col",
    "a_jt_j_at": f"WITH j AS {_J}, a AS (SELECT k % 3 AS i, k // 3 AS col, CAST((k % 3 * 7 + k // 3) % 5 - 2 AS DOUBLE) AS value FROM range(192) t(k)), v AS (SELECT a.i, j.row AS row, sum(a.value * j.value) AS v FROM a JOIN j ON a.col = j.col GROUP BY 1, 2) SELECT p.i, q.i AS k, round(sum(p.v * q.v), 6) + 0.0 AS value FROM v p JOIN v q ON p.row = q.row GROUP BY 1, 2",
    "block_offsets": "SELECT CAST(n_nationkey AS BIGINT) AS block, length(n_name) * 6 AS size, CAST(coalesce(sum(length(n_name) * 6) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM nation",
    "sample_imager": f"SELECT CAST(i % {GRID_X} AS INTEGER) AS ix, CAST(i // {GRID_X} AS INTEGER) AS iy, round((i % {GRID_X}) * (CAST({WIDTH - 1} AS DOUBLE) / {GRID_X - 1}), 6) AS x, round((i // {GRID_X}) * (CAST({HEIGHT - 1} AS DOUBLE) / {GRID_Y - 1}), 6) AS y FROM range({GRID_X * GRID_Y}) t(i)",
    "within_region": f"SELECT frame, cam, idx, (({' + '.join(_edge(a, b) for a, b in _EDGES)}) % 2 = 1 AND NOT ({_ON})) AS inside FROM ({CORNER_SQL}) c",
    "distinct_extrinsics": f"SELECT cam, count(*) AS n, max(frame) - min(frame) + 1 AS span FROM (SELECT cam, frame FROM ({CORNER_SQL}) c UNION SELECT cam, frame + 1 FROM ({CORNER_SQL}) c) u GROUP BY cam",
    "vignette_color_map": f"""SELECT frame, cam, idx, y, CAST(floor(0.5 + 255 * sqrt(t)) AS INTEGER) AS red, CAST(floor(0.5 + 255 * t * t * t) AS INTEGER) AS green, CAST(floor(0.5 + 255 * greatest(0, sin(t * 2 * pi()))) AS INTEGER) AS blue
        FROM (SELECT *, (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS t FROM ({CORNER_SQL}) c) u""",
    "stretch_equalization": f"SELECT frame, cam, idx, CAST(floor(0.5 + (y - min(y) OVER ()) * 255 / (max(y) OVER () - min(y) OVER ())) AS INTEGER) AS level FROM ({CORNER_SQL}) c",
}


def _cull_tracks(rounds: int) -> str:
    """Rounds of culling, written out; more rounds than it takes to come to rest change nothing."""
    steps = ["t0 AS (SELECT l_partkey AS point, l_suppkey AS cam FROM lineitem)"]
    for i in range(rounds):
        steps.append(f"p{i} AS MATERIALIZED (SELECT * FROM t{i} WHERE point IN (SELECT point FROM t{i} GROUP BY point HAVING count(DISTINCT cam) >= 28))")
        steps.append(f"t{i + 1} AS MATERIALIZED (SELECT * FROM p{i} WHERE cam IN (SELECT cam FROM p{i} GROUP BY cam HAVING count(*) >= 150))")
    return f"WITH {', '.join(steps)} SELECT cam, count(*) AS n, count(DISTINCT point) AS points FROM t{rounds} GROUP BY cam"


SQL["cull_tracks"] = _cull_tracks(12)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (corner_table, residual_board, measurements_board_cam1, pixel_uncertainty, solve_report, mark_outliers, regional_statistics, residual_histogram, residual_gaussian, per_observation, worst_observations, cull_left_of, cull_off_center, cull_off_board_center, images_with_points, exclude_images, frame_numbering, whole_boards, shared_frames, supplier_links, traverse_links, corresponding_extrinsics, cull_tracks, point_sets, triangulated_pairs, worst_direction, covariance_ellipse, jt_x, a_jt_j_at, block_offsets, sample_imager, within_region, distinct_extrinsics, vignette_color_map, stretch_equalization)
    return {f.__name__: f for f in plain} | {f"rotate_corners_{90 * k}": _single(k) for k in (1, 2, 3)}


def oracle_sql() -> dict[str, str]:
    return SQL
