"""Joins and graphs over observations: shared frames, camera correspondence, link traversal, track culling, sparse products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.storage import stored


def shared_frames(seen: DataFrame, frame: str = "frame", cam: str = "cam") -> DataFrame:
    """(a, b, shared) with a < b: the number of frames that both cameras saw."""
    once = seen.select(F.col(frame).alias("f"), F.col(cam).alias("c")).distinct()
    pairs = once.withColumnRenamed("c", "a").join(once.withColumnRenamed("c", "b"), "f").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def corresponding_extrinsics(seen: DataFrame, intrinsics: str, extrinsics: str) -> DataFrame:
    """(icam_intrinsics, icam_extrinsics); raises where a camera stood in two places or two cameras in one.  Null extrinsics are -1."""
    pairs = seen.select(F.col(intrinsics).alias("icam_intrinsics"), F.coalesce(F.col(extrinsics), F.lit(-1)).alias("icam_extrinsics")).distinct()
    by_i, by_e = Window.partitionBy("icam_intrinsics"), Window.partitionBy("icam_extrinsics")
    rows = pairs.withColumn("ni", F.count(F.lit(1)).over(by_i)).withColumn("ne", F.count(F.lit(1)).over(by_e))
    ok = F.when((F.col("ni") == 1) & (F.col("ne") == 1), F.col("icam_extrinsics")).otherwise(F.raise_error(F.lit("intrinsics and extrinsics are not one to one")).cast("int"))
    return rows.select("icam_intrinsics", ok.alias("icam_extrinsics"))


HOP = 65_536


def traverse_links(edges: DataFrame, root: int, least: int = 1) -> DataFrame:
    """(node, parent, cost, hops) of all nodes that links with enough shared frames reach from the root.

    A link costs HOP less its shared frames, so fewer hops win, then more frames; ties go to
    the smaller parent.  Each round relaxes the links of the nodes that improved; costs only
    fall, so the loop ends.
    """
    kept = edges.filter(F.col("shared") >= least)
    both = stored(kept.select("a", "b", "shared").unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared")), "links")
    spark = edges.sparkSession
    best = spark.createDataFrame([(root, None, 0, 0)], "node long, parent long, cost long, hops int")
    frontier = best
    while True:
        step = frontier.join(both, F.col("node") == F.col("a")).select(F.col("b").cast("long").alias("node"), F.col("a").cast("long").alias("parent"), (F.col("cost") + HOP - F.col("shared")).alias("cost"), (F.col("hops") + 1).alias("hops"))
        step = step.groupBy("node").agg(F.min(F.struct("cost", "parent", "hops")).alias("s")).select("node", "s.parent", "s.cost", "s.hops")
        old = best.select("node", F.col("cost").alias("old"), F.col("parent").alias("old_parent"))
        better = step.join(old, "node", "left").filter("old is null or cost < old or (cost = old and parent < old_parent)").drop("old", "old_parent")
        frontier = stored(better, "frontier")
        if frontier.isEmpty():
            return best
        best = stored(best.join(frontier.select("node"), "node", "left_anti").unionByName(frontier), "best")


def cull_tracks(seen: DataFrame, point: str, cam: str, least_per_point: int, least_per_cam: int) -> DataFrame:
    """Points seen too rarely and cameras that see too little are dropped, again and again, until nothing changes."""
    rows = stored(seen, "tracks")
    n = rows.count()
    while True:
        points = rows.groupBy(point).agg(F.count_distinct(cam).alias("n")).filter(F.col("n") >= least_per_point).select(point)
        rows_next = rows.join(points, point, "left_semi")
        cams = rows_next.groupBy(cam).count().filter(F.col("count") >= least_per_cam).select(cam)
        rows = stored(rows_next.join(cams, cam, "left_semi").select(seen.columns), "tracks")
        left = rows.count()
        if left == n:
            return rows
        n = left


def point_sets(rows: DataFrame, order: Column, last: str, by: str) -> DataFrame:
    """Runs of rows up to one marked as the last of its set get a common ``set_id`` within ``by``."""
    w = Window.partitionBy(by).orderBy(order)
    before = F.coalesce(F.lag(F.col(last).cast("int")).over(w), F.lit(0))
    return rows.withColumn("__b", before).withColumn("set_id", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")


def pairs_in_sets(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """All ordered pairs within a set of observations of one point (sets are as small as a point's views)."""
    a = rows.select(*keys, F.col(seq).alias("i0"))
    return a.join(rows.select(*keys, F.col(seq).alias("i1")), keys).filter("i0 < i1")


def jt_x(j: DataFrame, x: DataFrame) -> DataFrame:
    """J'x of a sparse (row, col, value) table and a (row, x) table."""
    return j.join(x, "row").groupBy("col").agg(F.sum(F.col("value") * F.col("x")).alias("value"))


def a_jt_j_at(a: DataFrame, j: DataFrame, leading_rows: int | None = None) -> DataFrame:
    """(i, k, value) of A J' J A' over all or the leading rows of J; A is an (i, col, value) table with few i."""
    j = j if leading_rows is None else j.filter(F.col("row") < leading_rows)
    aj = a.select("i", "col", F.col("value").alias("av")).join(j, "col").groupBy("i", "row").agg(F.sum(F.col("av") * F.col("value")).alias("v"))
    other = aj.select(F.col("i").alias("k"), "row", F.col("v").alias("v2"))
    return aj.join(other, "row").groupBy("i", "k").agg(F.sum(F.col("v") * F.col("v2")).alias("value"))


def block_offsets(blocks: DataFrame, order: str, size: str) -> DataFrame:
    """Where each block of a state or measurement vector begins: a running sum over the (few) blocks."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def frame_numbers(files: DataFrame, path: str = "path", cam: str = "cam") -> DataFrame:
    """Frame numbers from file names: per camera, what is left between the common prefix and suffix of all names, as an integer.

    Digits at the edges of the common parts belong to the number.  A camera with one file has
    frame 0; raises where the middle isn't a number.
    """
    ends = files.groupBy(cam).agg(F.min(path).alias("lo"), F.max(path).alias("hi"), F.min(F.reverse(path)).alias("rlo"), F.max(F.reverse(path)).alias("rhi"), F.count_distinct(path).alias("n"))

    def common(a: Column, b: Column) -> Column:
        n = F.least(F.length(a), F.length(b))
        k = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
        return F.length(F.regexp_replace(F.substring(a, F.lit(1), k), r"\d+$", ""))

    ends = ends.select(cam, "n", common(F.col("lo"), F.col("hi")).alias("head"), common(F.col("rlo"), F.col("rhi")).alias("tail"))
    middle = F.substring(F.col(path), F.col("head") + 1, F.length(path) - F.col("head") - F.col("tail"))
    number = F.when(F.col("n") == 1, 0).otherwise(F.coalesce(F.when(middle.rlike(r"^\d+$"), middle.cast("long")), F.raise_error(F.lit("a file name has no frame number")).cast("long")))
    return files.join(ends, cam).select(*files.columns, number.alias("frame"))
