"""Command-line jobs: ``python -m plumbline JOB ...``.  Each reads files with Spark, applies an operator, writes files."""

from __future__ import annotations

import argparse
import json

import numpy as np


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("plumbline").getOrCreate()


def _model(path: str) -> dict:
    from plumbline.sources import models

    with open(path, encoding="utf-8") as f:
        return models.parse_native(f.read())


def convert_models(a) -> None:
    from plumbline.sources import models

    models.convert(_session(), a.source, a.source_format, a.target, a.format, a.force).show(truncate=False)


def cull_corners(a) -> None:
    from pyspark.sql import functions as F

    from plumbline.operators import observations as obs
    from plumbline.sources import tables

    rows = tables.read_corners(_session(), a.source, a.weight)
    if a.left_of is not None:
        rows = obs.cull_left_of(rows, a.left_of)
    if a.radius is not None:
        rows = obs.cull_off_center(rows, a.radius, *a.imagersize)
    if a.where:
        kept = tables.read_corners(_session(), a.source, a.weight)
        rows = rows.filter(F.col("filename").rlike(a.where)).unionByName(kept.filter(~F.col("filename").rlike(a.where)))
    rows.write.mode("overwrite" if a.force else "errorifexists").parquet(a.target)


def report_fov(a) -> None:
    from plumbline.functions import lens

    for path in a.models:
        m = _model(path)
        print(path, json.dumps({k: round(v, 2) for k, v in lens.report_fov(m["lensmodel"], np.array(m["intrinsics"]), m["imagersize"]).items()}))


def rotate_corners(a) -> None:
    from plumbline.operators import observations as obs
    from plumbline.sources import tables

    rows = tables.read_corners(_session(), a.source, a.weight)
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = rows.withColumn("idx", F.row_number().over(Window.partitionBy("file", "filename").orderBy("line")) - 1)
    rows = obs.rotate_corners(rows, *a.gridn, a.turns, ["file", "filename"], F.col("filename").rlike(a.where) if a.where else None)
    rows.write.mode("overwrite" if a.force else "errorifexists").parquet(a.target)


def _pixels(path: str, n: int = 2):
    """Lines of whitespace-separated numbers as a table."""
    from pyspark.sql import functions as F

    f = F.split(F.trim("value"), r"\s+")
    lines = _session().read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)"))
    return lines.select(*[f[i].cast("double").alias(c) for i, c in enumerate(("x", "y", "x1", "y1")[:n])])


def reproject_points(a) -> None:
    """Pixels (x y a line) of one camera to those of another: by rotation, or at a distance."""
    from plumbline.operators import grids

    out = grids.reproject_points(_pixels(a.points), _model(a.source), _model(a.to), intrinsics_only=a.intrinsics_only, distance=a.distance)
    out.write.mode("overwrite" if a.force else "errorifexists").parquet(a.target)


def within_region(a) -> None:
    """Pixels (x y a line) with whether they lie within the model's valid-intrinsics region."""
    from plumbline.operators import grids

    grids.within_region(_pixels(a.points), _model(a.model)).write.mode("overwrite" if a.force else "errorifexists").parquet(a.target)


def triangulate(a) -> None:
    """Pixel pairs (x y x1 y1 a line) of two cameras to points in the first one's coordinates, with covariances of a pixel noise."""
    from plumbline.operators import grids

    out = grids.triangulate_pixels(_pixels(a.points, 4), [_model(m) for m in a.models], ("x", "y", "x1", "y1"), a.method, a.sigma, a.correlation)
    out.write.mode("overwrite" if a.force else "errorifexists").parquet(a.target)


def calibrate_cameras(a) -> None:
    """A corner table to one model a camera, with the solve it came from."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from plumbline.operators import relations, reports
    from plumbline.sources import models, tables

    rows = tables.assign_cameras(tables.read_corners(_session(), a.corners, a.weight), a.cameras)
    rows = rows.withColumn("idx", F.row_number().over(Window.partitionBy("file", "filename").orderBy("line")) - 1)
    files = relations.frame_numbers(rows.select(F.col("filename").alias("path"), "cam").distinct())
    rows = rows.join(files.withColumnRenamed("path", "filename"), ["filename", "cam"]).select(F.lit(0).alias("problem"), "frame", "cam", "idx", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"), "w")
    found = reports.calibrate_models(rows, a.lensmodel, tuple(a.imagersize), a.focal, *a.object_width_height, a.object_spacing)
    from plumbline.storage import stored

    found = stored(found, "models")
    found.select("name", "rms", "outliers").show(truncate=False)
    models.write(found.drop("problem", "rms", "outliers"), a.target, overwrite=a.force).show(truncate=False)


def reproject_image(a) -> None:
    """Images of one camera as another would have taken them."""
    from plumbline.operators import reports
    from plumbline.sources import tables

    images = reports.mapped_images(tables.read_images(_session(), a.images), _model(a.source), _model(a.to), intrinsics_only=a.intrinsics_only, distance=a.distance)
    tables.write_images(images, a.target).show(truncate=False)


def rectify(a) -> None:
    """Images of a camera pair to a rectified pair, and its two models."""
    from plumbline.operators import reports, stereo
    from plumbline.sources import models, tables

    pair = [_model(m) for m in a.models]
    flat = stereo.rectified_system(pair, a.az_fov_deg, a.el_fov_deg, rectification=a.rectification)
    for i, source in enumerate(a.images):
        tables.write_images(reports.rectified_images(tables.read_images(_session(), source), pair, flat, i), f"{a.target}/{i}").show(truncate=False)
        print(models.format_native(flat[i]))


def stereo_ranges(a) -> None:
    """A table of (x, y, disparity) of a rectified pair to ranges and points."""
    from plumbline.operators import reports

    out = reports.ranges(_session().read.parquet(a.disparities), [_model(m) for m in a.models], a.low, a.high)
    out.write.mode("overwrite" if a.force else "errorifexists").parquet(a.target)


def show(a) -> None:
    """The table behind a plot of a model."""
    from plumbline.operators import reports, views
    from plumbline.sources import models

    with open(a.model, encoding="utf-8") as f:
        m = models.CameraModel.parse(f.read())
    spark, (kind, intrinsics) = _session(), m.intrinsics
    found = {
        "residuals": lambda: {"residuals": reports.residuals(spark, m), **reports.residual_reports(spark, m, a.gridn)},
        "geometry": lambda: reports.geometry(spark, m),
        "uncertainty": lambda: {"uncertainty": reports.uncertainty(spark, m, a.gridn, a.distance)},
        "resolution": lambda: {"resolution": views.resolution(spark, kind, intrinsics, m.imagersize, a.gridn)},
        "distortion": lambda: {"distortion": views.distortion_off_pinhole(spark, kind, intrinsics, m.imagersize, a.gridn)},
        "splined-correction": lambda: {"correction": views.splined_correction(spark, kind, intrinsics, a.gridn)},
    }[a.what]()
    for name, df in found.items():
        df.write.mode("overwrite" if a.force else "errorifexists").parquet(f"{a.target}/{name}")


def difference(a) -> None:
    """The table behind a plot of the difference between models."""
    from plumbline.operators import views

    found = [_model(m) for m in a.models]
    out = views.projection_difference(_session(), [(m["lensmodel"], np.array(m["intrinsics"])) for m in found], found[0]["imagersize"], a.gridn, distance=a.distance, intrinsics_only=a.intrinsics_only)
    out.write.mode("overwrite" if a.force else "errorifexists").parquet(a.target)


def graft(a) -> None:
    from plumbline.operators.uncertainty import graft as f
    from plumbline.sources import models

    print(models.format_native(f(_model(a.intrinsics), _model(a.extrinsics))))


def convert_lensmodel(a) -> None:
    """A model in another lens model: by its stored solve, or fitted to samples of its rays."""
    from plumbline.operators import reports
    from plumbline.operators.uncertainty import convert_lensmodel as f
    from plumbline.sources import models

    if not a.sampled:
        with open(a.model, encoding="utf-8") as file:
            print(reports.converted(models.CameraModel.parse(file.read()), a.to))
        return
    m = _model(a.model)
    b, rms = f(m["lensmodel"], np.array(m["intrinsics"]), m["imagersize"], a.to, a.gridn, a.distance, a.trials)
    alone = {"icam_intrinsics": None, "icam_extrinsics": None, "optimization_inputs": None}
    print(models.format_native({**m, **alone, "lensmodel": a.to, "intrinsics": b.tolist()}, f"fitted to samples of {m['lensmodel']}; RMS {rms:.4g} pixels"))


def query(a) -> None:
    from plumbline.plans import registry

    registry.queries()[a.name](_session(), a.tables).write.mode("overwrite" if a.force else "errorifexists").parquet(a.target)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="plumbline")
    jobs = p.add_subparsers(required=True)

    def job(f, *args):
        s = jobs.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        for names, options in args:
            s.add_argument(*names, **options)
        s.set_defaults(run=f)

    force = (("--force",), {"action": "store_true"})
    job(convert_models, (("source",), {}), (("target",), {}), (("--source-format",), {"default": "native"}), (("--format",), {"default": "native"}), force)
    job(cull_corners, (("source",), {}), (("target",), {}), (("--weight",), {"default": "level"}), (("--left-of",), {"type": float}), (("--radius",), {"type": float}), (("--imagersize",), {"type": int, "nargs": 2}), (("--where",), {}), force)
    job(report_fov, (("models",), {"nargs": "+"}))
    target, distance, alone = (("target",), {}), (("--distance",), {"type": float}), (("--intrinsics-only",), {"action": "store_true"})
    number, gridn = {"type": float}, (("--gridn",), {"type": int, "default": 60})
    job(rotate_corners, (("source",), {}), target, (("gridn",), {"type": int, "nargs": 2}), (("--turns",), {"type": int, "default": 1}), (("--where",), {}), (("--weight",), {"default": "level"}), force)
    job(reproject_points, (("points",), {}), (("source",), {}), (("to",), {}), target, alone, distance, force)
    job(within_region, (("points",), {}), (("model",), {}), target, force)
    job(triangulate, (("points",), {}), (("models",), {"nargs": 2}), target, (("--method",), {"default": "leecivera-mid2"}), (("--sigma",), number), (("--correlation",), {"type": float, "default": 0.0}), force)
    job(calibrate_cameras, (("corners",), {}), target, (("cameras",), {"nargs": "+", "help": "globs of file names, one a camera"}), (("--lensmodel",), {"required": True}), (("--focal",), {"type": float, "required": True}), (("--imagersize",), {"type": int, "nargs": 2, "required": True}), (("--object-width-height",), {"type": int, "nargs": 2, "required": True}), (("--object-spacing",), {"type": float, "required": True}), (("--weight",), {"default": "level"}), force)
    job(reproject_image, (("images",), {}), (("source",), {}), (("to",), {}), target, alone, distance)
    job(rectify, (("models",), {"nargs": 2}), (("images",), {"nargs": 2}), target, (("--az-fov-deg",), {"type": float, "required": True}), (("--el-fov-deg",), {"type": float, "required": True}), (("--rectification",), {"default": "LENSMODEL_LATLON"}))
    job(stereo_ranges, (("disparities",), {}), (("models",), {"nargs": 2}), target, (("--low",), {"type": float, "default": 0.0}), (("--high",), {"type": float, "default": float("inf")}), force)
    job(show, (("what",), {"choices": ["residuals", "geometry", "uncertainty", "resolution", "distortion", "splined-correction"]}), (("model",), {}), target, gridn, distance, force)
    job(difference, (("models",), {"nargs": "+"}), (("--target",), {"required": True}), gridn, distance, alone, force)
    job(graft, (("intrinsics",), {}), (("extrinsics",), {}))
    job(convert_lensmodel, (("to",), {}), (("model",), {}), (("--sampled",), {"action": "store_true"}), (("--gridn",), {"type": int, "default": 30}), (("--distance",), {"type": float, "default": 1.0}), (("--trials",), {"type": int, "default": 10}))
    job(query, (("name",), {}), (("tables",), {}), (("target",), {}), force)
    a = p.parse_args(argv)
    a.run(a)


if __name__ == "__main__":
    main()
