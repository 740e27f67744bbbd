"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import calibration, files, formulas, geometry, solvers

MODULES = (calibration, formulas, solvers, geometry, files)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: corners joined with frames and cameras, projected, ranked from the worst observation."""
    return calibration.per_observation(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
