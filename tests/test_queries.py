"""Every registered query of the calibration part against its SQL on the smallest tables."""

import datetime as dt
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from plumbline.plans import registry  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def norm(rows):
    def one(v):
        if v is None or v != v:
            return None
        return float(v) if isinstance(v, float) or hasattr(v, "as_tuple") else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = db.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    got = norm(df.select(*[f"`{c}`" for c in cols]).collect())
    exp = norm(want.select(*[f'"{c}"' for c in cols]).fetchall())
    assert len(got) == len(exp)
    for a, b in zip(got, exp, strict=True):
        assert a == pytest.approx(b, abs=2e-6, rel=1e-9) if all(isinstance(v, (int, float)) or v is None for v in a) and None not in a else a == b


def test_residuals_at_the_borders_of_bins(spark, tmp_path):
    """Frames, cameras, corners and weights whose residuals are multiples of 50 up to the last bit."""
    rows, order = [], 0
    for frame7, cam, corner, tenths in ((3, 0, 2, 7), (3, 3, 1, 7), (3, 1, 0, 7), (5, 0, 2, 9), (0, 2, 1, 10), (1, 0, 2, 8)):
        pixel = 180 * (corner + 2 * cam - 3) / (2 + frame7 / 2) + 1999.5
        for k in range(26):
            for j in range(-60, 60):
                if 0 <= (x := round(pixel - 500 * j / tenths, 2)) < 4000:
                    order += 7
                    rows += [(order + frame7, part, cam, 1, 5.0, 4000 * k + x if part == corner else 1000.0, (10 - tenths) / 100, dt.datetime(2000, 1, 1)) for part in range(corner + 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = c.sql(registry.oracle_sql()["residual_histogram"]).fetchall()
    assert sorted(map(tuple, registry.queries()["residual_histogram"](spark, str(tmp_path)).select("bin", "count").collect())) == sorted(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
