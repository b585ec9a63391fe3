"""Functions for queries in SQL against the library's own search and bins."""

import random

import pytest
from pyspark.sql import functions as F

from brinkline.config import Settings
from brinkline.functions import binning
from brinkline.operators import threshold
from brinkline.plans import sql_surface

CELLS = """SELECT threshold_cell(x) AS cell, count(*) AS n, avg(x) AS mean_x, avg(y) AS mean_y, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy, 'more' AS note
FROM some_rows WHERE x IS NOT NULL AND y IS NOT NULL {more} GROUP BY threshold_cell(x){by}"""


def rows(spark):
    rnd = random.Random(4)
    made = [(x := rnd.uniform(0, 17), 1e6 + 3 * x + 5 * (x > 7) + rnd.gauss(0, 1)) for _ in range(3000)]
    return spark.createDataFrame([*made, (None, 1.0), (3.0, None), (2.0, 1e6), (15.0, 1e6)], "x double, y double")


@pytest.mark.parametrize("by", ["", ", pmod(hash(y), 3)"])
def test_curve_in_sql(spark, by):
    df, settings = rows(spark), Settings(min_regime=50)
    df.createOrReplaceTempView("some_rows")
    sql_surface.register(spark, settings)
    got = {r["gamma"]: r["f_stat"] for r in spark.sql(f"SELECT * FROM threshold_f(TABLE ({CELLS.format(more='', by=by)}) WITH SINGLE PARTITION)").collect()}
    want = threshold.search(df, "y", "x", [], settings)
    assert got == pytest.approx(dict(zip(want.grid, want.curve, strict=True)), rel=1e-6) and max(got, key=got.get) == 7.0
    none = spark.sql(f"SELECT * FROM threshold_f(TABLE ({CELLS.format(more='AND x < 0', by='')}) WITH SINGLE PARTITION)").collect()
    assert all(r["f_stat"] is None for r in none)


def test_bins_in_sql(spark):
    sql_surface.register(spark)
    df = spark.createDataFrame([(v,) for v in (None, float("nan"), -1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 2.5, float("inf"))], "x double")
    df.createOrReplaceTempView("some_rows")
    got = [r[0] for r in spark.sql("SELECT right_closed_bin(x, array(0.0D, 1.0D, 2.0D)) FROM some_rows").collect()]
    assert got == [r[0] for r in df.select(binning.cut(F.col("x"), [0.0, 1.0, 2.0])).collect()] == [None, None, None, None, 1, 1, 2, 2, None, None]
    cells = df.select(F.expr("threshold_cell(x)"), threshold.cell_of(F.col("x"), Settings().grid)).filter("x is not null and not isnan(x)").collect()
    assert all(a == b for a, b in cells)
