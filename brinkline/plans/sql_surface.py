"""The threshold search and its bins as functions for queries in SQL.

:func:`register` adds to a session

* ``threshold_cell(x)``: the grid cell of a value, an SQL function that the
  optimizer inlines (0 for null, as for all values up to the first point);
* ``right_closed_bin(x, edges)``: the number of the right-closed bin, from 1;
  null outside the edges and for null or NaN;
* ``threshold_f(TABLE (...) WITH SINGLE PARTITION)``: the statistic at each grid
  point.  The table has one row per cell (``cell, n, mean_x, mean_y, sxx, sxy,
  syy``, the sums of squares about the cell's own means), so the one task
  that reads it has as many rows as the grid has cells, whatever the input.

Rows of one cell that come in parts are added; cells without rows may be left
out, and rows that are null or count nothing add nothing; an empty table
gives null at every point.  More columns may follow in the table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..config import Settings
from ..operators.threshold import CURVE, f_curve


def cell_matrices(rows: list[tuple], cells: int) -> list[np.ndarray]:
    """Products of (1, x, y) by cell about the means of all rows, from moments about the means of each part."""
    part = np.array(rows, float).reshape(-1, 7)
    n, x, y = part[:, 1], part[:, 2], part[:, 3]
    if len(part):
        x, y = x - np.average(x, weights=n), y - np.average(y, weights=n)
    out = np.zeros((cells, 3, 3))
    one = np.ones(len(part))
    means = np.stack([one, x, y], axis=1)
    products = n[:, None, None] * means[:, :, None] * means[:, None, :]
    products[:, 1, 1] += part[:, 4]
    products[:, 1, 2] += part[:, 5]
    products[:, 2, 1] += part[:, 5]
    products[:, 2, 2] += part[:, 6]
    np.add.at(out, part[:, 0].astype(int), products)
    return list(out)


def curve_function(settings: Settings):
    grid, least = settings.grid, settings.min_regime

    class ThresholdF:
        def __init__(self):
            self.rows = []

        def eval(self, row):
            got = (row["cell"], row["n"], row["mean_x"], row["mean_y"], row["sxx"], row["sxy"], row["syy"])
            if None not in got and row["n"]:
                self.rows.append(got)

        def terminate(self):
            if not self.rows:
                yield from ((g, None) for g in grid)
                return
            yield from zip(grid, f_curve(cell_matrices(self.rows, len(grid) + 1), [0, 1], 2, least), strict=True)

    return udtf(ThresholdF, returnType=CURVE)


def register(spark: SparkSession, settings: Settings | None = None) -> None:
    settings = settings or Settings()
    points = ", ".join(f"{g!r}D" for g in settings.grid)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION threshold_cell(x DOUBLE) RETURNS INT RETURN CASE WHEN x IS NULL THEN 0 ELSE size(filter(array({points}), g -> g < x)) END")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION right_closed_bin(x DOUBLE, edges ARRAY<DOUBLE>) RETURNS INT RETURN "
        "CASE WHEN x IS NOT NULL AND NOT isnan(x) AND size(filter(edges, e -> e < x)) BETWEEN 1 AND size(edges) - 1 THEN size(filter(edges, e -> e < x)) END"
    )
    spark.udtf.register("threshold_f", curve_function(settings))
