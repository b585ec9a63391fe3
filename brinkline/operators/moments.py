"""Sums of outer products in few scans: a cube of moments, sliced by every estimator.

One scan sums the products of all columns by cell and by which columns are
missing.  The moments of the rows on which given columns are numbers are then
sums of its parts, so least squares, instruments, the endogeneity test and
the threshold search read the rows once.  What needs residuals follows in a
second scan for all of them (:func:`products`).
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHIFT_ROWS = 1_000  # rows whose means the columns are shifted by; any shift gives the same results but for rounding


def number(column: str) -> Column:
    """Whether a column is a number."""
    value = F.col(column).cast("double")
    return value.isNotNull() & ~F.isnan(value)


def all_numbers(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, map(number, columns))


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows on which all the columns are numbers."""
    return df.filter(all_numbers(columns))


def shifts(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Means of the first rows."""
    row = df.select(*[F.when(number(c), F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).limit(SHIFT_ROWS).agg(*[F.avg(f"m{i}") for i in range(len(columns))]).first()
    return {c: row[i] if row[i] is not None else 0.0 for i, c in enumerate(columns)}


def centred(column: str, mean: dict[str, float]) -> Column:
    return F.col(column).cast("double") - F.lit(mean[column])


@dataclass
class Moments:
    """``matrix[i, j]``: sum of products of the columns, a constant 1 first."""

    columns: list[str]
    mean: dict[str, float]
    matrix: np.ndarray

    @property
    def n(self) -> float:
        return float(self.matrix[0, 0])

    def at(self, columns: list[str]) -> list[int]:
        return [0 if c == "const" else 1 + self.columns.index(c) for c in columns]

    def block(self, rows: list[str], columns: list[str]) -> np.ndarray:
        return self.matrix[np.ix_(self.at(rows), self.at(columns))]


@dataclass
class Products:
    """Outer products of ``terms`` to be summed with a weight by cell; rows without weight do not count."""

    terms: list[Column]
    weight: Column | None = None
    cell: Column | None = None


def products(df: DataFrame, wanted: list[Products]) -> list[dict[int, np.ndarray]]:
    """The sums (k x k) of each of the wanted products by cell, in one scan of the rows.

    Inputs are projected once; each task adds up its matrices and sends one row for each, which Spark sums.
    """
    columns, places = [], []
    for w in wanted:
        places.append((len(columns), len(w.terms)))
        columns += [(F.lit(0) if w.cell is None else w.cell).cast("double"), (F.lit(1.0) if w.weight is None else w.weight).cast("double"), *[t.cast("double") for t in w.terms]]
    rows = df.select(*[c.alias(f"t{i}") for i, c in enumerate(columns)])

    def run(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            values = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            for j, (at, k) in enumerate(places):
                c, w = values[at], values[at + 1]
                live = ~np.isnan(w)
                x = np.stack([v[live] for v in values[at + 2 : at + 2 + k]], axis=1)
                c, w = c[live].astype(np.int64), w[live]
                for one in np.unique(c).tolist():
                    mine = slice(None) if c[0] == one and (c == one).all() else c == one
                    total[j, one] = total.get((j, one), 0.0) + x[mine].T @ (x[mine] * w[mine][:, None])
        keys = list(total)
        yield pa.record_batch({"j": pa.array([j for j, _ in keys], pa.int32()), "c": pa.array([c for _, c in keys], pa.int64()), "m": pa.array([total[k].ravel() for k in keys], pa.list_(pa.float64()))})

    sums = rows.mapInArrow(run, "j int, c long, m array<double>").select("j", "c", F.posexplode("m").alias("at", "v")).groupBy("j", "c", "at").agg(F.sum("v").alias("v"))
    out = [defaultdict(lambda k=k: np.zeros(k * k)) for _, k in places]
    for j, c, at, v in sums.collect():  # at most cells times k * k rows for each
        out[j][c][at] = v
    return [{c: m.reshape(k, k) for c, m in one.items()} for one, (_, k) in zip(out, places, strict=True)]


@dataclass
class Cube:
    """Sums of outer products of shifted columns, a constant 1 first, by cell and by the columns that are
    missing (bit ``i`` for column ``i``; a missing value counts as 0 and its sums are not used)."""

    columns: list[str]
    mean: dict[str, float]
    cells: int
    parts: dict[int, np.ndarray]

    def slices(self, columns: list[str]) -> list[Moments]:
        """Moments of the rows on which the columns are numbers, for each cell."""
        at = [0, *[1 + self.columns.index(c) for c in columns]]
        needed = sum(1 << (i - 1) for i in at[1:])
        out = [np.zeros((len(at), len(at))) for _ in range(self.cells)]
        for key, m in self.parts.items():
            missing, cell = divmod(key, self.cells)
            if not missing & needed:
                out[cell] += m[np.ix_(at, at)]
        return [Moments(list(columns), self.mean, m) for m in out]

    def of(self, columns: list[str]) -> Moments:
        return Moments(list(columns), self.mean, np.sum([m.matrix for m in self.slices(columns)], axis=0))


def cube(df: DataFrame, columns: list[str], cell: Column | None = None, cells: int = 1) -> Cube:
    """All moments of the columns by cell 0 .. ``cells`` - 1, in one scan."""
    columns = list(dict.fromkeys(columns))
    mean = shifts(df, columns)
    terms = [F.lit(1.0), *[F.when(number(c), centred(c, mean)).otherwise(0.0) for c in columns]]
    missing = reduce(lambda a, b: a + b, [F.when(number(c), 0).otherwise(1 << i).cast("long") for i, c in enumerate(columns)])
    return Cube(columns, mean, cells, products(df, [Products(terms, cell=missing * cells + (F.lit(0) if cell is None else cell))])[0])


def gram(df: DataFrame, columns: list[str]) -> Moments:
    return cube(df, columns).of(columns)


def solve(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(xx, rcond=1e-12, hermitian=True) @ xy


def residual_sum(m: np.ndarray, x: list[int], y: int) -> np.ndarray:
    """Residual sums of squares of column ``y`` on the columns ``x``, of one matrix or of a stack of them."""
    xy = m[..., x, y]
    b = np.linalg.pinv(m[..., np.array(x)[:, None], x], rcond=1e-12, hermitian=True) @ xy[..., None]
    return m[..., y, y] - (xy[..., None, :] @ b)[..., 0, 0]
