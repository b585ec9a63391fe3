"""Right-closed binning and rounding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equal_edges(low: float, high: float, bins: int) -> list[float]:
    """Edges of equal width, the first a little lower so that the minimum falls inside."""
    if low == high:
        room = 0.001 * abs(low) if low else 0.001
        return [float(e) for e in np.linspace(low - room, high + room, bins + 1)]
    edges = np.linspace(low, high, bins + 1)
    edges[0] -= 0.001 * (high - low)
    return [float(e) for e in edges]


def cut(value: Column, edges: list[float]) -> Column:
    """Number of the right-closed bin, from 1; null outside and for null or NaN."""
    below = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < value))
    return F.when(value.isNotNull() & ~F.isnan(value.cast("double")) & below.between(1, len(edges) - 1), below)


def equal_width(df: DataFrame, column: str, bins: int, to: str) -> DataFrame:
    """Add the equal-width bin of a column over the whole table; needs one pass for its range."""
    value = F.col(column).cast("double")
    low, high = df.filter(~F.isnan(value)).agg(F.min(value), F.max(value)).first()
    return df.withColumn(to, F.lit(None).cast("int") if low is None else cut(value, equal_edges(low, high, bins)))


def label(bin_: Column, labels: list[str]) -> Column:
    """Fixed label of a bin, whatever the range of the data."""
    return F.get(F.array(*map(F.lit, labels)), bin_ - 1)


def spread_labels(low: float, high: float, bins: int, digits: int) -> list[str]:
    return [f"{x:.{digits}f}" for x in np.linspace(low, high, bins)]


def half_even(value: Column) -> Column:
    """Rounding of halves to the even integer."""
    return F.rint(value)


def clipped(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.rint(value)))


def observed_label(value: Column) -> Column:
    return F.concat(F.lit("κ_obs = "), value.cast("string"))
