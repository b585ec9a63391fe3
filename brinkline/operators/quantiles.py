"""Exact quantiles of groups of any size in fixed memory.

A double's bits, read as a whole number, keep its order.  Values are counted
by group and the leading bits of that number; running counts name the bits
that hold each wanted rank, and only rows with these bits are counted by the
next ones.  Three passes settle all 64 bits whatever the distribution; ranks
whose bits hold one single value are settled earlier.  Counts are combined
before each shuffle, so neither a large group nor a frequent value meets in a
task; what a task holds is bounded by the number of different leading bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import small, written

SHIFTS = (42, 21, 0)


def order_key(value: Column) -> Column:
    """A long that orders as the double does; NaN above all, both zeros alike."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))).otherwise(bits)


def order_statistics(rows: DataFrame, ranks) -> DataFrame:
    """``g, n, wanted, value``: of each group ``g`` the ``value`` at each wanted rank, from 0.

    ``rows`` has ``g``, values ``v`` and longs ``k`` that order as they do;
    ``ranks(n)`` is an array of structs with a ``rank`` for a group of ``n``
    rows.  Of equal ranks each is given.
    """
    found, open_, before = [], None, None
    for shift in SHIFTS:
        left = rows
        if open_ is not None:
            wanted = open_.select("g", F.col("bits").alias("held")).distinct()
            left = rows.withColumn("held", F.shiftright("k", before)).join(small(wanted), ["g", "held"], "left_semi")
        # a key of a group's row holds the bits settled so far
        held = F.shiftright("k", before) if before is not None else F.lit(0).cast("long")
        counts = left.groupBy("g", held.alias("held"), F.shiftright("k", shift).alias("bits")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        group = W.partitionBy("g", "held")
        counts = counts.withColumn("first", F.coalesce(F.sum("n").over(group.orderBy("bits").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        if open_ is None:
            counts = counts.withColumn("all", F.sum("n").over(group))
            placed = counts.select("g", F.col("all"), "bits", "n", "first", "low", "high", F.explode(ranks(F.col("all"))).alias("wanted")).withColumn("rank", F.col("wanted.rank"))
        else:
            placed = counts.join(open_.select("g", F.col("bits").alias("held"), "all", "wanted", "rank"), ["g", "held"])
        inside = F.col("rank").between(F.col("first"), F.col("first") + F.col("n") - 1)
        placed = written(placed.filter(inside).select("g", "all", "wanted", "bits", (F.col("rank") - F.col("first")).alias("rank"), "low", "high"), "ranks")
        settled = F.col("low") == F.col("high") if shift else F.lit(True)  # NaN is equal to NaN here
        found.append(placed.filter(settled).select("g", F.col("all").alias("n"), "wanted", F.col("low").alias("value")))
        open_, before = placed.filter(~settled), shift
        if not open_.take(1):
            break
    return reduce(DataFrame.unionByName, found)


def smallest(df: DataFrame, key: Column, n: int) -> DataFrame:
    """The ``n`` rows of the smallest long ``key`` (nulls left out), all if there are fewer, without sorting
    the table: counts by leading bits give the key of the last one, and a filter the rows.

    Only rows with the very key of the last one pass through a limit, which is
    free to choose among them.
    """
    rows = df.withColumn("__k", key).filter("__k is not null")
    if n < 1:
        return rows.limit(0).drop("__k")
    last = order_statistics(rows.select(F.lit(0).alias("g"), F.col("__k").alias("v"), F.col("__k").alias("k")), lambda n_: F.filter(F.array(F.struct(F.lit(n - 1).cast("long").alias("rank"))), lambda w: w["rank"] < n_)).first()
    if last is None:
        return rows.drop("__k")
    below = rows.filter(F.col("__k") < last["value"])
    return below.unionByName(rows.filter(F.col("__k") == last["value"]).limit(n - below.count())).drop("__k")


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Columns ``by`` and one for each name in ``probs``: the quantile between the two nearest ranks.

    Nulls are left out (a group of nulls alone has no row), NaN counts as
    above all numbers.  Without ``by`` the whole table is one group.
    """
    place = lambda n, p: F.lit(p) * (n - 1).cast("double")
    each = lambda n: [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), f(place(n, p)).cast("long").alias("rank")) for name, p in probs.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    group = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(by)]) if by else F.lit(0)
    v = F.col(value).cast("double")
    found = order_statistics(df.filter(v.isNotNull()).select(group.alias("g"), v.alias("v"), order_key(v).alias("k")), lambda n: F.array(*each(n)))
    at = lambda name, side: F.max(F.when((F.col("wanted.name") == name) & (F.col("wanted.side") == side), F.col("value")))

    def between(name: str, p: float) -> Column:
        part = place(F.max("n"), p) - F.floor(place(F.max("n"), p))
        return F.when(at(name, "low") == at(name, "high"), at(name, "low")).otherwise((1 - part) * at(name, "low") + part * at(name, "high")).alias(name)

    out = found.groupBy("g").agg(*[between(name, p) for name, p in probs.items()])
    return out.select(*[F.col(f"g.c{i}").alias(c) for i, c in enumerate(by)], *probs)


def with_quantiles(summary: DataFrame, df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """A grouped summary, one row a group, with the quantiles of ``value``; null where a group has none."""
    found = exact_quantiles(df, by, value, probs)
    if not by:
        return summary.join(small(found), F.lit(True), "left")  # one row each
    found = found.select(*[F.col(c).alias(f"__{c}") for c in by], *probs)
    return summary.join(found, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]), "left").drop(*[f"__{c}" for c in by])
