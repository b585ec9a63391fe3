"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` of every node with an edge; ``root`` is the smallest node that edges reach.

    Edges that lack an end or lead to their own start count for nothing.
    Minima are aggregated before they are shuffled.  Each step's tables are
    written to the shared folder, so the joins read plain tables and Spark
    can broadcast the small ones or split a hub's rows, and no step depends
    on executors that may be lost.
    """
    edge = F.filter(F.array(F.struct(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))), lambda e: e["u"] != e["v"])
    now = written(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.inline(edge)).distinct(), "edges")
    while not _stars(now):
        # every larger neighbour of a node goes to the smallest of its neighbourhood
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")), "least")
        large = written(now.join(least, "v").select("u", F.col("m").alias("v")).distinct(), "large")
        # every smaller neighbour of a node, and the node, go to the smallest of them
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        pair = lambda x: F.struct(F.greatest(x, "m").alias("u"), F.least(x, "m").alias("v"))
        small = large.join(low, "u").select(F.inline(F.filter(F.array(pair("u"), pair("v")), lambda e: e["u"] != e["v"])))
        after = written(small.distinct(), "edges")
        for old in (now, least, large, low):
            dropped(old)
        now = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one parent, which is the root of its star."""
    got = edges.agg(F.count("*").alias("n"), F.countDistinct("u").alias("k")).first()
    return got["n"] == got["k"] and edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi").isEmpty()
