"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, met, written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return met(both, least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = met(e, least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least).distinct()


def _are_stars(e: DataFrame) -> bool:
    """Whether every node points to one other at most, and none that does is pointed to."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(e.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 or (out = 1 and in = 1)").limit(1).count()


def stars(edges: DataFrame, label: str = "stars") -> DataFrame:
    """(u, v): each node u that isn't the least of its component, with the least node v.

    `edges` has integer columns a and b. Minima are combined before shuffling, and the way back from a node to its edges is
    a join that splits hubs. Each round is a written table; their number grows with the logarithm of the longest chain.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), label)
    while not _are_stars(e):
        step = written(_small_star(_large_star(e)), label)
        dropped(e)
        e = step
    return e


def joined(forest: DataFrame, links: DataFrame, label: str = "stars") -> DataFrame:
    """The forest of an earlier one (u, v), whose table goes, and more links (a, b): only the roots that links join move."""
    root = lambda df, end: df.join(forest.toDF(end, "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    moves = stars(root(root(links.select("a", "b"), "a"), "b"), f"{label}-moves")
    if not moves.limit(1).count():
        dropped(moves)
        return forest
    moved = forest.join(moves.toDF("v", "root"), "v", "left").select("u", F.coalesce("root", "v").alias("v"))
    out = written(moved.union(moves), label)
    for table in (forest, moves):
        dropped(table)
    return out
