"""Connected components by alternating large-star and small-star steps, wholly in DataFrames.

Each step replaces edges by edges to the smallest neighbour; the number of rounds grows with the logarithm of the diameter.
Hubs are joined through plain equi-joins on counted minima, which adaptive execution may split; nothing goes to the driver
but one number per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.llm.shared import cut, drop


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    """Edges (u > v) after one large-star and one small-star step."""
    both = edges.union(edges.select("v", "u"))
    least = _least(both).withColumn("m", F.least("u", "m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = _least(large)
    return large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either one centre or the end of one edge: nothing is left to do."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("centre")).union(edges.select("v", F.lit(0), F.lit(1)))
    worst = ends.groupBy("id").agg((F.sum("up") + F.max("centre")).alias("n")).agg(F.max("n")).first()[0]
    return (worst or 0) <= 1


def components(links: DataFrame, name: str) -> DataFrame:
    """Links (a, b) to (id, component): every id that some link between different ids names, with the smallest id it reaches."""
    edges = cut(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-edges")
    while not _stars(edges):
        after = cut(_round(edges), f"{name}-edges")
        drop(edges)
        edges = after
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
