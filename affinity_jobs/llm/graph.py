"""Connected components of a graph given as a table of links, by alternating star rounds.

Every round points each node's larger neighbours, then its smaller ones, at the least node in reach, so
paths shrink to stars in a number of rounds that grows with the log of their length. A round is joins and
partial aggregates on nodes; its result is written to the shared folder. Rounds end when only stars are left:
when each larger end of a link has that one link and is no smaller end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` of every linked node: the least node that it reaches. Loops and repeats are ignored."""
    stars = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    stars = cut(stars, "links")
    while not settled(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        stars = cut(small.distinct(), "stars")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def settled(links: DataFrame) -> bool:
    """Whether links ``u > v`` are stars around their least nodes."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    most = ends.groupBy("node").agg((F.sum("up") + F.max("low") * F.max("up")).alias("n")).agg(F.max("n").alias("n")).first()
    return (most["n"] or 0) <= 1
