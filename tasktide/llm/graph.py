"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Workspace


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(v, m) for each node v but the smallest of a component, m being that smallest node.

    edges has columns a and b; loops and repeated edges do no harm. Each step groups by node with a map-side minimum and
    joins it back, so no neighbour list is gathered. What is joined are written tables, whose sizes Spark knows: it
    broadcasts small ones, and adaptive execution splits a node that has very many edges. The number of steps grows with
    the logarithm of the diameter.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct()
    e, step, last = work.keep(e, f"{name}-0"), 0, None
    while True:
        both = e.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(e.select(F.col("m").alias("u"), F.col("v").alias("w")))
        low = work.keep(both.groupBy("u").agg(F.min("w").alias("w")).select("u", F.least("u", "w").alias("m")), f"{name}-low-{step}")
        large = work.keep(both.filter("w > u").join(low, "u").select(F.col("w").alias("v"), "m").distinct(), f"{name}-large-{step}")
        least = work.keep(large.groupBy("v").agg(F.min("m").alias("least")), f"{name}-least-{step}")
        small = large.join(least, "v").filter("m <> least").select(F.col("m").alias("v"), F.col("least").alias("m"))
        e = work.keep(small.unionByName(least.select("v", F.col("least").alias("m"))).distinct(), f"{name}-{step + 1}")
        for old in (f"{name}-{step}", f"{name}-low-{step}", f"{name}-large-{step}", f"{name}-least-{step}"):
            work.drop(old)
        step += 1
        now = e.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(20,0)"))).first()
        if now == last:
            return e
        last = now
