"""Connected components of an edge table by alternating star contraction, without any group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

MAX_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    """Order-free fingerprint of a set of edges: one row to the driver."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """``(node, component)`` for every node that has an edge; the component is its smallest node.

    Large-star and small-star steps in turn hang every node on the smallest neighbour until nothing changes, which
    takes few rounds even for long chains. A step is a minimum per node, combined before the shuffle, and a join of
    the edges with one row per node, whose hot keys adaptive execution splits. Each round is written to the shared
    folder. Nulls at either end and self links are left out; repeated edges count once.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = stored(e.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct(), f"{name}-0")
    before = _mark(e)
    for step in range(1, MAX_ROUNDS + 1):
        if before[0] == 0:
            break
        # large star: neighbours above u hang on the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        # small star: the lower neighbours of u, and u, hang on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        e = stored(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{step}")
        after = _mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    hung = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return hung.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
