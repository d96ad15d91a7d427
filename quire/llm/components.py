"""Connected components of an edge table by alternating large and small stars; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, growing, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component (the smallest id reachable) of every id that has an edge to another one.

    Both stars are min-aggregations, combined before the exchange, and joins of two written tables, in which a hub can be split at run time.
    Ends when a round changes nothing; the number of rounds grows with the logarithm of the longest path.
    """
    state = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        # large star: every larger neighbour of u points to the least of u and its neighbours
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.filter("v > u").join(growing(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large)
        dropped(state, least)
        # small star: u and its smaller neighbours point to the least of them
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(growing(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        state = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        dropped(large, least)
        row = state.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).collect()[0]
        if (row["n"], row["x"]) == before:
            break
        before = (row["n"], row["x"])
    found = state.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())
