"""Connected components of an edge table by alternating star operations.

Every round turns the edges into stars around smaller labels: *large star*
connects each node's greater neighbours to its least neighbour, *small star*
connects its smaller neighbours and itself to it (Kiveris et al., 2014).  Rounds
are joins and combining aggregations; each round's edges are written to the
shared folder, so lineage stays short.  The number of rounds grows with the
logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges ``(u, v)``, ``u > v``, after one star operation."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)``: the least node reachable, for every node that has an edge."""
    spark = edges.sparkSession
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), spark, "edges")
    before = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen[0] == 0 or tuple(seen) == before:
            break
        before = tuple(seen)
        now = materialize(_star(_star(now, True), False), spark, "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
