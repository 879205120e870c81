"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from auditlake.llm._shared import stored, tidy


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node meets the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours meet the smallest of them. Every edge's v is smaller than its u here."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.hint("merge"), "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that an edge names; component is its smallest node.

    Edges stay distributed; the driver sees a count and a checksum a round. Joins are merge joins at every
    size: many rounds of broadcasts would add up on the driver. Nulls and loops are left out,
    an empty input gives an empty result.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.expr("u > v")).distinct()
    spark = edges.sparkSession
    seen = before = None
    while True:
        counted = Observation()  # of what the round writes: no second reading to see whether anything moved
        round_ = _small_star(_large_star(edges)).where("u > v").distinct()
        watched = round_.observe(counted, F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("mark"))
        edges = before = stored(watched, instead_of=before)
        mark = counted.get["n"], counted.get["mark"]
        if mark == seen:
            break
        seen = mark
    tidy(spark)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
