"""Communities of a neighbour graph by modularity: vertices move in rounds, then communities become vertices.

The graph is a table of undirected edges, the partition a table of vertices; a round is joins and sums over them. A vertex proposes
the neighbouring community of most gain. A round takes half of the proposals, by a hash, if modularity rises by
them together; else only proposals of which no two touch the same community, whose gains add up. So modularity never falls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.sources.scratch import release, stored


def undirected(pairs: DataFrame, a: str = "id", b: str = "other") -> DataFrame:
    """(a, b, w = 1.0), both ways, once each, from pairs either way."""
    one = pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("w", F.lit(1.0))


def modularity(edges: DataFrame, places: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row, modularity, of a partition (id, c) of both-way edges (a, b, w)."""
    named = edges.join(places.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(places.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
    by = named.groupBy("ca").agg(F.sum("w").alias("degree"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inner"))
    all_ = F.sum("degree")
    return by.agg((F.sum("inner") / all_ - resolution * F.sum(F.col("degree") * F.col("degree")) / (all_ * all_)).alias("modularity"))


def _proposals(edges: DataFrame, places: DataFrame, total: float, resolution: float) -> DataFrame:
    """(id, c, to, gain) of the vertices that gain by a move; of equal gains the smallest community."""
    degree = edges.groupBy("a").agg(F.sum("w").alias("k")).withColumnRenamed("a", "id")
    held = degree.join(places, "id")
    sizes = held.groupBy("c").agg(F.sum("k").alias("size"))
    near = edges.where("a <> b").join(places.select(F.col("id").alias("b"), F.col("c").alias("to")), "b").groupBy(F.col("a").alias("id"), "to").agg(F.sum("w").alias("links"))
    met = near.join(held, "id").join(sizes.select(F.col("c").alias("to"), F.col("size").alias("to_size")), "to").join(sizes, "c")
    own = F.col("to") == F.col("c")
    # of the links to a community, less what chance gives; its own without the vertex itself
    worth = F.col("links") - resolution * F.col("k") * (F.col("to_size") - F.when(own, F.col("k")).otherwise(0.0)) / total
    alone = -resolution * F.col("k") * (F.col("size") - F.col("k")) / total
    best = met.withColumn("worth", worth).groupBy("id", "c").agg(
        F.max_by(F.struct("to", "worth"), F.struct(F.when(own, None).otherwise(F.round("worth", 12)), -F.col("to"))).alias("best"),
        F.max(F.when(own, F.col("worth"))).alias("stay"), F.max(alone).alias("alone"),
    )
    gain = (F.col("best.worth") - F.coalesce("stay", "alone")) * 2 / total
    return best.select("id", "c", F.col("best.to").alias("to"), gain.alias("gain")).where("gain > 1e-12 and to <> c")


def _apart(moves: DataFrame) -> DataFrame:
    """The proposals that are the best of both communities they touch."""
    order = F.struct("gain", -F.col("id"))
    touched = moves.select(F.explode(F.array("c", "to")).alias("x"), "id", "gain").groupBy("x").agg(F.max_by("id", order).alias("winner"))
    side = lambda col, name: touched.select(F.col("x").alias(col), F.col("winner").alias(name))
    return moves.join(side("c", "_w1"), "c").join(side("to", "_w2"), "to").where("_w1 = id and _w2 = id").select("id", "c", "to", "gain")


def _moved(places: DataFrame, moves: DataFrame) -> DataFrame:
    return places.join(moves.select("id", "to"), "id", "left").select("id", F.coalesce("to", "c").alias("c"))


def modularity_clusters(edges: DataFrame, rounds: int = 40, resolution: float = 1.0, least: float = 1e-4) -> tuple[DataFrame, list[float]]:
    """(id, c), c being the smallest id of its community, and modularity after each round.

    edges: (a, b, w) both ways, ids long. A level ends when a round gains less than `least`; then
    its communities are the next level's vertices, and the last level is the one that gains no more. rounds bounds all levels together.
    """
    edges = stored(edges.select("a", "b", "w"))
    total = edges.agg(F.sum("w")).first()[0]
    whole = stored(edges.select(F.col("a").alias("id")).distinct().withColumn("c", F.col("id")))
    if total is None:
        return whole, []
    level, history, now = edges, [], modularity(edges, whole, resolution).first()[0]
    while len(history) < rounds:
        places = stored(level.select(F.col("a").alias("id")).distinct().withColumn("c", F.col("id")))
        began = now
        while len(history) < rounds:
            moves = stored(_proposals(level, places, total, resolution))
            half = moves.where(F.pmod(F.xxhash64("id", F.lit(len(history))), F.lit(2)) == 0)
            tried = stored(_moved(places, half))
            then = modularity(level, tried, resolution).first()[0]
            if then <= now + 1e-12:
                release(edges.sparkSession, tried)
                tried = stored(_moved(places, _apart(moves)))
                then = modularity(level, tried, resolution).first()[0]
            release(edges.sparkSession, moves, places)
            places, gained, now = tried, then - now, max(then, now)
            history.append(now)
            if gained < least:
                break
        names = places.withColumnRenamed("c", "to").withColumnRenamed("id", "c")
        whole = stored(whole.join(names, "c").select("id", F.col("to").alias("c")), whole)
        if now - began < least:
            break
        side = lambda col, name: places.select(F.col("id").alias(col), F.col("c").alias(name))  # noqa: E731, B023
        joined = level.join(side("a", "x"), "a").join(side("b", "y"), "b")
        level = stored(joined.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")))
    smallest = whole.groupBy("c").agg(F.min("id").alias("least"))
    return stored(whole.join(smallest, "c").select("id", F.col("least").alias("c"))), history
