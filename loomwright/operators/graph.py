"""Connected components of an edge table, with the graph kept in the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.sources.shared import discard, written

#: Nodes whose neighbours are joined by broadcast, at most: those with more than 1 / HEAVY of all edge ends (and over LIGHT).
HEAVY = 10_000
LIGHT = 256


def _with_least(pairs: DataFrame, ends: int) -> DataFrame:
    """pairs (u, v) with m, the least v of each u. ends: rows of pairs at most.

    Fewer than HEAVY nodes have over ends / HEAVY pairs, so theirs may be broadcast, and no task of the join gets a hub.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
    many = max(LIGHT, ends // HEAVY)
    hubs = F.broadcast(least.where(F.col("d") > many).select("u", "m"))
    rest = pairs.join(hubs, "u", "left_anti").join(least.where(F.col("d") <= many).select("u", "m"), "u")
    return pairs.join(hubs, "u").unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """Label (the least node) of each node of an undirected edge table (a, b); nodes are of any type that has an order.

    Alternates large-star and small-star steps until nothing changes; each step keeps the number of edges linear and is written
    to the shared folder, so a lost executor costs one step; a step's table goes when the next is there. Nothing but the number
    of edges and a sum of hashes reaches the driver.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    stamp = _stamp(now)
    while stamp["n"]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * stamp["n"]).select("u", "v", F.least("m", "u").alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        pairs = _with_least(large, 2 * stamp["n"])
        small = pairs.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = written(small, "edges")
        before, stamp = stamp, _stamp(after)
        discard(now)
        now = after
        if stamp == before:  # a star forest maps to itself
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _stamp(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
