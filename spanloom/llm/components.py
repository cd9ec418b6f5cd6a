"""Connected components of a table of links, by random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.durable import durable


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): nodes that links join, directly or over others, share a root.

    Each round points every node to the neighbour of the smallest hash and merges along these pointers, so that the
    number of nodes left shrinks by a constant factor whatever the shape of the graph (chains included).  A round is
    one aggregation with map-side combining and two joins on plain keys, which adaptive execution splits when one node
    has very many links.  Links with a null end or equal ends join nothing; repeated links count once.  The root is
    one of the nodes, not necessarily the smallest.
    """
    left = durable(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    levels: list[DataFrame] = []
    while not left.isEmpty():
        salt = F.lit(len(levels) + 17)
        near = left.select(F.col("a").alias("node"), F.col("b").alias("near")).union(left.select("b", "a"))
        rank = F.struct(F.xxhash64(F.col("near"), salt).alias("h"), F.col("near").alias("n"))
        best = near.groupBy("node").agg(F.min(rank).alias("best"))
        own = F.struct(F.xxhash64(F.col("node"), salt).alias("h"), F.col("node").alias("n"))
        up = durable(best.select("node", F.least(own, F.col("best"))["n"].alias("root")), "pointers")
        levels.append(up)
        left = durable(
            left.join(up.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(up.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "links",
        )
    if not levels:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    out = levels[-1]
    for up in reversed(levels[:-1]):
        above = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = up.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return out
