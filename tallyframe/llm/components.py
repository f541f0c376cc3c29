"""Connected components of a graph of links, by star contraction: each step is one aggregation and one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the least of its neighbours and itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours and itself to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return least.select("a", F.col("least").alias("b")).unionByName(moved)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b), component being the smallest node that can be reached.

    Links from a node to itself are ignored. No links give no rows. The number of steps grows with the logarithm of
    the longest chain; every step is written to the shared folder, and the one before is deleted.
    """
    links = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    before = None
    while True:
        links = stored(_small_star(_large_star(links)).distinct(), "links", replaces=[links])
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = nodes.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out._shared_folder = links._shared_folder  # so that it can be released
    return out
