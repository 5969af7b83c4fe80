"""Connected components of a graph of links, by alternating large and small stars.

Each round replaces links by links to smaller neighbours and is written to the shared folder. The least neighbour of each
node is aggregated, so a node with very many links is never gathered; the number of links doesn't grow. Where links are
joined to the least neighbour of a node, nodes with more than their HUBSth of all links get it by broadcast (there are
HUBS times two of them at most), so that a hub's links stay spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import materialise

HUBS, LEAST_HUB = 50_000, 64


def _with_least(links: DataFrame, key: str, least: DataFrame, n: int) -> DataFrame:
    """links with the column least of the row for their key in least(key, least, n)."""
    hub = F.col("n") > max(LEAST_HUB, n // HUBS)
    spread = links.join(F.broadcast(least.where(hub).select(key, "least")), key, "left")
    rest = spread.where("least IS NULL").drop("least").join(least.where(~hub).select(key, "least"), key)
    return spread.where("least IS NOT NULL").select("low", "high", "least").unionByName(rest.select("low", "high", "least"))


def _star(links: DataFrame, n: int) -> DataFrame:
    """Large star, then small star, of n links(low, high) with low < high."""
    both = links.unionByName(links.select(F.col("high").alias("low"), F.col("low").alias("high")))
    least = both.groupBy("low").agg(F.least(F.min("high"), F.first("low")).alias("least"), F.count(F.lit(1)).alias("n"))
    large = _with_least(links, "low", least, n).select(F.col("least").alias("low"), "high").where("low < high").distinct()
    least = large.groupBy("high").agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("n"))
    small = _with_least(large, "high", least, n).where("low > least").select(F.col("least").alias("low"), F.col("low").alias("high"))
    return small.unionByName(least.select(F.col("least").alias("low"), "high")).distinct()


def _stars(links: DataFrame) -> tuple[int, bool]:
    """How many links there are, and whether they are stars already: each node has one smaller neighbour, or only greater
    ones. A round leaves stars as they are, and anything else changes until it is."""
    end = lambda name, is_high: links.select(F.col(name).alias("node"), F.lit(is_high).alias("up"), F.lit(1 - is_high).alias("down"))
    nodes = end("high", 1).unionByName(end("low", 0)).groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    n, other = nodes.agg(F.sum("up"), F.count_if(F.expr("up > 1 OR up = 1 AND down > 0"))).first()
    return n or 0, not other


def components(links: DataFrame) -> DataFrame:
    """links(low long, high long), low < high, to (node, root): a row for each node but the roots, root the least node."""
    links = materialise(links.select("low", "high").distinct(), "links")
    n, done = _stars(links)
    while not done:
        links = materialise(_star(links, n), "links")
        n, done = _stars(links)
    return links.select(F.col("high").alias("node"), F.col("low").alias("root"))
