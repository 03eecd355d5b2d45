"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import every_column, written

MOST_BROADCAST = 1_000_000


def components(links: DataFrame, folder: str) -> DataFrame:
    """node, component (its smallest node) of every node that has a link (a, b); all else is alone."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = written(edges, f"{folder}/edges0")
    turn, state, n = 0, None, edges.count()
    if not n:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Written where it is too large to send, so that Spark can split the join at a node with very many links.
        least = F.broadcast(least) if 2 * n <= MOST_BROADCAST else written(least, f"{folder}/least{turn}")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(small).distinct()
        turn += 1
        edges = written(edges, f"{folder}/edges{turn}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state, n = now, now[0]


def only(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join with written ids, which are broadcast if they are at most MOST_BROADCAST; columns stay in order."""
    return rows.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, key, how).select(every_column(rows))
