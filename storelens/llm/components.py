"""Connected components of a graph of links, by alternating large-star and small-star steps.

Each step replaces links by links to a smallest neighbour and keeps the components; the number of rounds grows
with the logarithm of the longest chain. Steps are aggregations and joins, written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, stash


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    joined = down.join(low, "a")
    return joined.select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b").unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``key, label`` of every node of ``links`` (a, b) but the least of each component; label is that least node."""
    links, before = stash(_small(links.select("a", "b"))), None
    while (now := _state(links)) != before:
        before, last = now, links
        links = stash(_small(_large(last)))
        discard(last)
    return links.select(F.col("a").alias("key"), F.col("b").alias("label"))
