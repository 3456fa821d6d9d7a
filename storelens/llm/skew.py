"""Joins of rows with a table of unique keys, where one key may stand in a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on (one in so many), so there are never more hot keys than this number.
SHARE = 1000
#: A hot key is dealt over so many parts.
SALTS = 64


def hot_of(counted: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """The hot keys of a table that has the number of rows by key: at most SHARE rows."""
    return counted.where((F.col(count) * SHARE >= total) & (F.col(count) >= SALTS)).select(*on)


def hot_keys(rows: DataFrame, on: list[str]) -> DataFrame:
    """The hot keys of ``rows``: at most SHARE rows. Only keys and their partial counts are exchanged."""
    return hot_of(rows.groupBy(*on).agg(F.count("*").alias("n")), on, "n", rows.count())


def salted_join(rows: DataFrame, keyed: DataFrame, on: list[str], hot: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed`` (unique keys): rows of a hot key are dealt out by a hash of ``by``, its partner is copied
    to each part. The list of hot keys is broadcast; ``hot_of`` bounds it."""
    mark = F.broadcast(hot.select(*on).withColumn("is_hot", F.lit(True)))
    left = rows.join(mark, on, "left").withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("is_hot")
    right = keyed.join(mark, on, "left").withColumn("salt", F.explode(F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("is_hot")
    return left.join(right, [*on, "salt"], how).drop("salt")
