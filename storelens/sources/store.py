"""The raw store: bodies as they were fetched, in Parquet, split by kind and locale so that scans prune."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT = ["kind", "lang", "country"]


def write_raw(raw: DataFrame, path: str, mode: str = "append") -> None:
    raw.write.mode(mode).partitionBy(*SPLIT).parquet(path)


def read_raw(spark: SparkSession, path: str, kind: str, lang: str | None = None, country: str | None = None) -> DataFrame:
    raw = spark.read.parquet(path).where(F.col("kind") == kind)
    for name, value in (("lang", lang), ("country", country)):
        if value is not None:
            raw = raw.where(F.col(name) == value)
    return raw


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages, one file each: ``url`` (the file) and ``body``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("body"))
