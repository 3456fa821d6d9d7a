"""Statistics over reviews and apps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def recent(reviews: DataFrame, as_of: Column) -> DataFrame:
    """Reviews strictly after one calendar year before ``as_of``."""
    return reviews.where(F.col("date") > as_of - F.expr("INTERVAL 1 YEAR"))


def score_stats(reviews: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return reviews.groupBy(*by).agg(F.count("*").alias("n_reviews"), F.avg("score").alias("avg_score"))


def score_distribution(reviews: DataFrame) -> DataFrame:
    """``score, n, percent`` for scores 5 to 1, also those without a review."""
    spark = reviews.sparkSession
    scores = spark.range(1, 6).select(F.col("id").alias("score"))
    counts = reviews.groupBy("score").agg(F.count("*").alias("n"))
    dense = scores.join(F.broadcast(counts.where("score between 1 and 5")), "score", "left").select("score", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return dense.select("score", "n", F.when(total > 0, F.round(100 * F.col("n") / total, 1)).otherwise(0.0).alias("percent"))


def total(histogram: Column) -> Column:
    return F.aggregate(histogram, F.lit(0).cast("long"), lambda a, x: a + x)


def histogram_total(apps: DataFrame) -> DataFrame:
    return apps.select("app_id", total(F.col("histogram")).alias("total"))


def distinct_developers(results: DataFrame) -> DataFrame:
    return results.agg(F.count_distinct("developer").alias("n_developers"))


def repeated(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def report(reviews: DataFrame, by: Sequence[str] = ("app_id",)) -> DataFrame:
    """One row per group: number, mean, counts and percentages of 5 to 1 stars, and the latest review (ties by id).

    Texts of more than 200 characters are cut there and marked. One aggregation, one shuffle.
    """
    order = F.struct(-F.coalesce(F.unix_millis("date"), F.lit(-(1 << 62))), "id")
    counts = [F.count(F.when(F.col("score") == k, 1)).alias(f"n{k}") for k in (5, 4, 3, 2, 1)]
    first = F.min_by(F.struct("date", "score", "user_name", "text"), order).alias("_l")
    rows = reviews.groupBy(*by).agg(F.count("*").alias("n_reviews"), F.round(F.avg("score"), 2).alias("avg_score"), *counts, first)
    percents = [F.round(100 * F.col(f"n{k}") / F.col("n_reviews"), 1).alias(f"percent{k}") for k in (5, 4, 3, 2, 1)]
    text = F.when(F.length("_l.text") > 200, F.concat(F.left("_l.text", F.lit(200)), F.lit("..."))).otherwise(F.col("_l.text"))
    return rows.select(*by, "n_reviews", "avg_score", *[f"n{k}" for k in (5, 4, 3, 2, 1)], *percents, F.col("_l.date").alias("latest_date"), F.col("_l.score").alias("latest_score"), F.col("_l.user_name").alias("latest_user"), text.alias("latest_text"))


def latest(reviews: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """The n latest reviews of each group, with a preview of 200 characters."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("date"), "id"))
    return reviews.withColumn("n", rank).where(F.col("n") <= n).select(*by, "n", "id", "score", "date", F.left("text", F.lit(200)).alias("preview"))
