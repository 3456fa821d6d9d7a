"""Incremental reviews: an extension beyond one-off queries. Raw bodies arrive in a folder or from the live source; each
review id counts once: within a watermark, or for all time, in keyed state or in a stored table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational, tables
from ..sources import live

RAW = "app_id string, page_no int, fetched_at timestamp, body string"
KEY = ["app_id", "id"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_raw_stream(spark: SparkSession, path: str, files_each: int = 100) -> DataFrame:
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_each).parquet(path)


def read_token_stream(spark: SparkSession, **options: str) -> DataFrame:
    """Review pages of the live source as they are asked for, one of each read in a batch (see ``sources.live``)."""
    live.register(spark)
    raw = spark.readStream.format(live.Live.name()).options(kind="reviews", **options).load()
    return raw.select("app_id", "score_query", "page_no", F.timestamp_seconds("at").alias("fetched_at"), "body")


def new_reviews(raw: DataFrame, late: str = "7 days") -> DataFrame:
    """First sight of each (app_id, id) within the watermark; state is bounded by it."""
    rows = tables.reviews(raw).withWatermark("fetched_at", late)
    return rows.dropDuplicatesWithinWatermark(KEY)


def ever_new_reviews(raw: DataFrame) -> DataFrame:
    """First sight of each (app_id, id) for all time: nothing is forgotten, so the state has a key for each review.

    It is kept in RocksDB, on the executors' disks and in the checkpoint, not on their heaps; only the keys of a batch are looked up.
    """
    raw.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return tables.reviews(raw).dropDuplicates(KEY)


def merged(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over raw pages: adds the reviews that the table at ``path`` does not have yet, a folder for each batch.

    All time is remembered by the table itself, of which only the keys are read. A batch that is repeated after a failure is
    compared with the batches before it only, and replaces its own folder, so each review is there once.
    """

    def merge(raw: DataFrame, batch: int) -> None:
        spark, rows = raw.sparkSession, tables.reviews(raw)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if batch and folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            known = spark.read.schema("app_id string, id string, batch long").parquet(path).where(F.col("batch") < batch)
            rows = relational.unseen(rows, known, KEY, ["fetched_at", "page_no", "pos"])
        else:
            rows = relational.first_seen(rows, KEY, ["fetched_at", "page_no", "pos"])
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return merge


def scores_by_day(raw: DataFrame, late: str = "7 days") -> DataFrame:
    """Number and mean score of new reviews by app and day of fetching."""
    window = F.window("fetched_at", "1 day")
    return new_reviews(raw, late).groupBy(window, "app_id").agg(F.count("*").alias("n_reviews"), F.avg("score").alias("avg_score"))
