"""Ordered limits, first-seen de-duplication, fallback sections, enrichment, and the paged queries made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import RESULT, Sort
from . import tables

#: Order of reviews by sort code; ties by id.
REVIEW_ORDER = {Sort.HELPFULNESS: "thumbs_up", Sort.NEWEST: "date", Sort.RATING: "score"}


def first_n(rows: DataFrame, n: int, order: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in ``order``, of each group of ``by`` if given. Row filters come before."""
    if n < 0:
        raise ValueError("a number of rows can't be negative")
    if not by:
        return rows.orderBy(*order).limit(n)
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_n") <= n).drop("_n")


def first_seen(rows: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row for each key: the first in ``order``."""
    return first_n(rows, 1, order, keys)


def unseen(rows: DataFrame, known: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """``first_seen`` of the rows whose keys ``known`` does not have, however long ago it got them."""
    return first_seen(rows.join(known.select(*keys), list(keys), "left_anti"), keys, order)


def chart(rows: DataFrame, collection: str, n: int, by: Sequence[str], order: Sequence[str] = ("section_no", "pos")) -> DataFrame:
    """The first n apps of the collection's section; if it has none, of all sections in their order."""
    section = tables.section_of(collection)
    own = F.max((F.col("section_no") == section).cast("int")).over(Window.partitionBy(*by))
    kept = rows.withColumn("_own", own).where((F.col("section_no") == section) | (F.col("_own") == 0)).drop("_own")
    return first_n(kept, n, order, by)


def enrich(results: DataFrame, apps: DataFrame) -> DataFrame:
    """Replace whole results by their details where there are any; order, number and ordinals stay.

    Details are those of the app in the result's locale, where both sides have ``lang`` and ``country``. Of several
    details of an app the one that was updated last counts, then the greatest by its columns. The join is a merge: Spark takes
    parsed rows for as small as the file they come from, and would send all details through the driver to every executor.
    """
    keys = ["app_id", *[c for c in ("lang", "country") if c in results.columns and c in apps.columns]]
    latest = apps.groupBy(*keys).agg(F.max(F.struct("updated", F.struct(*RESULT).alias("app"))).alias("_d"))
    details = latest.select(*[F.col(k).alias("_id" if k == "app_id" else f"_{k}") for k in keys], F.col("_d.app").alias("_app"))
    same = [F.col(k) == F.col("_id" if k == "app_id" else f"_{k}") for k in keys]
    joined = results.join(details.hint("merge"), same, "left")
    own = F.struct(*RESULT)
    keep = [c for c in results.columns if c not in RESULT]
    return joined.select(*keep, F.when(F.col("_id").isNotNull(), F.col("_app")).otherwise(own).alias("_r")).select(*keep, "_r.*")


def price_code(price: str) -> int:
    return {"free": 1, "paid": 2}.get(price.lower(), 0)


def by_price(results: DataFrame, price: str) -> DataFrame:
    code = price_code(price)
    return results if not code else results.where("free" if code == 1 else "not free")


def search(first: DataFrame, more: DataFrame, n: int, by: Sequence[str] = ("term",)) -> DataFrame:
    """First and further pages of searches as one ordered list of at most n results each.

    A search ends behind its first page without a token, and before its first page in error.
    """
    pages = tables.search_first_pages(first).unionByName(tables.search_more_pages(more))
    ends = (F.col("status") == "error") | (F.col("next_token") == "")
    before = Window.partitionBy(*by).orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    read = pages.withColumn("_over", F.max(ends).over(before)).where(~F.coalesce("_over", F.lit(False))).drop("_over")
    return first_n(tables.exploded(read), n, ["page_no", "pos"], by)


#: A cluster's details and its apps are each dealt into so many parts, and the cells of that grid over so many tasks.
GRID, TASKS = 8, 200


def similar(details: DataFrame, clusters: DataFrame) -> DataFrame:
    """Two hops: the cluster of each details page (app_id, lang, country), then the apps of the cluster's page (url).

    A page is read once, however many details name it. The result has a row for each of a cluster's details and apps. So both
    are dealt, and a part of the details meets each part of the apps in a cell of its own: a task holds one cell's details and
    the rows of one app. The number of tasks is fixed, as the bytes they read say nothing about the rows they make.
    """
    hop = tables.similar_cluster(details).where("cluster_url is not null")
    hop = hop.select(F.col("app_id").alias("source_app_id"), tables.cluster_page_url(F.col("cluster_url"), F.col("lang"), F.col("country")).alias("page_url"))
    apps = tables.similar(clusters.select(F.col("url").alias("page_url"), "body"))
    found = [c for c in apps.columns if c != "page_url"]
    part = lambda *names: F.pmod(F.xxhash64(*names), F.lit(GRID)).cast("int")
    each = F.explode(F.array(*[F.lit(k) for k in range(GRID)]))
    cell = ["page_url", "_row", "_column"]
    dealt = hop.select("*", part("source_app_id").alias("_row")).select("*", each.alias("_column")).repartition(TASKS, *cell)
    sent = apps.select("*", part("app_id", "pos").alias("_column")).select("*", each.alias("_row")).repartition(TASKS, *cell)
    # the side that is held for a key has the short rows; not by the size of the file, see ``enrich``
    return sent.join(dealt.hint("merge"), cell).select("source_app_id", *found)


def similar_errors(details: DataFrame) -> DataFrame:
    return tables.similar_cluster(details).where("cluster_url is null").select("app_id", F.lit("similar apps not found").alias("error"))


def score_filter(reviews: DataFrame, score: int) -> DataFrame:
    """Scores 1 to 5 filter; any other value means all."""
    return reviews.where(F.col("score") == score) if 1 <= score <= 5 else reviews


def sort_reviews(reviews: DataFrame, sort: Sort) -> DataFrame:
    return reviews.orderBy(F.desc(REVIEW_ORDER[sort]), "id")


def _read_pages(pages: DataFrame, total: int, by: Sequence[str], fields: Sequence[str] | None = None) -> DataFrame:
    """The typed pages that are read for a total: up to the first that is empty, in error or without a token, or until the total is there.

    ``_before`` is the number of reviews on the pages before.
    """
    if total < 0:
        raise ValueError("a number of rows can't be negative")
    n = F.coalesce(F.size("items"), F.lit(0))
    ends = (F.col("status") != "ok") | (n == 0) | (F.col("next_token") == "")
    before = Window.partitionBy(*by).orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    known = tables.typed_review_pages(pages, fields).withColumn("_over", F.max(ends).over(before)).withColumn("_before", F.coalesce(F.sum(n).over(before), F.lit(0)))
    return known.where(~F.coalesce("_over", F.lit(False)) & (F.col("_before") < total)).drop("_over")


def reviews_all(pages: DataFrame, total: int, by: Sequence[str] = ("app_id",), fields: Sequence[str] | None = None) -> DataFrame:
    """Reviews of consecutive pages up to a total: reading ends behind the first page that is empty, in error, or without a token."""
    return first_n(tables.exploded(_read_pages(pages, total, by, fields).drop("_before")), total, ["page_no", "pos"], by)


def reviews_all_errors(pages: DataFrame, total: int, by: Sequence[str] = ("app_id",)) -> DataFrame:
    """The error that ended a read, if one did: ``page_no, error, n_reviews`` (what the read gives in spite of it). Pages that
    the read never comes to are not asked, so their errors do not count."""
    read = _read_pages(pages, total, by, ["id"]).where("status = 'error'")
    return read.select(*by, "page_no", "error", F.col("_before").cast("long").alias("n_reviews"))


def reviews_outcome(pages: DataFrame, total: int, by: Sequence[str] = ("app_id",)) -> DataFrame:
    """Both of one read, for which each page is parsed once: the reviews of ``reviews_all``, and behind them, where an error ended
    the read, one row with it in ``failed`` (NULL for reviews) and no review. ``parted`` takes the two apart."""
    read = _read_pages(pages, total, by).drop("_before")
    wrong = F.col("status") == "error"
    one = F.array(F.get("items", F.lit(0)))  # a page in error has no items: a single row without a review
    read = read.withColumn("failed", F.when(wrong, F.coalesce("error", F.lit("")))).withColumn("items", F.when(wrong, one).otherwise(F.col("items")))
    return first_n(tables.exploded(read), total, ["page_no", "pos"], by)


def parted(outcome: DataFrame, by: Sequence[str] = ("app_id",)) -> tuple[DataFrame, DataFrame]:
    """Reviews, and errors (``page_no, error``), of an outcome. Persist or store the outcome to use both."""
    return outcome.where("failed is null").drop("failed"), outcome.where("failed is not null").select(*by, "page_no", F.col("failed").alias("error"))


def reviews_comprehensive(pages: DataFrame, per_rating: int) -> DataFrame:
    """All pages of the five rating queries (``score_query``): up to ``per_rating`` of each, each id once, the first seen.

    A rating that meets a page in error before its number is there gives nothing, as its partial rows are not used.
    """
    by = ["app_id", "score_query"]
    read = _read_pages(pages.where("app_id <> ''"), per_rating, by).drop("_before")
    failed = F.max(F.col("status") == "error").over(Window.partitionBy(*by))
    good = read.withColumn("_failed", failed).where("not _failed").drop("_failed")
    rows = first_n(tables.exploded(good), per_rating, ["page_no", "pos"], by)
    return first_seen(rows, ["app_id", "id"], ["score_query", "page_no", "pos"])
