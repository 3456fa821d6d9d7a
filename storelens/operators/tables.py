"""Stored bodies to typed rows. Each function takes a DataFrame with ``body`` and request columns, which pass through.

Rows keep their order in ordinal columns: ``page_no`` (given), ``section_no``, ``pos``. Nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.payload import block, block_of, blocks, envelope
from ..functions.text import first_app_array
from ..functions.variant import array_path, is_string, items, let, path, text_only, to_double, to_string
from ..schemas import BASE_URL, CATEGORIES
from . import layouts


def request_columns(raw: DataFrame) -> list[str]:
    """What passes through: all but the body and the transport's own status."""
    return [c for c in raw.columns if c not in ("body", "status", "error")]


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column, computed once per row, and drop the rows where it is NULL.

    A filter on a plain column would be pushed below the projection, and the column computed again for it.
    """
    return df.select("*", F.explode(F.filter(F.array(value), lambda v: v.isNotNull())).alias(name))


def _unnest(df: DataFrame, keep: list[str], array: Column, row: Callable[[Column], Column], ordinal: str = "pos") -> DataFrame:
    """The items of an array as rows; what is no array gives none. Rows without an app id go."""
    out = df.select(*keep, F.posexplode(array).alias(ordinal, "item")).where(items(F.col("item")).isNotNull())
    return once(out, "r", row(F.col("item"))).where("r.app_id <> ''").select(*keep, ordinal, "r.*")


def app_root(body: Column) -> Column:
    return path(block(body, "ds:5"), 1, 2)


def apps(raw: DataFrame) -> DataFrame:
    """One row per details page (app_id, lang, country) that holds an app; see ``app_errors`` for the others."""
    parsed = once(raw, "root", app_root(F.col("body")))
    parsed = parsed.select("*", *[c.alias(x) for x, c in layouts.app_values(F.col("root")).items()])
    url = layouts.details_url(F.col("app_id"), F.lit("&hl="), F.col("lang"), F.lit("&gl="), F.col("country"))
    return parsed.select("lang", "country", *layouts.app(F.col("root"), F.col("app_id"), url))


def app_errors(raw: DataFrame) -> DataFrame:
    return raw.where(app_root(F.col("body")).isNull()).select("app_id", F.lit("app data not found").alias("error"))


# Where the results of a first page of a search may be: blocks and, in them, containers, in this order.
SEARCH_BLOCKS, SEARCH_CONTAINERS = ("ds:4", "ds:3", "ds:1"), (22, 21, 0)


def _typed(array: Column, row: Callable[[Column], Column], key: str) -> Column:
    """The items of an array as typed rows with their places: those that are arrays and whose ``key`` is not empty."""
    rows = F.transform(array, lambda x, i: F.struct(i.alias("pos"), F.when(items(x).isNotNull(), row(x)).alias("r")))
    return F.filter(rows, lambda e: e["r"][key] != "")


def exploded(pages: DataFrame) -> DataFrame:
    """Typed pages (see below) as rows."""
    keep = [c for c in pages.columns if c not in ("status", "error", "next_token", "items")]
    # of a plain column Spark would derive filters by its size, for which the whole page is parsed again
    return pages.select(*keep, F.explode(F.filter("items", lambda _: F.lit(True))).alias("i")).select(*keep, "i.pos", "i.r.*")


def search_first_pages(raw: DataFrame) -> DataFrame:
    """Typed first pages of a search, each parsed once: ``status, error, next_token, items``.

    Where the usual containers are empty, arrays are searched depth-first. A page without its block has no items.
    """
    data = F.coalesce(*[block_of(F.col("_blocks"), k) for k in SEARCH_BLOCKS])
    parsed = once(raw.withColumn("_blocks", blocks(F.col("body"))), "_s", F.struct(data.alias("data"))).withColumn("_data", F.col("_s.data"))
    usual = F.coalesce(*[F.when(F.size(a) > 0, a) for k in SEARCH_CONTAINERS for a in [items(path(F.col("_data"), 0, 1, 0, k, 0))]])
    parsed = parsed.withColumn("_usual", usual)
    found = parsed.withColumn("_rows", F.coalesce("_usual", F.when(F.col("_usual").isNull() & F.col("_data").isNotNull(), items(first_app_array(F.col("_data"))))))
    token = to_string(path(F.col("_data"), 0, 1, 0, 0, 3, 0))
    rows = _typed(F.col("_rows"), layouts.search_row, "app_id")
    return found.select(*request_columns(raw), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"), token.alias("next_token"), rows.alias("items"))


def search_first(raw: DataFrame) -> DataFrame:
    """Results of first pages of a search."""
    return exploded(search_first_pages(raw))


def search_tokens(raw: DataFrame) -> DataFrame:
    """``next_token`` of first pages; '' for none."""
    return search_first_pages(raw).select(*request_columns(raw), "next_token")


def responses(raw: DataFrame, tolerant: bool) -> DataFrame:
    """Request columns with ``status``, ``error`` and ``data`` of responses. A request that failed (``error``) has no body to read."""
    read = envelope(F.col("body"), tolerant)
    if "error" in raw.columns:
        failed = F.struct(F.lit("error").alias("status"), F.concat(F.lit("request failed: "), raw["error"]).alias("error"), F.lit(None).cast("variant").alias("data"))
        read = F.when(raw["error"].isNotNull(), failed).otherwise(read)
    return once(raw, "e", read).select(*request_columns(raw), "e.*")


def search_more_pages(raw: DataFrame) -> DataFrame:
    """Typed further pages of a search."""
    data = F.col("data")
    rows = _typed(items(path(data, 0, 0, 0)), layouts.batch_row, "app_id")
    return responses(raw, True).select(*request_columns(raw), "status", "error", to_string(path(data, 0, 0, 7, 1)).alias("next_token"), rows.alias("items"))


def search_more(raw: DataFrame) -> DataFrame:
    """Results of further pages."""
    return exploded(search_more_pages(raw))


def search_more_tokens(raw: DataFrame) -> DataFrame:
    return search_more_pages(raw).drop("items")


def is_numeric_id(dev_id: Column) -> Column:
    return F.coalesce(dev_id.rlike(r"^[+-]?[0-9]+$") & dev_id.try_cast("bigint").isNotNull(), F.lit(False))


def developer(raw: DataFrame) -> DataFrame:
    """Apps of developer pages (dev_id); numeric ids have another layout than names."""
    keep = request_columns(raw)
    data = once(raw, "data", block(F.col("body"), "ds:3"))
    numeric = is_numeric_id(F.col("dev_id"))
    rows = [_unnest(data.where(which), keep, items(path(F.col("data"), 0, 1, 0, container, 0)), layouts.developer_row(n)) for which, container, n in ((numeric, 21, True), (~numeric, 22, False))]
    return rows[0].unionByName(rows[1])


def similar_cluster(raw: DataFrame) -> DataFrame:
    """``cluster_url`` of details pages, each parsed once: the first cluster called similar, in the blocks' order; NULL for none."""
    fits = lambda v: F.coalesce(to_string(path(v, 21, 1, 0)).contains("Similar") & path(v, 21, 1, 2, 4, 2).isNotNull(), F.lit(False))

    def named(found: Column, key: str) -> Column:
        hit = let(block_of(found, key), lambda v: F.get(F.filter(items(path(v, 1, 1)), fits), F.lit(0)))
        return let(let(hit, lambda v: to_string(path(v, 21, 1, 2, 4, 2))), lambda url: F.nullif(url, F.lit("")))

    url = let(blocks(F.col("body")), lambda found: F.coalesce(*[named(found, k) for k in ("ds:7", "ds:8", "ds:6")]))
    return once(raw, "_c", F.struct(url.alias("cluster_url"))).select(*request_columns(raw), "_c.cluster_url")


def similar(raw: DataFrame) -> DataFrame:
    """Apps of cluster pages."""
    data = once(raw, "data", block(F.col("body"), "ds:3"))
    return _unnest(data, request_columns(raw), items(path(F.col("data"), 0, 1, 0, 21, 0)), layouts.similar_row)


def charts(raw: DataFrame) -> DataFrame:
    """Apps of all sections of chart pages, with ``section_no``."""
    keep = request_columns(raw)
    sections = raw.select(*keep, F.posexplode(items(path(block(F.col("body"), "ds:4"), 0, 1))).alias("section_no", "section"))
    return _unnest(sections, [*keep, "section_no"], items(path(F.col("section"), 21, 0)), layouts.chart_row)


def section_of(collection: str) -> int:
    """The section of a collection; unknown ones read the first."""
    return {"TOP_PAID": 1, "GROSSING": 2}.get(collection, 0)


def typed_review_pages(raw: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Typed review pages (app_id), each parsed once; only a text counts as a token. Of a review only ``fields`` are read, if given."""
    rows = _typed(items(array_path(F.col("data"), 0)), lambda x: layouts.review_row(x, F.col("app_id"), fields), "id")
    token = F.coalesce(text_only(array_path(F.col("data"), 1, 1)), F.lit(""))
    return responses(raw, False).select(*request_columns(raw), "status", "error", token.alias("next_token"), rows.alias("items"))


def reviews(raw: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Reviews of response pages (app_id): all columns, or ``id`` and ``fields``. What is not asked for is not taken out of the page."""
    return exploded(typed_review_pages(raw, fields))


def review_pages(raw: DataFrame) -> DataFrame:
    """``status``, ``error`` and ``next_token`` of review pages."""
    return typed_review_pages(raw, ["id"]).drop("items")


def permissions(raw: DataFrame) -> DataFrame:
    """``type, permission`` of permission responses, with the ordinals of kind, group and permission."""
    keep = request_columns(raw)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind_no"), F.lit(n).alias("kind"), items(array_path(F.col("data"), k)).alias("groups")) for k, n in ((0, "Common"), (1, "Other"))])
    rows = responses(raw, True).where("status = 'ok'").select(*keep, F.explode(kinds).alias("k")).select(*keep, "k.*")
    rows = rows.select(*keep, "kind_no", "kind", F.posexplode("groups").alias("group_no", "g")).where(F.size(items(F.col("g"))) >= 3)
    name = F.coalesce(F.nullif(to_string(array_path(F.col("g"), 0)), F.lit("")), "kind")
    rows = rows.select(*keep, "kind_no", "group_no", name.alias("type"), F.posexplode(items(array_path(F.col("g"), 2))).alias("pos", "p")).where(F.size(items(F.col("p"))) >= 2)
    return rows.select(*keep, "kind_no", "group_no", "pos", "type", to_string(array_path(F.col("p"), 1)).alias("permission")).where("permission <> ''")


def _entries(groups: Column) -> Column:
    def of_group(g: Column) -> Column:
        name = to_string(path(g, 0, 1))
        parts = F.transform(items(path(g, 4)), lambda x: F.when(items(x).isNotNull(), F.struct(to_string(path(x, 0)).alias("data"), (to_double(path(x, 1)) == 1).alias("optional"), to_string(path(x, 2)).alias("purpose"), name.alias("type"))))
        return F.filter(parts, lambda e: e.isNotNull() & (e["data"] != ""))

    flat = F.flatten(F.filter(F.transform(items(groups), lambda g: F.when(items(g).isNotNull(), of_group(g))), lambda a: a.isNotNull()))
    return F.coalesce(flat, F.array().cast("array<struct<data:string,optional:boolean,purpose:string,type:string>>"))


def data_safety(raw: DataFrame) -> DataFrame:
    """One row per data-safety page that has its block: shared and collected data, practices, privacy policy."""
    parsed = once(raw, "data", block(F.col("body"), "ds:3")).withColumn("s", path(F.col("data"), 1, 2, 1, 138))
    practices = F.transform(items(path(F.col("s"), 9, 2)), lambda x: F.when(F.size(items(x)) >= 3, F.struct(to_string(path(x, 1)).alias("practice"), to_string(path(x, 2, 1)).alias("description"))))
    practices = F.coalesce(F.filter(practices, lambda x: x.isNotNull() & (x["practice"] != "")), F.array().cast("array<struct<practice:string,description:string>>"))
    return parsed.select(*request_columns(raw), _entries(path(F.col("s"), 4, 0, 0)).alias("shared_data"), _entries(path(F.col("s"), 4, 1, 0)).alias("collected_data"), practices.alias("security_practices"), to_string(path(F.col("data"), 1, 2, 1, 100, 0, 5, 2)).alias("privacy_policy_url"))


def data_safety_entries(raw: DataFrame) -> DataFrame:
    """The long form: ``scope, pos, data, optional, purpose, type``."""
    keep = request_columns(raw)
    wide = data_safety(raw)
    rows = [wide.select(*keep, F.lit(scope).alias("scope"), F.posexplode(column).alias("pos", "e")).select(*keep, "scope", "pos", "e.*") for scope, column in (("shared", "shared_data"), ("collected", "collected_data"))]
    return rows[0].unionByName(rows[1])


def suggestions(raw: DataFrame) -> DataFrame:
    """``pos, suggestion``: texts that head an array; an empty text stays."""
    keep = request_columns(raw)
    rows = responses(raw, True).where("status = 'ok'").select(*keep, F.posexplode(items(path(F.col("data"), 0, 0))).alias("pos", "item"))
    return rows.where(is_string(array_path(F.col("item"), 0))).select(*keep, "pos", text_only(array_path(F.col("item"), 0)).alias("suggestion"))


def categories(spark) -> DataFrame:
    return spark.createDataFrame([(k, c) for k, c in enumerate(CATEGORIES)], "pos int, category string")


def cluster_page_url(cluster_url: Column, lang: Column, country: Column) -> Column:
    return F.concat(F.lit(BASE_URL), cluster_url, F.lit("&gl="), country, F.lit("&hl="), lang)
