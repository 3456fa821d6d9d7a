"""Positional layouts of the records: where each column stands in a payload, and how it is read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import has_package_prefix, histogram, moment, screenshots, strip_html
from ..functions.variant import items, let, longs, numbers_only, path, strings, texts_only, to_double
from ..schemas import BASE_URL, RESULT

# Paths of an app's columns below its root, by how they are read.
APP_TEXT = {
    "title": (0, 0), "description_html": (72, 0, 1), "summary": (73, 0, 1), "installs": (13, 0), "score_text": (51, 0, 0),
    "currency": (57, 0, 0, 0, 0, 1, 0, 1), "price_text": (57, 0, 0, 0, 0, 1, 0, 2), "developer": (68, 0), "developer_id": (68, 1, 4, 2),
    "developer_email": (69, 1, 0), "developer_website": (69, 0, 5, 2), "developer_address": (69, 2, 0), "genre": (79, 0, 0, 0), "genre_id": (79, 0, 0, 2),
    "icon": (95, 0, 3, 2), "version": (140, 0, 0, 0), "android_version": (140, 1, 1, 0, 0, 1), "content_rating": (9, 0), "released": (10, 1, 0),
    "privacy_policy": (99, 0, 5, 2),
}
APP_LONG = {"min_installs": (13, 1), "max_installs": (13, 2), "ratings": (51, 2, 1), "reviews": (51, 3, 1), "updated": (145, 0, 1, 0)}
APP_DOUBLE = {"score": (51, 0, 1)}
APP_PRICE, APP_HISTOGRAM, APP_SCREENSHOTS = (57, 0, 0, 0, 0, 1, 0, 0), (51, 1), (78, 0)

#: An app's columns in their order.
APP = ["app_id", "url", "title", "description", "description_html", "summary", "installs", "min_installs", "max_installs", "score", "score_text", "ratings", "reviews", "histogram", "price", "free", "currency", "price_text", "developer", "developer_id", "developer_email", "developer_website", "developer_address", "genre", "genre_id", "categories", "icon", "header_image", "screenshots", "video", "video_image", "version", "android_version", "content_rating", "released", "updated", "privacy_policy", "available"]


def details_url(app_id: Column, *suffix: Column) -> Column:
    return F.concat(F.lit(f"{BASE_URL}/store/apps/details?id="), app_id, *suffix)


def app_values(root: Column) -> dict[str, Column]:
    """The texts and whole numbers of an app as arrays, in the order of the paths above."""
    return {"_texts": strings(root, *APP_TEXT.values()), "_longs": longs(root, *APP_LONG.values())}


def app(root: Column, app_id: Column, url: Column) -> list[Column]:
    """The columns of an app, from its root and ``app_values``; missing values are zero values, a missing price means free."""
    columns = {x: F.get("_texts", F.lit(k)) for k, x in enumerate(APP_TEXT)}
    columns |= {x: F.get("_longs", F.lit(k)) for k, x in enumerate(APP_LONG)}
    columns |= {x: to_double(path(root, *p)) for x, p in APP_DOUBLE.items()}
    columns |= {
        "app_id": app_id, "url": url, "available": F.lit(True), "description": strip_html(columns["description_html"]),
        "histogram": histogram(path(root, *APP_HISTOGRAM)), "screenshots": screenshots(path(root, *APP_SCREENSHOTS)),
        **_price(path(root, *APP_PRICE)), "categories": F.array().cast("array<string>"), "header_image": F.lit(""), "video": F.lit(""), "video_image": F.lit(""),
    }
    return [columns[x].alias(x) for x in APP]


def _price(micros: Column) -> dict[str, Column]:
    return {"price": to_double(micros) / 1e6, "free": F.coalesce(let(micros, lambda m: m.isNull() | (to_double(m) == 0)), F.lit(True))}


def _fields(v: Column, paths: dict[str, tuple], row: Callable[[dict[str, Column]], Column]) -> Column:
    """``row`` of the texts at the paths, each read once."""
    return let(strings(v, *paths.values()), lambda t: row({x: F.get(t, F.lit(k)) for k, x in enumerate(paths)}))


def _first(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in texts], F.lit(""))


def _result(columns: dict[str, Column]) -> Column:
    """A search result; what a layout does not give has its zero value."""
    zero = {"score": F.lit(0.0), "price": F.lit(0.0), "free": F.lit(True)}
    return F.struct(*[columns.get(x, zero.get(x, F.lit(""))).alias(x) for x in RESULT])


#: Paths that most layouts share.
FLAT = {"app_id": (0, 0), "icon": (1, 3, 2), "title": (3,), "score_text": (4, 0), "developer": (14,)}


def _flat(v: Column, f: dict[str, Column], offset: tuple = ()) -> dict[str, Column]:
    """The columns that most layouts share, from their texts ``f``."""
    url = F.when(f["app_id"] != "", details_url(f["app_id"])).otherwise(F.lit(""))
    return {x: f[x] for x in FLAT} | {"score": to_double(path(v, *offset, 4, 1)), "url": url}


def search_row(v: Column) -> Column:
    """First page of a search: the row may be wrapped once more; the id must be a package name."""
    inner = F.get(items(v), F.lit(0))
    row = F.when((F.size(items(v)) == 1) & items(inner).isNotNull(), inner).otherwise(v)
    package = lambda x: F.when(has_package_prefix(x), x)
    paths = FLAT | {"id_4": (0, 0, 0, 0), "id_3": (0, 0, 0), "icon_2": (0, 1, 3, 2)}

    def of(r: Column) -> Column:
        def result(f: dict[str, Column]) -> Column:
            app_id = F.coalesce(*[package(f[x]) for x in ("id_4", "id_3", "app_id")], F.lit(""))
            return let(app_id, lambda i: _result(_flat(r, f | {"app_id": i, "icon": _first(f["icon"], f["icon_2"])})))

        return _fields(r, paths, result)

    return let(row, of)


BATCH = {
    "app_id": (12, 0), "title": (2,), "icon": (1, 1, 0, 3, 2), "developer": (4, 0, 0, 0), "score_text": (6, 0, 2, 1, 0), "summary": (4, 1, 1, 1, 1),
    "currency": (7, 0, 3, 2, 1, 0, 1), "link": (9, 4, 2), "maker": (4, 0, 0, 1, 4, 2),
}


def batch_row(v: Column) -> Column:
    """Further pages of a search."""

    def result(f: dict[str, Column]) -> Column:
        parts = F.split(f["maker"], r"\?id=")
        return _result({
            **f, "score": to_double(path(v, 6, 0, 2, 1, 1)), **_price(path(v, 7, 0, 3, 2, 1, 0, 0)),
            "url": F.when(f["link"] != "", F.concat(F.lit(BASE_URL), f["link"])).otherwise(F.lit("")),
            "developer_id": F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(F.lit("")),
        })

    return _fields(v, BATCH, result)


def developer_row(numeric: bool):
    offset = () if numeric else (0,)
    paths = {x: (*offset, *p) for x, p in FLAT.items()}
    return lambda v: _fields(v, paths, lambda f: _result(_flat(v, f, offset)))


def similar_row(v: Column) -> Column:
    return _fields(v, FLAT, lambda f: _result(_flat(v, f) | {"score_text": F.lit("")}))


def chart_row(v: Column) -> Column:
    """A chart's row; a price only from an array of at least two."""
    priced = let(path(v, 8), lambda p: F.when(F.size(items(p)) > 1, p))
    paths = FLAT | {"currency": (8, 1, 0, 1)}

    def result(f: dict[str, Column]) -> Column:
        return let(priced, lambda p: _result(_flat(v, f) | {**_price(path(p, 1, 0, 0)), "currency": F.when(p.isNotNull(), f["currency"]).otherwise(F.lit(""))}))

    return _fields(v, paths, result)


REVIEW_TEXT = {"id": (0,), "user_name": (1, 0), "user_image": (1, 1, 3, 2), "text": (4,), "reply_text": (7, 1), "version": (10,)}
REVIEW_NUMBER = {"score": (2,), "thumbs_up": (6,), "seconds": (5, 0), "parts": (5, 1), "reply_seconds": (7, 2, 0), "reply_parts": (7, 2, 1)}


#: What a column of a review is made of, where that is not its own value.
REVIEW_FROM = {"date": ("seconds", "parts"), "reply_date": ("reply_seconds", "reply_parts"), "url": ("id",), "criterias": ()}


def review_row(v: Column, app_id: Column, fields: Sequence[str] | None = None) -> Column:
    """A review: only values of the expected type count, and only arrays are walked. ``fields``: the columns beside ``id``, all if None."""
    wanted = [x for x in REVIEW if fields is None or x == "id" or x in fields]
    parts = {y for x in wanted for y in REVIEW_FROM.get(x, (x,))} | {"id"}
    texts, numbers = ({x: p for x, p in of.items() if x in parts} for of in (REVIEW_TEXT, REVIEW_NUMBER))

    def row(t: Column, n: Column | None) -> Column:
        columns = {x: F.get(t, F.lit(k)) for k, x in enumerate(texts)}
        number = {x: F.get(n, F.lit(k)) for k, x in enumerate(numbers)}
        make = {x: lambda x=x: F.coalesce(number[x], F.lit(0)).cast("long") for x in ("score", "thumbs_up")}
        make |= {x: lambda x=x: moment(*[number[y] for y in REVIEW_FROM[x]]) for x in ("date", "reply_date")}
        make["url"] = lambda: F.when(columns["id"] != "", details_url(app_id, F.lit("&reviewId="), columns["id"])).otherwise(F.lit(""))
        make["criterias"] = lambda: F.array().cast("array<struct<name:string,rating:int>>")
        return F.struct(*[(make[x]() if x in make else columns[x]).alias(x) for x in wanted])

    numbered = lambda t: let(numbers_only(v, *numbers.values()), lambda n: row(t, n)) if numbers else row(t, None)
    return let(texts_only(v, *texts.values()), numbered)


#: A review's columns in their order.
REVIEW = ["id", "user_name", "user_image", "date", "score", "thumbs_up", "text", "reply_date", "reply_text", "version", "url", "criterias"]
