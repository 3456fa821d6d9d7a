"""Registered queries of the app-store operators and the SQL that gives the same rows.

The tables hold no store payloads, so each query encodes rows as payloads, reads them back with the operators,
and its SQL computes the rows from the tables directly. Roles: part = apps, supplier and brand = developers,
events = reviews, nation and region = permissions, pages = raw HTML.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.variant import LONG_MAX, path, strict, to_long
from ..operators import analytics, relational, tables
from ..schemas import CATEGORIES, Sort
from ..session import configure
from . import encoders as E

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
STORE = "https://play.google.com/store/apps/details?id="


def query(sql: str):
    def keep(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(configure(spark), sf_dir)

        _queries[f.__name__], _sql[f.__name__] = run, sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    # a small table is one split; its rows are dealt out before they become payloads
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _app_id(key: Column) -> Column:
    return F.concat(F.lit("com.p"), key.cast("string"))


def _micros(price: Column) -> Column:
    return F.round(price * 100).cast("long") * 10000


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").withColumn("id", _app_id(F.col("p_partkey")))


# apps -------------------------------------------------------------------------------------------------------


def _details(rows: DataFrame, **more: Column) -> DataFrame:
    """Details pages of parts: every third part is free, every seventh has no price; ``missing`` pages hold no app."""
    price = F.when(F.col("p_partkey") % 3 == 0, F.lit(0)).otherwise(_micros(F.col("p_retailprice")))
    offer = F.when(F.col("p_partkey") % 7 == 0, F.parse_json(F.lit("null"))).otherwise(E.array([[price, F.lit("USD"), F.lit("shown")]]))
    root = {
        0: [more.get("title", F.col("p_name"))], 9: [F.lit("Everyone")], 10: {1: [F.lit("Jan 1, 2024")]}, 13: [F.concat(F.col("p_size").cast("string"), F.lit("+")), F.col("p_size"), F.col("p_size") * 2],
        51: {0: {0: F.lit("4.5"), 1: F.lit(4.5)}, 1: more.get("histogram", F.lit(None).cast("variant")), 2: {1: F.col("p_partkey")}, 3: {1: F.col("p_size")}},
        57: [[[[{1: offer}]]]], 68: {0: F.col("p_brand"), 1: {4: {2: F.concat(F.lit("/store/apps/developer?id="), F.col("p_brand"))}}},
        72: [{1: F.concat(F.lit("<b>"), F.col("p_name"), F.lit("</b><br>second<br />third"))}], 73: [{1: F.col("p_type")}],
        78: [[{3: {2: F.lit("https://shot/1")}}, F.lit("bad"), {3: {2: F.lit("https://shot/2")}}]], 79: [[[F.col("p_type"), F.lit(None).cast("string"), F.upper("p_type")]]],
        95: [{3: {2: F.lit("https://icon")}}], 140: {0: [[F.lit("1.2.3")]]}, 145: [{1: [more.get("updated", F.col("p_partkey") * 1000)]}],
    }
    block = E.text(E.array({1: {2: E.array(root)}}))
    decoy = E.script("ds:5", F.lit("[broken"))
    page = E.page(E.script("ds:4", F.lit("[1]")), E.script("ds:5", F.lit('["old"]')), E.script("ds:5", block), decoy)
    body = F.when(more.get("missing", F.lit(False)), E.page(E.script("ds:4", F.lit("[1]")))).otherwise(page)
    return rows.select(F.col("id").alias("app_id"), more.get("lang", F.lit("en")).alias("lang"), more.get("country", F.lit("us")).alias("country"), body.alias("body"))


def _join(c: str) -> str:
    return f"'com.p' || CAST({c} AS VARCHAR)"


MICROS = "CAST(round(p_retailprice * 100) AS BIGINT) * 10000"


@query(f"""SELECT {_join('p_partkey')} AS app_id, '{STORE}com.p' || CAST(p_partkey AS VARCHAR) || '&hl=en&gl=us' AS url, p_name AS title, p_name || chr(10) || 'second' || chr(10) || 'third' AS description,
  p_type AS summary, CAST(p_size AS VARCHAR) || '+' AS installs, CAST(p_size AS BIGINT) AS min_installs, CAST(p_size * 2 AS BIGINT) AS max_installs, CAST(4.5 AS DOUBLE) AS score, '4.5' AS score_text,
  CAST(p_partkey AS BIGINT) AS ratings, CAST(p_size AS BIGINT) AS reviews, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({MICROS} AS DOUBLE) / 1e6 END AS price,
  (p_partkey % 7 = 0 OR p_partkey % 3 = 0) AS free, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'USD' END AS currency, p_brand AS developer, '/store/apps/developer?id=' || p_brand AS developer_id,
  p_type AS genre, upper(p_type) AS genre_id, 'https://icon' AS icon, CAST(2 AS INTEGER) AS n_screenshots, '1.2.3' AS version, '' AS android_version, 'Everyone' AS content_rating, 'Jan 1, 2024' AS released,
  CAST(p_partkey * 1000 AS BIGINT) AS updated, '' AS privacy_policy, true AS available FROM part""")
def app_details(spark, sf_dir):
    apps = tables.apps(_details(_parts(spark, sf_dir)))
    return apps.select("app_id", "url", "title", "description", "summary", "installs", "min_installs", "max_installs", "score", "score_text", "ratings", "reviews", "price", "free", "currency", "developer", "developer_id", "genre", "genre_id", "icon", F.size("screenshots").alias("n_screenshots"), "version", "android_version", "content_rating", "released", "updated", "privacy_policy", "available")


_COUNTS = ", ".join(f"count(CASE WHEN l_linenumber = {k} THEN 1 END) AS n{k}" for k in range(1, 6))


@query(f"SELECT {_join('l_partkey')} AS app_id, {_COUNTS}, count(CASE WHEN l_linenumber <= 5 THEN 1 END) AS total FROM lineitem GROUP BY l_partkey")
def app_histogram(spark, sf_dir):
    apps = _histograms(spark, sf_dir)
    return apps.select("app_id", *[F.get("histogram", F.lit(k - 1)).alias(f"n{k}") for k in range(1, 6)], analytics.total(F.col("histogram")).alias("total"))


def _histograms(spark, sf_dir) -> DataFrame:
    n = [F.count(F.when(F.col("l_linenumber") == k, 1)).alias(f"c{k}") for k in range(1, 6)]
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(*n)
    rows = E.array([[F.lit(k), F.col(f"c{k}")] for k in (5, 4, 3, 2, 1)])
    root = E.array({0: [F.lit("t")], 51: {1: rows}})
    body = E.page(E.script("ds:5", E.text(E.array({1: {2: root}}))))
    raw = lines.select(_app_id(F.col("l_partkey")).alias("app_id"), F.lit("en").alias("lang"), F.lit("us").alias("country"), body.alias("body"))
    return tables.apps(raw)


@query("SELECT page_id, regexp_replace(replace(replace(replace(html, '<br>', chr(10)), '<br/>', chr(10)), '<br />', chr(10)), '<[^>]*>', '', 'g') AS text FROM pages")
def strip_html(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<script')) AS BIGINT) AS n_scripts, CAST(3 AS BIGINT) AS n_blocks, page_id AS last_valid FROM pages")
def script_blocks(spark, sf_dir):
    """Blocks behind real page text: the last well-formed one of a key counts."""
    from ..functions.payload import block, block_keys

    pages = _table(spark, sf_dir, "pages").where("html is not null")
    blocks = F.concat(E.script("ds:1", F.lit('["first"]')), E.script("ds:1", E.text(E.array([F.col("page_id")]))), E.script("ds:1", F.lit("[1] x")))
    body = F.concat(F.col("html"), F.lit("\n"), blocks)
    scripts = F.size(F.regexp_extract_all("html", F.lit("<script"), F.lit(0))).cast("long")
    return pages.withColumn("body", body).select("page_id", scripts.alias("n_scripts"), F.size(block_keys(F.col("body"))).cast("long").alias("n_blocks"), to_long(path(block(F.col("body"), "ds:1"), 0)).alias("last_valid"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path_int(spark, sf_dir):
    # an object walked by its key: the step's number is the key
    renamed = F.replace("props", F.lit('"k"'), F.lit('"7"'))
    return _table(spark, sf_dir, "events").select("event_id", to_long(path(strict(renamed), 7)).alias("k"))


# results ----------------------------------------------------------------------------------------------------


def _flat_row(offset: bool = False) -> Column:
    row = {0: [F.col("id")], 1: {3: {2: F.lit("https://icon")}}, 3: F.col("p_name"), 4: [F.lit("4.5"), F.lit(4.5)], 14: F.col("p_brand")}
    return E.array([E.array(row)] if offset else row)


def _chart_row() -> Column:
    price = F.when(F.col("p_partkey") % 3 == 0, F.lit(0)).otherwise(_micros(F.col("p_retailprice")))
    offer = F.when(F.col("p_partkey") % 7 == 0, F.parse_json(F.lit("null"))).otherwise(E.array([F.lit(1), [[price, F.lit("USD")]]]))
    return E.array({0: [F.col("id")], 1: {3: {2: F.lit("https://icon")}}, 3: F.col("p_name"), 4: [F.lit("4.5"), F.lit(4.5)], 8: offer, 14: F.col("p_brand")})


def _batch_row() -> Column:
    price = _micros(F.col("p_retailprice"))
    return E.array({2: F.col("p_name"), 4: {0: [[F.col("p_brand"), {4: {2: F.concat(F.lit("/x?id="), F.col("p_brand"))}}]], 1: {1: {1: {1: F.col("p_type")}}}}, 6: {0: {2: {1: [F.lit("4.5"), F.lit(4.5)]}}}, 7: {0: {3: {2: {1: [[price, F.lit("USD")]]}}}}, 9: {4: {2: F.concat(F.lit("/d?id="), F.col("id"))}}, 12: [F.col("id")]})


#: A page covers so many part keys: however large the table is, no page, and no group that makes one, holds more rows.
PAGE_KEYS = 2000
#: The further pages of a search have their ordinals behind those of its first pages.
FURTHER = 1 << 30


def _gather(rows: DataFrame, by: list[str], row: Column) -> DataFrame:
    """JSON arrays of rows, in the order of ``page_no`` and part key, as many for a group as its keys need; a malformed row leads each."""
    rows = rows.withColumn("page_no", F.floor(F.col("p_partkey") / PAGE_KEYS).cast("int")).withColumn("row", F.to_json(row))
    packed = rows.groupBy(*by, "page_no").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "row"))).alias("rows"))
    joined = F.concat(F.lit('["bad",'), F.array_join(F.transform("rows", lambda r: r["row"]), ","), F.lit("]"))
    return packed.select(*by, "page_no", joined.alias("apps"))


def _container(place: int, apps: Column, token: Column | None = None) -> Column:
    return E.filled(E.text(E.array([{1: [{0: {3: [F.lit("tok") if token is None else token]}, place: [E.hole()]}]}])), apps)


def _batch(apps: Column, token: Column) -> Column:
    return E.response(E.filled(E.text(E.array([[{0: E.hole(), 7: [F.lit(0), token]}]])), apps))


def _term(rows: DataFrame) -> DataFrame:
    return rows.withColumn("term", F.substring_index("p_name", " ", 1))


def _search_first(spark, sf_dir) -> DataFrame:
    rows = _gather(_term(_parts(spark, sf_dir)).where("p_partkey % 2 = 0"), ["term"], E.array([_flat_row()]))
    body = E.page(E.script("ds:1", F.lit("[]")), E.script("ds:4", _container(22, F.col("apps"))))
    return rows.select("term", "page_no", body.alias("body"))


def _search_more(spark, sf_dir) -> DataFrame:
    rows = _gather(_term(_parts(spark, sf_dir)).where("p_partkey % 2 = 1"), ["term"], _batch_row())
    return rows.select("term", (FURTHER + F.col("page_no")).alias("page_no"), _batch(F.col("apps"), F.lit("tok2")).alias("body"))


TERM = "split_part(p_name, ' ', 1)"
PAGE1 = f"SELECT {TERM} AS term, 0 AS page_no, p_partkey, {_join('p_partkey')} AS app_id, p_name AS title, '{STORE}com.p' || CAST(p_partkey AS VARCHAR) AS url, '' AS developer_id, '' AS summary, CAST(0 AS DOUBLE) AS price, '' AS currency, true AS free FROM part WHERE p_partkey % 2 = 0"
PAGE2 = f"SELECT {TERM}, 1, p_partkey, {_join('p_partkey')}, p_name, 'https://play.google.com/d?id=com.p' || CAST(p_partkey AS VARCHAR), p_brand, p_type, CAST({MICROS} AS DOUBLE) / 1e6, 'USD', {MICROS} = 0 FROM part WHERE p_partkey % 2 = 1"
RANKED = f"WITH u AS ({PAGE1} UNION ALL {PAGE2}), r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY page_no, p_partkey) AS n FROM u)"
SHORT = ["term", "app_id", "title", "url", "developer_id", "summary", "price", "currency", "free"]


@query(f"SELECT {', '.join(SHORT)} FROM ({PAGE1.removesuffix(' WHERE p_partkey % 2 = 0')})")
def search_first_page(spark, sf_dir):
    """All parts on the first pages of their terms."""
    rows = _gather(_term(_parts(spark, sf_dir)), ["term"], E.array([_flat_row()]))
    body = E.page(E.script("ds:1", F.lit("[]")), E.script("ds:4", _container(22, F.col("apps"))))
    return tables.search_first(rows.select("term", "page_no", body.alias("body"))).select(*SHORT)


@query(f"{RANKED} SELECT {', '.join(SHORT)} FROM r WHERE n <= 250")
def search_pages(spark, sf_dir):
    return relational.search(_search_first(spark, sf_dir), _search_more(spark, sf_dir), 250).select(*SHORT)


@query(f"{RANKED} SELECT {', '.join(SHORT)} FROM r WHERE n <= 250 AND NOT free")
def search_paid(spark, sf_dir):
    return relational.by_price(relational.search(_search_first(spark, sf_dir), _search_more(spark, sf_dir), 250), "PAID").select(*SHORT)


#: Ordinals of pages within one of the three parts of a search.
STOP = 1 << 28


@query(f"""WITH u AS (SELECT {TERM} AS term, p_partkey % 3 AS page_no, length({TERM}) % 4 AS k, {_join('p_partkey')} AS app_id, p_name AS title FROM part),
  p AS (SELECT term, page_no, CASE WHEN page_no = 0 THEN k = 2 ELSE k = 0 OR k = 1 END AS ends, page_no = 1 AND k = 0 AS failed FROM (SELECT DISTINCT term, page_no, k FROM u)),
  o AS (SELECT *, coalesce(bool_or(ends) OVER (PARTITION BY term ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM p)
  SELECT u.term, CAST(u.page_no AS INTEGER) AS page_no, u.app_id, u.title FROM u JOIN o ON u.term = o.term AND u.page_no = o.page_no WHERE NOT o.over AND NOT o.failed""")
def search_stops(spark, sf_dir):
    """Three parts a term, of as many pages as they need: for some the second is in error or has no token, for some the first has none."""
    rows = _term(_parts(spark, sf_dir)).withColumn("part", (F.col("p_partkey") % 3).cast("int")).withColumn("k", F.length("term") % 4)
    by, first, none = ["term", "k", "part"], F.col("part") == 0, F.lit(None).cast("string")
    ends = F.when(first, F.col("k") == 2).otherwise(F.col("k") < 2)
    token = F.when(F.col("last") & ends, none).when(first, F.lit("tok")).otherwise(F.lit("tok2"))

    def pages(which: Column, row: Column) -> DataFrame:
        """The pages of each part of a search; the token is missing on an empty one behind them."""
        full = _gather(rows.where(which), by, row).withColumn("last", F.lit(False))
        behind = rows.where(which).select(*by).distinct().select(*by, F.lit(STOP - 1).alias("page_no"), F.lit("[]").alias("apps"), F.lit(True).alias("last"))
        return full.unionByName(behind).withColumn("page_no", F.col("part") * STOP + F.col("page_no"))

    heads, tails = pages(first, E.array([_flat_row()])), pages(~first, _batch_row())
    heads = heads.select("term", "page_no", E.page(E.script("ds:4", _container(22, F.col("apps"), token))).alias("body"))
    tails = tails.select("term", "page_no", F.when((F.col("k") == 0) & (F.col("part") == 1), F.lit("nonsense")).otherwise(_batch(F.col("apps"), token)).alias("body"))
    return relational.search(heads, tails, LONG_MAX).select("term", F.floor(F.col("page_no") / STOP).cast("int").alias("page_no"), "app_id", "title")


@query(f"SELECT {TERM} AS term, {_join('p_partkey')} AS app_id, p_name AS title FROM part")
def search_deep(spark, sf_dir):
    """Containers that are not where they should be: found by the depth-first search."""
    rows = _gather(_term(_parts(spark, sf_dir)), ["term"], E.array([_flat_row()]))
    body = E.page(E.script("ds:3", E.filled(E.text(E.array([F.lit("x"), [F.lit(1), {3: E.hole()}]])), F.col("apps"))))
    raw = rows.select("term", body.alias("body"))
    return tables.search_first(raw).select("term", "app_id", "title")


@query(f"SELECT {TERM} AS term, 'tok' AS first_token, 'tok2' AS more_token FROM part GROUP BY 1 HAVING min(p_partkey % 2) = 0 AND max(p_partkey % 2) = 1")
def search_tokens(spark, sf_dir):
    """The tokens of each term's last first page and last further page."""
    last = F.max_by("next_token", "page_no")
    first = tables.search_tokens(_search_first(spark, sf_dir)).groupBy("term").agg(last.alias("first_token"))
    more = tables.search_more_tokens(_search_more(spark, sf_dir)).groupBy("term").agg(last.alias("more_token"))
    return first.join(more, "term")


def _developer_sql(dev: str) -> str:
    return f"WITH r AS (SELECT {dev} AS dev_id, {_join('p_partkey')} AS app_id, p_name AS title, p_brand AS developer, CAST(4.5 AS DOUBLE) AS score, row_number() OVER (PARTITION BY {dev} ORDER BY p_partkey) AS n FROM part) SELECT dev_id, app_id, title, developer, score FROM r WHERE n <= 60"


def _developer(spark, sf_dir, dev: Column, place: int, wrapped: bool) -> DataFrame:
    rows = _gather(_parts(spark, sf_dir).withColumn("dev_id", dev), ["dev_id"], _flat_row(wrapped))
    raw = rows.select("dev_id", "page_no", E.page(E.script("ds:3", _container(place, F.col("apps")))).alias("body"))
    return relational.first_n(tables.developer(raw), 60, ["page_no", "pos"], ["dev_id"]).select("dev_id", "app_id", "title", "developer", "score")


@query(_developer_sql("CAST(9000000 + p_size AS VARCHAR)"))
def developer_numeric(spark, sf_dir):
    return _developer(spark, sf_dir, (F.lit(9000000) + F.col("p_size")).cast("string"), 21, False)


@query(_developer_sql("p_brand"))
def developer_name(spark, sf_dir):
    return _developer(spark, sf_dir, F.col("p_brand"), 22, True)


def _charts(spark, sf_dir, empty_paid: bool = False) -> DataFrame:
    """Chart pages of each brand; sections by size: small, middle, large. The second may be empty."""
    rows = _parts(spark, sf_dir).withColumn("s", (F.col("p_size") % 3).cast("int"))
    if empty_paid:
        rows = rows.where("s <> 1")
    packed = _gather(rows, ["p_brand", "s"], _chart_row()).groupBy("p_brand", "page_no").pivot("s", [0, 1, 2]).agg(F.first("apps"))
    sections = [E.array({21: [F.parse_json(F.coalesce(F.col(f"`{k}`"), F.lit("[]")))]}) for k in range(3)]
    body = E.page(E.script("ds:4", E.text(E.array([{1: sections}]))))
    return packed.select(F.col("p_brand").alias("category"), "page_no", body.alias("body"))


def _chart(pages: DataFrame, collection: str) -> DataFrame:
    return relational.chart(tables.charts(pages), collection, 60, ["category"], ["section_no", "page_no", "pos"]).select(*CHART_COLUMNS)


CHART = f"""WITH u AS (SELECT p_brand AS category, p_size % 3 AS s, p_partkey, {_join('p_partkey')} AS app_id, p_name AS title, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({MICROS} AS DOUBLE) / 1e6 END AS price,
  (p_partkey % 7 = 0 OR p_partkey % 3 = 0) AS free, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'USD' END AS currency FROM part)"""
CHART_COLUMNS = ["category", "app_id", "title", "price", "free", "currency"]


def _chart_sql(section: int, rows: str = "u") -> str:
    return f"{CHART}, f AS (SELECT *, max(CASE WHEN s = {section} THEN 1 ELSE 0 END) OVER (PARTITION BY category) AS own FROM {rows}), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY s, p_partkey) AS n FROM f WHERE s = {section} OR own = 0) SELECT {', '.join(CHART_COLUMNS)} FROM r WHERE n <= 60"


@query(_chart_sql(0))
def list_top_free(spark, sf_dir):
    return _chart(_charts(spark, sf_dir), "TOP_FREE")


@query(_chart_sql(2))
def list_grossing(spark, sf_dir):
    return _chart(_charts(spark, sf_dir), "GROSSING")


@query(_chart_sql(1, "(SELECT * FROM u WHERE s <> 1)"))
def list_fallback(spark, sf_dir):
    return _chart(_charts(spark, sf_dir, True), "TOP_PAID")


@query("SELECT 'com.p' || CAST(a.p_partkey AS VARCHAR) AS source_app_id, 'com.p' || CAST(b.p_partkey AS VARCHAR) AS app_id, b.p_name AS title, '' AS score_text FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type")
def similar(spark, sf_dir):
    """Two hops: details pages of all parts name the cluster page of their brand and type."""
    return _similar(_parts(spark, sf_dir), ["p_brand", "p_type"])


@query("SELECT 'com.p' || CAST(a.p_partkey AS VARCHAR) AS source_app_id, 'com.p' || CAST(b.p_partkey AS VARCHAR) AS app_id, b.p_name AS title, '' AS score_text FROM part a JOIN part b ON a.p_brand = b.p_brand")
def similar_all(spark, sf_dir):
    """The same with a cluster for each brand."""
    return _similar(_parts(spark, sf_dir), ["p_brand"])


def _similar(parts: DataFrame, by: list[str]) -> DataFrame:
    cluster = F.concat(F.lit("/cluster?b="), F.concat_ws("_", *by))
    decoy = [{21: {1: [F.lit("More by"), F.lit(None).cast("string"), {4: {2: F.lit("/wrong")}}]}}]
    hit = {21: {1: [F.lit("Similar apps"), F.lit(None).cast("string"), {4: {2: cluster}}]}}
    body = E.page(E.script("ds:7", E.text(E.array({1: {1: decoy}}))), E.script("ds:8", E.text(E.array({1: {1: [*decoy, hit]}}))))
    details = parts.select(F.col("id").alias("app_id"), F.lit("en").alias("lang"), F.lit("us").alias("country"), body.alias("body"))
    pages = _gather(parts, by, _flat_row()).select(F.concat(F.lit("https://play.google.com"), cluster, F.lit("&gl=us&hl=en")).alias("url"), E.page(E.script("ds:3", _container(21, F.col("apps")))).alias("body"))
    return relational.similar(details, pages).select("source_app_id", "app_id", "title", "score_text")


@query(f"""{RANKED} SELECT r.term, r.app_id, CASE WHEN p.p_partkey % 5 = 0 THEN r.url ELSE '{STORE}' || r.app_id || '&hl=en&gl=us' END AS url, CASE WHEN p.p_partkey % 5 = 0 THEN r.price WHEN p.p_partkey % 7 = 0 OR p.p_partkey % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({MICROS} AS DOUBLE) / 1e6 END AS price,
  CASE WHEN p.p_partkey % 5 = 0 THEN r.summary ELSE p.p_type END AS summary FROM r JOIN part p ON p.p_partkey = r.p_partkey WHERE n <= 250""")
def enrich(spark, sf_dir):
    """Details pages of all results; every fifth holds no app, and its result stays as it is."""
    return _enrich(spark, sf_dir, F.col("p_partkey") % 5 == 0)


@query(f"""{RANKED} SELECT r.term, r.app_id, '{STORE}' || r.app_id || '&hl=en&gl=us' AS url, CASE WHEN p.p_partkey % 7 = 0 OR p.p_partkey % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({MICROS} AS DOUBLE) / 1e6 END AS price,
  p.p_type AS summary FROM r JOIN part p ON p.p_partkey = r.p_partkey WHERE n <= 250""")
def enrich_all(spark, sf_dir):
    """Details of all results."""
    return _enrich(spark, sf_dir, F.lit(False))


def _enrich(spark, sf_dir, missing: Column) -> DataFrame:
    results = relational.search(_search_first(spark, sf_dir), _search_more(spark, sf_dir), 250)
    apps = tables.apps(_details(_parts(spark, sf_dir), missing=missing))
    return relational.enrich(results, apps).select("term", "app_id", "url", "price", "summary")


@query(f"""SELECT {TERM} AS term, lang, country, {_join('p_partkey')} AS app_id, p_name || ' ' || lang AS title, '{STORE}com.p' || CAST(p_partkey AS VARCHAR) || '&hl=' || lang || '&gl=' || country AS url
  FROM part, (VALUES ('en', 'us'), ('de', 'de')) l(lang, country)""")
def enrich_locales(spark, sf_dir):
    """Two locales in one raw store: a result takes the details of its own, the latest of two fetches."""
    locales = F.explode(F.array(*[F.struct(F.lit(a).alias("lang"), F.lit(b).alias("country")) for a, b in (("en", "us"), ("de", "de"))]))
    parts = _term(_parts(spark, sf_dir)).select("*", locales.alias("l")).select("*", "l.lang", "l.country")
    rows = _gather(parts, ["term", "lang", "country"], E.array([_flat_row()]))
    results = tables.search_first(rows.select("term", "lang", "country", "page_no", E.page(E.script("ds:4", _container(22, F.col("apps")))).alias("body")))
    title = F.concat("p_name", F.lit(" "), "lang")
    details = _details(parts, title=title, lang=F.col("lang"), country=F.col("country"))
    older = _details(parts, title=F.lit("old"), updated=F.lit(-1), lang=F.col("lang"), country=F.col("country"))
    return relational.enrich(results, tables.apps(older.unionByName(details))).select("term", "lang", "country", "app_id", "title", "url")


# reviews ----------------------------------------------------------------------------------------------------


def _events(spark, sf_dir) -> DataFrame:
    """Events as reviews: app by event type, score by id, 50 to a page."""
    rows = _table(spark, sf_dir, "events").withColumn("app_id", F.concat(F.lit("com."), F.col("event_type")))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.withColumn("seconds", F.floor(micros / 1000000)).withColumn("nanos", (micros % 1000000) * 1000).withColumn("score", (1 + F.col("event_id") % 5).cast("int"))


def _review_pages(rows: DataFrame, by: list[str], page: Column) -> DataFrame:
    """Response pages of reviews: ``page`` gives a row's page; the last page of a group has no token."""
    reply = F.when(F.col("event_id") % 4 == 0, E.array([F.lit(0), F.lit("thanks"), [F.col("seconds") + 60]])).otherwise(F.parse_json(F.lit("null")))
    review = E.array({0: F.concat(F.lit("r"), F.col("event_id").cast("string")), 1: [F.concat(F.lit("user"), F.col("user_id").cast("string")), {3: {2: F.lit("https://face")}}], 2: F.col("score"), 4: F.col("event_type"), 5: [F.col("seconds"), F.col("nanos")], 6: F.floor("value").cast("long"), 7: reply, 10: F.lit("1.0")})
    packed = rows.withColumn("page_no", page.cast("int")).withColumn("row", F.to_json(review)).groupBy(*by, "page_no").agg(F.array_sort(F.collect_list(F.struct("event_id", "row"))).alias("rows"))
    last = packed.groupBy(*by).agg(F.max("page_no").alias("last"))
    inner = F.concat(F.lit("[["), F.array_join(F.transform("rows", lambda r: r["row"]), ","), F.lit(",7],"), F.when(F.col("page_no") < F.col("last"), F.concat(F.lit('[null,"t'), F.col("page_no").cast("string"), F.lit('"]'))).otherwise(F.lit("null")), F.lit("]"))
    return packed.join(last, by).select(*by, "page_no", E.response(inner).alias("body"))


def _paged(spark, sf_dir) -> DataFrame:
    return _review_pages(_events(spark, sf_dir), ["app_id"], F.floor(F.col("event_id") / 500))


MILLIS = "(epoch_us(ts) // 1000000) * 1000 + CAST(left(CAST((epoch_us(ts) % 1000000) * 1000 AS VARCHAR), 3) AS BIGINT)"
REVIEW = f"""SELECT 'com.' || event_type AS app_id, 'r' || CAST(event_id AS VARCHAR) AS id, 'user' || CAST(user_id AS VARCHAR) AS user_name, CAST(1 + event_id % 5 AS BIGINT) AS score, CAST(floor(value) AS BIGINT) AS thumbs_up, event_type AS text,
  {MILLIS} AS date_ms, CASE WHEN event_id % 4 = 0 THEN 'thanks' ELSE '' END AS reply_text, CASE WHEN event_id % 4 = 0 THEN (epoch_us(ts) // 1000000 + 60) * 1000 END AS reply_ms, event_id, event_id // 500 AS page_no FROM events"""
REVIEW_COLUMNS = ["app_id", "id", "user_name", "score", "thumbs_up", "text", "date_ms", "reply_text", "reply_ms"]


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("date_ms", F.unix_millis("date")).withColumn("reply_ms", F.unix_millis("reply_date")).select(*REVIEW_COLUMNS)


@query(f"SELECT {', '.join(REVIEW_COLUMNS)} FROM ({REVIEW})")
def reviews_parse(spark, sf_dir):
    return _shown(tables.reviews(_paged(spark, sf_dir)))


@query(f"SELECT {', '.join('CASE WHEN event_id % 7 = 0 THEN NULL ELSE ' + c + ' END AS ' + c if c in ('date_ms', 'reply_ms') else c for c in REVIEW_COLUMNS)} FROM ({REVIEW})")
def reviews_bad_time(spark, sf_dir):
    """Some reviews hold a time that no calendar has: it is missing, and the job goes on."""
    bad = F.when(F.col("event_id") % 7 == 0, F.lit(10**17)).otherwise(F.col("seconds"))
    return _shown(tables.reviews(_review_pages(_events(spark, sf_dir).withColumn("seconds", bad), ["app_id"], F.floor(F.col("event_id") / 500))))


@query(f"SELECT app_id, page_no, 'ok' AS status, CASE WHEN page_no < max(page_no) OVER (PARTITION BY app_id) THEN 't' || CAST(page_no AS VARCHAR) ELSE '' END AS next_token FROM (SELECT DISTINCT app_id, CAST(page_no AS INTEGER) AS page_no FROM ({REVIEW}))")
def reviews_tokens(spark, sf_dir):
    return tables.review_pages(_paged(spark, sf_dir)).select("app_id", "page_no", "status", "next_token")


def _top(order: str, n: int = 150, where: str = "true") -> str:
    return f"SELECT {', '.join(REVIEW_COLUMNS)} FROM ({REVIEW}) WHERE {where} ORDER BY {order}, id LIMIT {n}"


@query(_top("date_ms DESC"))
def reviews_newest(spark, sf_dir):
    return _shown(relational.sort_reviews(tables.reviews(_paged(spark, sf_dir)), Sort.NEWEST).limit(150))


@query(_top("thumbs_up DESC"))
def reviews_helpful(spark, sf_dir):
    return _shown(relational.sort_reviews(tables.reviews(_paged(spark, sf_dir)), Sort.HELPFULNESS).limit(150))


@query(_top("score DESC"))
def reviews_by_rating(spark, sf_dir):
    return _shown(relational.sort_reviews(tables.reviews(_paged(spark, sf_dir)), Sort.RATING).limit(150))


@query(f"SELECT {', '.join(REVIEW_COLUMNS)} FROM ({REVIEW}) WHERE score = 4")
def reviews_filter_score(spark, sf_dir):
    return _shown(relational.score_filter(tables.reviews(_paged(spark, sf_dir)), 4))


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY event_id) AS n FROM ({REVIEW})) SELECT {', '.join(REVIEW_COLUMNS)} FROM r WHERE n <= 500")
def reviews_all(spark, sf_dir):
    return _shown(relational.reviews_all(_paged(spark, sf_dir), 500))


@query(f"WITH q AS (SELECT *, score AS asked FROM ({REVIEW}) UNION ALL SELECT *, 1 + (score % 5) FROM ({REVIEW}) WHERE event_id % 10 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY app_id, asked ORDER BY page_no, event_id) AS n FROM q), d AS (SELECT *, row_number() OVER (PARTITION BY app_id, id ORDER BY asked, page_no, event_id) AS k FROM r WHERE n <= 200) SELECT {', '.join(REVIEW_COLUMNS)} FROM d WHERE k = 1")
def reviews_comprehensive(spark, sf_dir):
    """Five rating queries; some reviews come back under two ratings and count once."""
    rows = _events(spark, sf_dir)
    twice = rows.withColumn("score_query", F.col("score")).unionByName(rows.where("event_id % 10 = 0").withColumn("score_query", (1 + F.col("score") % 5).cast("int")))
    pages = _review_pages(twice, ["app_id", "score_query"], F.floor(F.col("event_id") / 500))
    return _shown(relational.reviews_comprehensive(pages, 200))


def _broken(spark, sf_dir) -> DataFrame:
    """Review pages of which every fourth is no response, from another page on in each app."""
    wrong = F.col("page_no") % 4 == F.length("app_id") % 4
    return _paged(spark, sf_dir).withColumn("body", F.when(wrong, F.lit(")]}'\nnonsense")).otherwise(F.col("body")))


#: What a read up to 250 reviews comes to: the pages before the first broken one, and that one if the total is not there before.
BROKEN = f"""p AS (SELECT app_id, page_no, count(*) AS n, page_no % 4 = length(app_id) % 4 AS wrong FROM ({REVIEW}) GROUP BY app_id, page_no),
  w AS (SELECT *, coalesce(max(wrong::INT) OVER b, 0) = 1 AS over, coalesce(sum(n) OVER b, 0) AS before FROM p WINDOW b AS (PARTITION BY app_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"WITH {BROKEN} SELECT app_id, CAST(page_no AS INTEGER) AS page_no, 'malformed response' AS error, CAST(before AS BIGINT) AS n_reviews FROM w WHERE wrong AND NOT over AND before < 250")
def reviews_all_errors(spark, sf_dir):
    """Only the error that ended a read: those of later pages, or behind the total, are never met."""
    return relational.reviews_all_errors(_broken(spark, sf_dir), 250)


@query(f"""WITH {BROKEN}, r AS (SELECT r.*, row_number() OVER (PARTITION BY r.app_id ORDER BY r.event_id) AS k FROM ({REVIEW}) r JOIN w ON r.app_id = w.app_id AND r.page_no = w.page_no WHERE NOT w.over AND NOT w.wrong AND before < 250)
  SELECT app_id, CAST(page_no AS INTEGER) AS page_no, id, score, CAST(NULL AS VARCHAR) AS failed FROM r WHERE k <= 250
  UNION ALL SELECT app_id, CAST(page_no AS INTEGER), NULL, NULL, 'malformed response' FROM w WHERE wrong AND NOT over AND before < 250""")
def reviews_outcome(spark, sf_dir):
    """Reviews and the error of one read."""
    return relational.reviews_outcome(_broken(spark, sf_dir), 250).select("app_id", "page_no", "id", "score", "failed")


@query(f"""WITH a AS (SELECT *, event_id % 2 AS arrival, ts FROM (SELECT r.*, e.ts FROM ({REVIEW}) r JOIN events e USING (event_id)) UNION ALL SELECT *, event_id % 2 + 1, ts FROM (SELECT r.*, e.ts FROM ({REVIEW}) r JOIN events e USING (event_id)) WHERE event_id % 5 = 0)
  SELECT app_id, id, CAST(min(arrival) AS INTEGER) AS arrival FROM a GROUP BY app_id, id""")
def reviews_merged(spark, sf_dir):
    """Reviews arrive in three goes, some of them again in the next; each counts in the go that it was first seen in."""
    rows = _events(spark, sf_dir).withColumn("arrival", (F.col("event_id") % 2).cast("int"))
    twice = rows.unionByName(rows.where("event_id % 5 = 0").withColumn("arrival", F.col("arrival") + 1))
    seen = tables.reviews(_review_pages(twice, ["app_id", "arrival"], F.floor(F.col("event_id") / 500)), []).select("app_id", "id", "arrival", "page_no", "pos")
    keys, order = ["app_id", "id"], ["page_no", "pos"]
    goes = [relational.first_seen(seen.where("arrival = 0"), keys, order)]
    goes += [relational.unseen(seen.where(F.col("arrival") == k), seen.where(F.col("arrival") < k), keys, order) for k in (1, 2)]
    return goes[0].unionByName(goes[1]).unionByName(goes[2]).select("app_id", "id", "arrival")


# analytics --------------------------------------------------------------------------------------------------


@query(f"SELECT app_id, count(*) AS n_reviews, round(avg(score), 6) AS avg_score FROM ({REVIEW}) GROUP BY app_id")
def score_stats(spark, sf_dir):
    return analytics.score_stats(tables.reviews(_paged(spark, sf_dir), ["score"]), ["app_id"]).withColumn("avg_score", F.round("avg_score", 6))


@query(f"SELECT s.score, count(r.score) AS n, round(100.0 * count(r.score) / sum(count(r.score)) OVER (), 1) AS percent FROM (SELECT CAST(unnest(range(1, 6)) AS BIGINT) AS score) s LEFT JOIN ({REVIEW}) r ON r.score = s.score GROUP BY s.score")
def score_distribution(spark, sf_dir):
    return analytics.score_distribution(tables.reviews(_paged(spark, sf_dir), ["score"]))


@query(f"SELECT s.score, count(r.score) AS n, round(100.0 * count(r.score) / sum(count(r.score)) OVER (), 1) AS percent FROM (SELECT CAST(unnest(range(1, 6)) AS BIGINT) AS score) s LEFT JOIN ({REVIEW}) r ON r.score = s.score GROUP BY s.score")
def score_distribution_all(spark, sf_dir):
    """The same over all reviews."""
    return analytics.score_distribution(tables.reviews(_paged(spark, sf_dir), ["score"]))


@query(f"SELECT app_id, count(*) AS n FROM ({REVIEW}) WHERE date_ms > epoch_ms(TIMESTAMP '2024-01-15 00:00:00') GROUP BY app_id")
def recent_reviews(spark, sf_dir):
    as_of = F.lit(datetime(2025, 1, 15)).cast("timestamp_ntz").cast("timestamp")
    return analytics.recent(tables.reviews(_paged(spark, sf_dir), ["date"]), as_of).groupBy("app_id").agg(F.count("*").alias("n"))


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY date_ms DESC, id) AS n FROM ({REVIEW})) SELECT app_id, CAST(n AS INTEGER) AS n, id, score, left(text, 200) AS preview FROM r WHERE n <= 5")
def latest_reviews(spark, sf_dir):
    return analytics.latest(tables.reviews(_paged(spark, sf_dir), ["score", "date", "text"]), 5, ["app_id"]).drop("date")


_STARS = ", ".join([f"count(CASE WHEN score = {k} THEN 1 END) AS n{k}" for k in range(5, 0, -1)] + [f"round(100.0 * count(CASE WHEN score = {k} THEN 1 END) / count(*), 1) AS percent{k}" for k in range(5, 0, -1)])


@query(f"""WITH r AS ({REVIEW}), l AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY date_ms DESC, id) AS k FROM r)
  SELECT a.*, l.date_ms AS latest_ms, l.score AS latest_score, l.user_name AS latest_user, l.text AS latest_text
  FROM (SELECT app_id, count(*) AS n_reviews, round(avg(score), 2) AS avg_score, {_STARS} FROM r GROUP BY app_id) a JOIN l ON a.app_id = l.app_id AND l.k = 1""")
def review_report(spark, sf_dir):
    rows = analytics.report(tables.reviews(_paged(spark, sf_dir), ["score", "date", "user_name", "text"]))
    return rows.withColumn("latest_ms", F.unix_millis("latest_date")).drop("latest_date")


@query("SELECT p_name AS title, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def repeated_titles(spark, sf_dir):
    return analytics.repeated(tables.apps(_details(_parts(spark, sf_dir))), "title")


@query("SELECT count(DISTINCT p_brand) AS n_developers FROM part")
def distinct_developers(spark, sf_dir):
    return analytics.distinct_developers(tables.apps(_details(_parts(spark, sf_dir))))


# permissions, data safety, suggestions, categories ------------------------------------------------------------


@query("""SELECT 'com.r' || CAST(r_regionkey AS VARCHAR) AS app_id, CASE WHEN n_nationkey % 4 = 3 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'Common' ELSE 'Other' END ELSE 'group' || CAST(n_nationkey % 4 AS VARCHAR) END AS type, n_name AS permission
  FROM nation JOIN region ON n_regionkey = r_regionkey""")
def permissions(spark, sf_dir):
    """Nations as permissions: kind by parity, group by the remainder of four; the last group has no name."""
    rows = _table(spark, sf_dir, "nation").withColumn("kind", F.col("n_nationkey") % 2).withColumn("g", F.col("n_nationkey") % 4)
    groups = rows.groupBy("n_regionkey", "kind", "g").agg(F.array_sort(F.collect_list(F.to_json(E.array([F.lit(None).cast("string"), F.col("n_name")])))).alias("p"))
    name = F.when(F.col("g") == 3, F.lit("null")).otherwise(F.concat(F.lit('"group'), F.col("g").cast("string"), F.lit('"')))
    row = F.concat(F.lit("["), name, F.lit(',1,["short",["one"],'), F.array_join("p", ","), F.lit("]]"))
    kinds = groups.groupBy("n_regionkey").pivot("kind", [0, 1]).agg(F.array_join(F.array_sort(F.collect_list(row)), ","))
    inner = F.concat(F.lit('[[["short",1],'), F.coalesce("0", F.lit("1")), F.lit("],["), F.coalesce("1", F.lit("1")), F.lit("],[]]"))
    raw = kinds.select(F.concat(F.lit("com.r"), F.col("n_regionkey").cast("string")).alias("app_id"), E.response(inner).alias("body"))
    return tables.permissions(raw).select("app_id", "type", "permission")


def _safety(spark, sf_dir) -> DataFrame:
    entry = lambda name, optional, why: [name, optional, why]
    group = lambda *rows: {0: [F.lit("icon"), F.concat(F.lit("type"), F.col("s_nationkey").cast("string"))], 4: list(rows)}
    shared = [group(entry(F.col("s_name"), F.col("s_suppkey") % 2, F.lit("ads")), entry(F.lit(""), F.lit(1), F.lit("dropped")))]
    collected = [group(entry(F.concat(F.lit("c "), F.col("s_name")), F.lit(0), F.lit("analytics"))), F.lit("bad"), {0: [F.lit("x")]}]
    practices = [[F.lit(1), F.lit("Encrypted"), [F.lit(0), F.concat(F.lit("by "), F.col("s_name"))]], [F.lit(1), F.lit("short")]]
    section = E.array({4: [[shared], [collected]], 9: {2: practices}})
    named = F.concat(F.lit('{"138":'), E.text(section), F.lit(',"100":[[0,0,0,0,0,[0,0,"https://privacy"]]]}'))
    body = E.page(E.script("ds:3", E.text(E.array({1: {2: {1: F.parse_json(named)}}}))))
    none = E.page(E.script("ds:1", F.lit("[]")))
    app_id = F.concat(F.lit("com.s"), F.col("s_suppkey").cast("string"))
    return _table(spark, sf_dir, "supplier").select(app_id.alias("app_id"), F.when(F.col("s_suppkey") % 9 == 0, none).otherwise(body).alias("body"))


@query("""SELECT 'com.s' || CAST(s_suppkey AS VARCHAR) AS app_id, 'shared' AS scope, s_name AS data, s_suppkey % 2 = 1 AS optional, 'ads' AS purpose, 'type' || CAST(s_nationkey AS VARCHAR) AS type FROM supplier WHERE s_suppkey % 9 <> 0
  UNION ALL SELECT 'com.s' || CAST(s_suppkey AS VARCHAR), 'collected', 'c ' || s_name, false, 'analytics', 'type' || CAST(s_nationkey AS VARCHAR) FROM supplier WHERE s_suppkey % 9 <> 0""")
def data_safety(spark, sf_dir):
    return tables.data_safety_entries(_safety(spark, sf_dir)).drop("pos")


@query("SELECT 'com.s' || CAST(s_suppkey AS VARCHAR) AS app_id, 'https://privacy' AS privacy_policy_url, 'Encrypted' AS practice, 'by ' || s_name AS description FROM supplier WHERE s_suppkey % 9 <> 0")
def security_practices(spark, sf_dir):
    wide = tables.data_safety(_safety(spark, sf_dir))
    return wide.select("app_id", "privacy_policy_url", F.explode("security_practices").alias("p")).select("app_id", "privacy_policy_url", "p.*")


#: Characters of a name by which the names of a term are dealt out, and names on a page.
HEAD, NAMES = 15, 500


@query("WITH r AS (SELECT left(c_name, 10) AS term, c_name, row_number() OVER (PARTITION BY left(c_name, 10) ORDER BY c_name) AS n FROM customer) SELECT term, CAST(n AS INTEGER) AS pos, c_name AS suggestion FROM r")
def suggest(spark, sf_dir):
    return tables.suggestions(_names(spark, sf_dir)).select("term", (F.col("before") + F.col("pos")).cast("int").alias("pos"), "suggestion")


def _names(spark, sf_dir) -> DataFrame:
    """A term's names in pages of a bounded number. They are ranked among those with the same head, so a term is not sorted as a
    whole; as many names come before a head as the heads before it have, and a malformed row leads each page."""
    names = _table(spark, sf_dir, "customer").select(F.left("c_name", F.lit(10)).alias("term"), F.left("c_name", F.lit(HEAD)).alias("head"), "c_name")
    earlier = Window.partitionBy("term").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    heads = names.groupBy("term", "head").agg(F.count("*").alias("n")).select("term", "head", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("term", "head").orderBy("c_name")) - 1
    ranked = names.withColumn("rank", rank).withColumn("page_no", F.floor(F.col("rank") / NAMES))
    packed = ranked.groupBy("term", "head", "page_no").agg(F.array_sort(F.collect_list("c_name")).alias("names")).join(heads, ["term", "head"])
    listed = F.concat(F.lit("[[[5],"), F.array_join(F.transform("names", lambda n: F.to_json(E.array([n]))), ","), F.lit("]]"))
    return packed.select("term", (F.col("before") + F.col("page_no") * NAMES).alias("before"), E.response(F.concat(F.lit("["), listed, F.lit("]"))).alias("body"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, '{c}')" for k, c in enumerate(CATEGORIES)) + ") t(pos, category)")
def categories(spark, sf_dir):
    return tables.categories(spark)


@query("""SELECT p_partkey, 'https://play.google.com/store/search?q=' || replace(p_name, ' ', '+') || '&hl=en&gl=us&price=' || CASE WHEN p_partkey % 3 = 0 THEN '1' WHEN p_partkey % 3 = 1 THEN '2' ELSE '0' END || '&c=apps' AS search_url,
  'https://play.google.com/store/apps/' || CASE WHEN p_partkey % 2 = 0 THEN 'dev?id=' || CAST(p_partkey AS VARCHAR) ELSE 'developer?id=' || replace(replace(p_brand, '#', '%23'), ' ', '+') END || '&hl=en&gl=us' AS developer_url FROM part""")
def request_urls(spark, sf_dir):
    from ..sources import requests

    rows, en, us = _parts(spark, sf_dir), F.lit("en"), F.lit("us")
    price = F.when(F.col("p_partkey") % 3 == 0, F.lit("Free")).when(F.col("p_partkey") % 3 == 1, F.lit("paid")).otherwise(F.lit("all"))
    dev = F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise(F.col("p_brand"))
    return rows.select("p_partkey", requests.search(F.col("p_name"), en, us, price).alias("search_url"), requests.developer(dev, en, us).alias("developer_url"))


KINDS = ["app", "search", "developer", "list", "data_safety", "reviews", "permissions", "suggest", "other"]
_KIND = "CASE p_partkey % 9 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(KINDS)) + " END"
_ASKED = f"""SELECT p_partkey, {_KIND} AS kind, CASE WHEN p_partkey % 5 > 0 THEN 'com.p' || CAST(p_partkey AS VARCHAR) ELSE '' END AS app_id, CASE WHEN p_partkey % 5 > 0 THEN p_name ELSE '' END AS term,
  CASE WHEN p_partkey % 5 > 0 THEN p_brand ELSE '' END AS dev_id, CASE WHEN p_partkey % 2 = 0 THEN 'de' ELSE 'en' END AS lang, CASE WHEN p_partkey % 4 = 0 THEN 'at' ELSE 'us' END AS country, CAST(p_size * 10 - 60 AS INTEGER) AS num FROM part"""
_WRONG = """CASE WHEN kind IN ('app', 'data_safety', 'reviews', 'permissions') AND app_id = '' THEN 'app id is required' WHEN kind = 'search' AND term = '' THEN 'search term is required' WHEN kind = 'suggest' AND term = '' THEN 'term is required'
  WHEN kind = 'developer' AND dev_id = '' THEN 'developer id is required' WHEN kind = 'other' THEN 'unknown kind' WHEN num < 0 THEN 'a number of results can''t be negative' WHEN kind = 'search' AND num > 250 THEN 'at most 250 results' END"""
_URL = """'https://play.google.com' || CASE kind WHEN 'app' THEN '/store/apps/details?id=' || app_id || '&' WHEN 'data_safety' THEN '/store/apps/datasafety?id=' || app_id || '&' WHEN 'search' THEN '/store/search?q=' || replace(term, ' ', '+') || '&'
  WHEN 'developer' THEN '/store/apps/developer?id=' || replace(replace(dev_id, '#', '%23'), ' ', '+') || '&' WHEN 'list' THEN '/store/apps/top?' ELSE '/_/PlayStoreUi/data/batchexecute?' || CASE kind WHEN 'permissions' THEN 'rpcids=xdSrCf&' WHEN 'suggest' THEN 'rpcids=IJ4APc&' ELSE '' END END
  || 'hl=' || lang || '&gl=' || country || CASE WHEN kind = 'search' THEN '&price=0&c=apps' ELSE '' END"""


def _asked(spark, sf_dir) -> DataFrame:
    """Parts as requests of all kinds; some lack what they need, their locale or their number."""
    key, some = F.col("p_partkey"), F.col("p_partkey") % 5 > 0
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (key % len(KINDS) + 1).cast("int"))
    return _parts(spark, sf_dir).select(
        "p_partkey", kind.alias("kind"), F.when(some, F.col("id")).alias("app_id"), F.when(some, F.col("p_name")).otherwise("").alias("term"), F.when(some, F.col("p_brand")).alias("dev_id"),
        F.when(key % 2 == 0, "de").alias("lang"), F.when(key % 4 == 0, "at").alias("country"), (F.col("p_size") * 10 - 60).alias("num"),
    )


@query(f"SELECT p_partkey, kind, error, CASE WHEN error IS NULL THEN {_URL} END AS url FROM (SELECT *, {_WRONG} AS error FROM ({_ASKED}))")
def request_checks(spark, sf_dir):
    """A table of requests: which may be made, and what is wrong with the others."""
    from ..sources import requests

    return requests.prepared(_asked(spark, sf_dir)).select("p_partkey", "kind", "error", "url")


@query(f"SELECT p_partkey, kind, lang, country, CASE WHEN num <> 0 THEN num ELSE CASE kind WHEN 'search' THEN 20 WHEN 'developer' THEN 60 WHEN 'list' THEN 60 WHEN 'reviews' THEN 150 END END AS num, CAST(2 AS INTEGER) AS sort, 'all' AS price, 'APPLICATION' AS category FROM ({_ASKED})")
def request_defaults(spark, sf_dir):
    """What is meant where a request says nothing."""
    from ..sources import requests

    return requests.prepared(_asked(spark, sf_dir)).select("p_partkey", "kind", "lang", "country", "num", "sort", "price", "category")


@query("SELECT p_partkey, 'https://play.google.com/store/apps/details' || CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN '?id=com.p' || CAST(p_partkey AS VARCHAR) ELSE '?brand=' || p_brand || '&id=com.p' || CAST(p_partkey AS VARCHAR) END AS url FROM part")
def request_parameters(spark, sf_dir):
    """Addresses from maps of none, one or two parameters, in the order of their names."""
    from ..sources import requests

    rows = _parts(spark, sf_dir)
    none = F.map_from_arrays(*[F.array().cast("array<string>")] * 2)
    values = F.when(F.col("p_partkey") % 3 == 0, none).when(F.col("p_partkey") % 3 == 1, F.create_map(F.lit("id"), "id")).otherwise(F.create_map(F.lit("id"), F.col("id"), F.lit("brand"), F.col("p_brand")))
    return rows.select("p_partkey", requests.parameters("https://play.google.com", "/store/apps/details", values).alias("url"))


def _form(payload: str) -> str:
    return f"'f.req=' || url_encode({payload})"


_TOKEN = """CASE WHEN p_partkey % 2 = 0 THEN ',null,\\"t' || CAST(p_partkey AS VARCHAR) || '\\"' ELSE '' END"""
_SCORE = "CASE WHEN p_partkey % 7 BETWEEN 1 AND 5 THEN CAST(p_partkey % 7 AS VARCHAR) ELSE 'null' END"
_REVIEWS = f"""'[[["oCPfdb","[null,[2,' || CAST(1 + p_partkey % 3 AS VARCHAR) || ',[' || CAST(least(p_size * 10, 150) AS VARCHAR) || {_TOKEN} || '],null,[null,' || {_SCORE} || ']],[\\"com.p' || CAST(p_partkey AS VARCHAR) || '\\",7]]",null,"generic"]]]'"""
_MORE = """'[[["qnKhOb","[[null,[[10,[10,50]],true,null,[96,27,4,8,57,30,110,79,11,16,49,1,3,9,12,104,55,56,51,10,34,77]],[null,\\"t' || CAST(p_partkey AS VARCHAR) || '\\"]]",null,"generic"]]]'"""
_PERMISSIONS = """'[[["xdSrCf","[[null,[\\"com.p' || CAST(p_partkey AS VARCHAR) || '\\",7],[]]]",null,"1"]]]'"""
_SUGGEST = """'[[["IJ4APc","[[null,[\\"' || split_part(p_name, ' ', 1) || '\\"],[10],[2],4]]"]]]'"""


@query(f"""SELECT p_partkey, {_form(_REVIEWS)} AS reviews, {_form(_MORE)} AS search_more, {_form(_PERMISSIONS)} AS permissions, {_form(_SUGGEST)} AS suggest,
  'https://play.google.com/store/apps/' || CASE p_partkey % 3 WHEN 0 THEN 'top' WHEN 1 THEN 'top' ELSE 'category/TOOLS' END || '?hl=de&gl=at' || CASE WHEN p_partkey % 2 = 0 THEN '&age=AGE_RANGE1' ELSE '' END AS chart FROM part""")
def request_bodies(spark, sf_dir):
    """Bodies of calls and addresses of charts: page sizes, sort codes, score filters, tokens, sections."""
    from ..sources import requests

    key, even = F.col("p_partkey"), F.col("p_partkey") % 2 == 0
    token = F.concat(F.lit("t"), key.cast("string"))
    category = F.when(key % 3 == 0, "APPLICATION").when(key % 3 == 1, "GAME").otherwise("TOOLS")
    return _parts(spark, sf_dir).select(
        "p_partkey",
        requests.reviews(F.col("id"), 1 + key % 3, F.col("p_size") * 10, (key % 7).cast("int"), F.when(even, token).otherwise(F.lit(""))).alias("reviews"),
        requests.search_more(token).alias("search_more"), requests.permissions(F.col("id")).alias("permissions"), requests.suggest(F.substring_index("p_name", " ", 1)).alias("suggest"),
        requests.chart(category, F.when(even, "AGE_RANGE1").otherwise(F.lit("")), F.lit("de"), F.lit("at")).alias("chart"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 8 = 7 THEN 'ok' ELSE 'error' END AS strict, CASE WHEN event_id % 8 IN (2, 3, 4) THEN 'empty' WHEN event_id % 8 = 7 THEN 'ok' ELSE 'error' END AS tolerant FROM events""")
def envelope_errors(spark, sf_dir):
    """Bodies that are empty, no JSON, without rows, short, without an inner text, or with a malformed one."""
    from ..functions.payload import envelope

    inner = F.to_json(E.array([F.col("event_id")]))
    bodies = ["", "nonsense", ")]}'\n[]", ")]}'\n[[\"a\",\"b\"]]", ")]}'\n[[\"a\",\"b\",null]]", ")]}'\n[[\"a\",\"b\",\"[1\"]]", ")]}'\n[1]"]
    body = E.response(inner)
    for k, b in enumerate(bodies):
        body = F.when(F.col("event_id") % 8 == k, F.lit(b)).otherwise(body)
    rows = _table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    return rows.select("event_id", envelope(F.col("body"), False)["status"].alias("strict"), envelope(F.col("body"), True)["status"].alias("tolerant"))


@query("""SELECT event_id, regexp_replace(CAST(value AS VARCHAR), '[.]0$', '') AS number, CASE WHEN event_id = 0 THEN '0' ELSE left(d, 1) || CASE WHEN length(d) > 1 THEN '.' || substr(d, 2) ELSE '' END || 'e+' || lpad(CAST(length(CAST(event_id AS VARCHAR)) + 5 AS VARCHAR), 2, '0') END AS large,
  CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS flag, event_type AS text, '' AS none, '[' || CAST(event_id AS VARCHAR) || ']' AS list FROM (SELECT *, rtrim(CAST(event_id AS VARCHAR), '0') AS d FROM events)""")
def loose_text(spark, sf_dir):
    """Values of any kind as text."""
    from ..functions.variant import to_string

    rows = _table(spark, sf_dir, "events")
    doc = F.to_json(E.array([F.col("value"), F.col("event_id") * 1_000_000, F.col("event_id") % 2 == 0, F.col("event_type"), F.lit(None).cast("string"), [F.col("event_id")]]))
    names = ("number", "large", "flag", "text", "none", "list")
    return rows.select("event_id", strict(doc).alias("v")).select("event_id", *[to_string(path(F.col("v"), k)).alias(x) for k, x in enumerate(names)])


@query(f"SELECT {_join('l_partkey')} AS app_id, count(CASE WHEN l_linenumber <= 5 THEN 1 END) AS total FROM lineitem GROUP BY l_partkey")
def histogram_totals(spark, sf_dir):
    return analytics.histogram_total(_histograms(spark, sf_dir))


def stored() -> dict[str, tuple[Query, Callable[[DataFrame], DataFrame]]]:
    """What encodes bodies, and what reads them: for timing the readers on bodies that are stored already."""
    return {
        "app_details": (lambda spark, sf_dir: _details(_parts(spark, sf_dir)), tables.apps),
        "search_first_page": (_search_first, tables.search_first),
        "reviews_parse": (_paged, tables.reviews),
        "reviews_all": (_paged, lambda pages: relational.reviews_all(pages, 500)),
    }


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
