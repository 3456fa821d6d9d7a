"""Readers and paged queries on hand-made payloads."""

import json
from datetime import datetime

import pytest

from storelens import schemas
from storelens.operators import relational, tables
from storelens.sources import requests, sinks
from pyspark.sql import functions as F


def sparse(**at):
    out = [None] * (max(int(k[1:]) for k in at) + 1)
    for k, v in at.items():
        out[int(k[1:])] = v
    return out


def block(key, data):
    return f"AF_initDataCallback({{key: '{key}', hash: '1', data:{json.dumps(data)}, sideChannel: {{}}}});"


def response(inner):
    return ")]}'\n" + json.dumps([["wrb.fr", "x", json.dumps(inner) if inner is not None else None]])


def raw(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def container(place, apps, token=None):
    cell = [None] * 23
    cell[place] = [apps]
    if token:
        cell[0] = sparse(_3=[token])
    return [[None, [cell]]]


def row(app_id, title="T", **more):
    return sparse(_0=[app_id], _1=[None, None, None, [None, None, "icon"]], _3=title, _4=["4.5", 4.5], _14="Dev", **more)


def test_app_page_error_and_zero_values(spark):
    good = block("ds:5", [None, [None, None, sparse(_0=["Title"])]])
    df = raw(spark, "app_id string, lang string, country string, body string", ("a", "en", "us", good), ("b", "en", "us", "<html></html>"))
    (app,) = tables.apps(df).collect()
    assert (app.app_id, app.title, app.score, app.ratings, app.free, app.price, app.histogram, app.screenshots, app.categories, app.available) == ("a", "Title", 0.0, 0, True, 0.0, [0] * 5, [], [], True)
    assert len(app) == 40 and (app.lang, app.country) == ("en", "us")
    assert [r.app_id for r in tables.app_errors(df).collect()] == ["b"]


@pytest.mark.parametrize("place", [22, 21, 0])
def test_search_containers(spark, place):
    body = block("ds:1", container(22, [row("com.other")])) + block("ds:4", container(place, [[row("com.a")], row("com.b"), row("ru.c"), "bad"], "tok" if place else None))
    df = raw(spark, "term string, page_no int, body string", ("t", 0, body))
    assert [r.app_id for r in tables.search_first(df).orderBy("pos").collect()] == ["com.a", "com.b"]
    if place:
        assert tables.search_tokens(df).first().next_token == "tok"


def test_search_precedence_keeps_a_useless_block(spark):
    body = block("ds:1", container(22, [row("com.other")])) + block("ds:4", [])
    assert tables.search_first(raw(spark, "term string, page_no int, body string", ("t", 0, body))).count() == 0


def test_search_depth_first(spark):
    body = block("ds:3", {"x": 1, "y": [[row("com.skipped")]]}) + block("ds:4", [1, [[2, ["bad", row("com.a"), row("com.b")]], [[9], [[row("com.later")]]]]])
    assert [r.app_id for r in tables.search_first(raw(spark, "term string, page_no int, body string", ("t", 0, body))).orderBy("pos").collect()] == ["com.a", "com.b"]


def test_search_batch(spark):
    good = sparse(_2="Title", _4=[[["Maker"]]], _12=["any.id"])
    df = raw(spark, "term string, page_no int, body string", ("t", 1, response([[[[good, "bad", sparse(_2="no id")], None, None, None, None, None, None, [None, "next"]]]])), ("u", 1, response(None)), ("v", 1, "x\nbad"))
    (r,) = tables.search_more(df).collect()
    assert (r.app_id, r.title, r.developer, r.free, r.url) == ("any.id", "Title", "Maker", True, "")
    pages = {r.term: (r.status, r.next_token) for r in tables.search_more_tokens(df).collect()}
    assert pages["u"] == ("empty", "") and pages["v"][0] == "error"


def test_developer_layouts_and_limit(spark):
    named = [[["app.n"], None, None, "N"]]
    df = raw(spark, "dev_id string, body string", ("123", block("ds:3", container(21, [row(f"com.{k}") for k in range(5)] + [row("")]))), ("Some Dev", block("ds:3", container(22, [[x] for x in named[0:1]]))), ("99999999999999999999", block("ds:3", container(22, [[row("com.big")]]))))
    got = relational.first_n(tables.developer(df), 3, ["pos"], ["dev_id"]).collect()
    assert sorted((r.dev_id, r.app_id) for r in got) == [("123", "com.0"), ("123", "com.1"), ("123", "com.2"), ("99999999999999999999", "com.big"), ("Some Dev", "app.n")]


def test_chart_fallback_and_price(spark):
    priced = sparse(_0=["com.p"], _3="P", _8=[None, [[1990000, "EUR"]]])
    sections = [sparse(_21=[[row("com.a"), priced]]), sparse(_21=[[]]), sparse(_21=[[row("com.z")]])]
    df = raw(spark, "category string, body string", ("GAME", block("ds:4", [[None, sections]])))
    rows = tables.charts(df)
    pick = lambda c, n=60: [r.app_id for r in relational.chart(rows, c, n, ["category"]).orderBy("section_no", "pos").collect()]
    assert pick("TOP_FREE") == ["com.a", "com.p"] and pick("GROSSING") == ["com.z"] and pick("TOP_PAID") == ["com.a", "com.p", "com.z"] and pick("TOP_PAID", 2) == ["com.a", "com.p"] and pick("unknown") == ["com.a", "com.p"]
    p = rows.where("app_id = 'com.p'").first()
    assert (p.price, p.currency, p.free) == (1.99, "EUR", False)


def test_similar_blocks(spark):
    def details(key, title, url):
        return block(key, [None, [None, [sparse(_21=[None, [title, None, [None, None, None, None, [None, None, url]] if False else sparse(_4=[None, None, url])]])]]])

    df = raw(spark, "app_id string, lang string, country string, body string", ("a", "en", "us", details("ds:6", "Similar apps", "/c6") + details("ds:8", "Similar apps", "/c8")), ("b", "en", "us", details("ds:7", "More", "/x")), ("c", "en", "us", details("ds:7", "Similar", None)))
    assert {r.app_id: r.cluster_url for r in tables.similar_cluster(df).collect()} == {"a": "/c8", "b": None, "c": None}
    assert sorted(r.app_id for r in relational.similar_errors(df).collect()) == ["b", "c"]
    pages = raw(spark, "url string, body string", (f"{schemas.BASE_URL}/c8&gl=us&hl=en", block("ds:3", container(21, [row("com.s")]))))
    assert [(r.source_app_id, r.app_id, r.score_text) for r in relational.similar(df, pages).collect()] == [("a", "com.s", "")]


def review(k, score=5, day=0, **more):
    return sparse(_0=f"r{k}", _1=["user", [None, None, None, [None, None, "face"]]], _2=score, _4="text", _5=[1704067200 + 86400 * day], _6=k, _10="1.0", **more)


PAGE = "app_id string, score_query int, page_no int, body string"


def test_reviews_strict_types(spark):
    odd = sparse(_0="r9", _2="5", _6="7")
    df = raw(spark, PAGE, ("a", 0, 0, response([[review(1, _7=[None, "thanks", [1704067200]]), odd, "bad", [None], sparse(_0=5)], [None, "tok"]])))
    got = {r.id: r for r in tables.reviews(df).collect()}
    assert set(got) == {"r1", "r9"} and got["r9"].score == 0 and got["r9"].thumbs_up == 0 and got["r9"].date is None
    assert (got["r1"].user_image, got["r1"].reply_text, got["r1"].date) == ("face", "thanks", datetime(2024, 1, 1))
    assert tables.review_pages(df).first().next_token == "tok"
    assert tables.review_pages(raw(spark, PAGE, ("a", 0, 0, response([[], [None, 5]])))).first().next_token == ""


def pages(spark, *extra):
    good = [("a", 0, p, response([[review(10 * p + k) for k in range(3)], [None, f"t{p}"]])) for p in range(3)]
    return raw(spark, PAGE, *good, *extra)


def test_reviews_all(spark):
    ids = lambda df, n: [r.id for r in relational.reviews_all(df, n).orderBy("page_no", "pos").collect()]
    assert ids(pages(spark), 5) == ["r0", "r1", "r2", "r10", "r11"]
    assert len(ids(pages(spark, ("a", 0, 3, response([[], None])), ("a", 0, 4, response([[review(99)], None]))), 50)) == 9
    broken = pages(spark, ("a", 0, 3, "nonsense"), ("a", 0, 4, response([[review(99)], None])))
    assert len(ids(broken, 50)) == 9
    errors = lambda df, n: [tuple(r) for r in relational.reviews_all_errors(df, n).collect()]
    assert errors(broken, 50) == [("a", 3, "malformed response", 9)]
    assert errors(broken, 9) == errors(broken, 0) == errors(pages(spark), 50) == []  # the total is there before the broken page
    unread = raw(spark, PAGE, ("a", 0, 0, response([[review(1)], [None, "t"]])), ("a", 0, 1, response([[review(2), review(3)], None])), ("a", 0, 2, "nonsense"), ("b", 0, 0, "nonsense"), ("b", 0, 1, ""))
    assert errors(unread, 500) == [("b", 0, "malformed response", 0)]
    for df, n in ((broken, 50), (broken, 9), (unread, 500), (unread, 1), (pages(spark), 0)):
        outcome = relational.reviews_outcome(df, n)
        kept, failed = relational.parted(outcome)
        assert kept.columns == relational.reviews_all(df, n).columns
        assert sorted(map(str, kept.collect())) == sorted(map(str, relational.reviews_all(df, n).collect()))
        assert [tuple(r) for r in failed.collect()] == [x[:3] for x in errors(df, n)]
        plan = outcome._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1  # one scan
    with pytest.raises(ValueError):
        relational.reviews_all(pages(spark), -1)


def test_a_failed_request_is_the_error_of_its_page(spark):
    df = raw(spark, PAGE + ", status int, error string", ("a", 0, 0, response([[review(1)], [None, "t"]]), 200, None), ("a", 0, 1, "", 503, "unexpected status 503"))
    assert [tuple(r) for r in relational.reviews_all_errors(df, 9).collect()] == [("a", 1, "request failed: unexpected status 503", 1)]
    assert relational.reviews_all(df, 9).count() == 1


def test_only_wanted_fields_are_read(spark):
    df = pages(spark)
    whole = {r.id: r for r in tables.reviews(df).collect()}
    for fields in (["score"], ["date", "url"], ["text", "thumbs_up", "criterias"], [], tables.layouts.REVIEW):
        some = tables.reviews(df, fields)
        assert some.columns == ["app_id", "score_query", "page_no", "pos", *[x for x in tables.layouts.REVIEW if x == "id" or x in fields]]
        assert len(got := some.collect()) == 9 and all(r[x] == whole[r.id][x] for r in got for x in some.columns)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "reviewId" in plan(tables.reviews(df)) and "reviewId" not in plan(tables.reviews(df, ["score"]))


def test_reviews_comprehensive(spark):
    df = raw(spark, PAGE, ("a", 1, 0, response([[review(1), review(2)], None])), ("a", 2, 0, response([[review(2), review(3), review(4)], None])), ("a", 3, 0, response([[review(5)], [None, "t"]])), ("a", 3, 1, "nonsense"), ("", 1, 0, response([[review(7)], None])))
    got = relational.reviews_comprehensive(df, 2).orderBy("score_query", "pos").collect()
    assert [(r.score_query, r.id) for r in got] == [(1, "r1"), (1, "r2"), (2, "r3")]


def test_permissions(spark):
    data = [[["Group", 1, [[None, "p1"], ["short"], [None, ""]]], ["", 1, [[None, "p2"]]], ["few"]], [[None, 1, [[None, "p3"]]]]]
    df = raw(spark, "app_id string, body string", ("a", response(data)), ("b", response(None)))
    assert [(r.type, r.permission) for r in tables.permissions(df).orderBy("kind_no", "group_no", "pos").collect()] == [("Group", "p1"), ("Common", "p2"), ("Other", "p3")]


def test_suggestions_keep_the_empty_text(spark):
    df = raw(spark, "term string, body string", ("t", response([[[["one"], ["two"], [""], [5], "bad"]]])))
    assert [r.suggestion for r in tables.suggestions(df).orderBy("pos").collect()] == ["one", "two", ""]


def test_data_safety_without_block(spark):
    assert tables.data_safety(raw(spark, "app_id string, body string", ("a", "<html></html>"))).count() == 0
    (r,) = tables.data_safety(raw(spark, "app_id string, body string", ("a", block("ds:3", [])))).collect()
    assert (r.shared_data, r.collected_data, r.security_practices, r.privacy_policy_url) == ([], [], [], "")


def test_enrich_replaces_whole_rows(spark):
    results = tables.search_first(raw(spark, "term string, page_no int, body string", ("t", 0, block("ds:4", container(22, [row("com.a"), row("com.b"), row("com.a")])))))
    app = block("ds:5", [None, [None, None, sparse(_0=["New"])]])
    apps = tables.apps(raw(spark, "app_id string, lang string, country string, body string", ("com.a", "en", "us", app), ("com.a", "en", "us", app)))
    got = [(r.app_id, r.title, r.score, r.url.endswith("&hl=en&gl=us")) for r in relational.enrich(results, apps).orderBy("pos").collect()]
    assert got == [("com.a", "New", 0.0, True), ("com.b", "T", 4.5, False), ("com.a", "New", 0.0, True)]


def test_requests(spark):
    df = spark.createDataFrame([("com.x", "tok", 3)], "id string, token string, score int")
    body = df.select(requests.reviews(F.col("id"), F.lit(2), F.lit(500), F.col("score"), F.lit("")).alias("a"), requests.reviews(F.col("id"), F.lit(1), F.lit(10), F.lit(9), F.col("token")).alias("b"), requests.search_more(F.col("token")).alias("c"), requests.permissions(F.col("id")).alias("d"), requests.suggest(F.lit("a b")).alias("e"), requests.parameters("base", "/p", F.create_map(F.lit("id"), F.col("id"))).alias("f"), requests.parameters("base", "/p", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("g"), requests.chart(F.lit("GAME"), F.lit("AGE_RANGE1"), F.lit("en"), F.lit("us")).alias("h")).first()
    from urllib.parse import unquote_plus

    plain = lambda s: json.loads(unquote_plus(s.removeprefix("f.req=")))
    assert json.loads(plain(body.a)[0][0][1]) == [None, [2, 2, [150], None, [None, 3]], ["com.x", 7]]
    assert json.loads(plain(body.b)[0][0][1]) == [None, [2, 1, [10, None, "tok"], None, [None, None]], ["com.x", 7]]
    assert plain(body.c)[0][0][1].endswith(',34,77]],[null,"tok"]]')
    assert json.loads(plain(body.d)[0][0][1]) == [[None, ["com.x", 7], []]]
    assert json.loads(plain(body.e)[0][0][1])[0][1] == ["a b"]
    assert (body.f, body.g) == ("base/p?id=com.x", "base/p") and body.h.endswith("/store/apps/top?hl=en&gl=us&age=AGE_RANGE1")


def test_tables_of_requests(spark):
    """Defaults, checks and addresses of whole tables are those of the options classes; columns may be missing."""
    kinds = ["app", "search", "developer", "list", "reviews", "suggest", "permissions", "data_safety", "similar", "nonsense", None]
    bare = {r.kind: r for r in requests.prepared(spark.createDataFrame([(k,) for k in kinds], "kind string")).collect()}
    assert {k: r.error for k, r in bare.items()} == {"app": "app id is required", "search": "search term is required", "developer": "developer id is required", "list": None, "reviews": "app id is required", "suggest": "term is required", "permissions": "app id is required", "data_safety": "app id is required", "similar": "app id is required", "nonsense": "unknown kind", None: "unknown kind"}
    assert all((r.url is None) == (r.error is not None) for r in bare.values()) and bare["list"].url.endswith("/store/apps/top?hl=en&gl=us")
    assert (bare["search"].num, bare["developer"].num, bare["list"].num, bare["reviews"].num, bare["app"].num) == (schemas.SearchOptions(term="x").num, schemas.DeveloperOptions(dev_id="x").num, schemas.ListOptions().num, 150, None)
    rows = [("search", "a b", 251), ("search", "a b", 250), ("search", "a b", -1), ("suggest", "a b", 0), ("search", "", -1)]
    got = [(r.error, r.url, r.body, r.extra) for r in requests.prepared(spark.createDataFrame([(*r, 7) for r in rows], "kind string, term string, num int, extra int")).collect()]
    assert [x[0] for x in got] == ["at most 250 results", None, "a number of results can't be negative", None, "search term is required"]
    assert got[1][1].endswith("/store/search?q=a+b&hl=en&gl=us&price=0&c=apps") and got[3][2].startswith("f.req=") and all(x[3] == 7 for x in got)


def test_options():
    for bad in (lambda: schemas.AppOptions(), lambda: schemas.SearchOptions(), lambda: schemas.SearchOptions(term="x", num=300), lambda: schemas.DeveloperOptions(), lambda: schemas.SimilarOptions(), lambda: schemas.SuggestOptions(), lambda: schemas.ListOptions(num=-1)):
        with pytest.raises(ValueError):
            bad()
    o = schemas.ReviewOptions(app_id="a")
    assert (o.lang, o.country, o.sort, o.page_size(), o.total(), o.per_rating()) == ("en", "us", 2, 150, 500, 200)
    assert (schemas.SearchOptions(term="x").num, schemas.DeveloperOptions(dev_id="x").num, schemas.ListOptions().num) == (20, 60, 60)
    assert len(schemas.CATEGORIES) == len(set(schemas.CATEGORIES)) == 54
    assert [relational.price_code(p) for p in ("free", "FREE", "paid", "PAID", "all", "")] == [1, 1, 2, 2, 0, 0]


def test_json_sink(spark, tmp_path):
    df = raw(spark, PAGE, ("a", 0, 0, response([[review(1), sparse(_0="r2")], None])))
    docs = sinks.review_json(tables.reviews(df))
    got = {d["id"]: d for d in (json.loads(r.json) for r in docs.collect())}
    assert got["r1"]["date"] == "2024-01-01T00:00:00Z" and got["r2"]["date"] == sinks.ZERO_TIME and "replyText" not in got["r1"] and got["r1"]["version"] == "1.0" and "version" not in got["r2"]
    sinks.write_json_lines(docs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_json_array_sink(spark, tmp_path):
    """One indented array in a dated file, in the rows' order; nothing is left of an aborted job."""
    rows = [review(1, _7=[None, "thanks <b> & co", [1704067200]]), sparse(_0="r2", _4="1 < 2 \u2028 \"é\" \\"), *[review(k, day=k) for k in range(3, 40)]]
    df = raw(spark, PAGE, *[("a", 0, p, response([rows[10 * p : 10 * p + 10], [None, "t"]])) for p in range(4)])
    docs = sinks.review_json(tables.reviews(df)).orderBy("page_no", "pos")
    out = tmp_path / "out"
    sinks.write_json_array(docs.repartitionByRange(5, "page_no", "pos").sortWithinPartitions("page_no", "pos"), str(out), "reviews", "2024-05-06")
    assert [f.name for f in out.iterdir()] == ["reviews_2024-05-06.json"]
    text = (out / "reviews_2024-05-06.json").read_bytes().decode()
    assert [d["id"] for d in json.loads(text)] == [f"r{k}" for k in range(1, 40)]
    assert text.startswith("""[
  {
    "id": "r1",
    "userName": "user",
    "userImage": "face",
    "date": "2024-01-01T00:00:00Z",
    "score": 5,
    "text": "text",
    "replyDate": "2024-01-01T00:00:00Z",
    "replyText": "thanks \\u003cb\\u003e \\u0026 co",
    "version": "1.0",
    "thumbsUp": 1,
    "url": "https://play.google.com/store/apps/details?id=a\\u0026reviewId=r1"
  },
  {
    "id": "r2",
    "userName": "",
    "userImage": "",
    "date": "0001-01-01T00:00:00Z",
    "score": 0,
    "text": "1 \\u003c 2 \\u2028 \\"é\\" \\\\",
    "replyDate": "0001-01-01T00:00:00Z",
    "thumbsUp": 0,
    "url": "https://play.google.com/store/apps/details?id=a\\u0026reviewId=r2"
  },
""") and text.endswith("\n  }\n]")
    with pytest.raises(Exception, match="is there already"):
        sinks.write_json_array(docs, str(out), "reviews", "2024-05-06")
    failing = docs.withColumn("json", F.when(F.col("pos") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("json")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_json_array(failing, str(tmp_path / "none"), "reviews", "2024-05-06")
    assert not (tmp_path / "none").exists() or not list((tmp_path / "none").iterdir())
    with pytest.raises(Exception, match="lost"):
        sinks.write_json_array(failing, str(out), "reviews", "2024-05-06", "overwrite")
    assert (out / "reviews_2024-05-06.json").read_bytes().decode() == text  # a failed job replaces nothing
    sinks.write_json_array(docs.limit(0), str(out), "reviews", "2024-05-06", "overwrite")
    assert (out / "reviews_2024-05-06.json").read_text() == "null"
    sinks.write_json_array(docs.limit(1), "file://" + str(out), "today")
    (today,) = out.glob("today_*.json")
    assert len(json.loads(today.read_text())) == 1 and oct(today.stat().st_mode)[-3:] == "644"
