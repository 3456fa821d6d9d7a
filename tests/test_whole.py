"""Edge cases in small, and queries over whole tables, without rows left out to stage them."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from storelens.operators import analytics, relational
from storelens.plans import catalog
from storelens.schemas import RESULT
from storelens.sources import sinks

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="needs the test tables")
def test_every_part_has_similar_apps(spark):
    parts = [tuple(r) for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_brand").collect()]
    expected = sorted((f"com.p{a}", f"com.p{b}") for a, x in parts for b, y in parts if x == y)
    got = catalog.queries()["similar_all"](spark, str(SF))
    assert sorted((r.source_app_id, r.app_id) for r in got.collect()) == expected


@pytest.mark.skipif(not SF.exists(), reason="needs the test tables")
def test_every_review_is_counted(spark):
    got = {r.score: r.n for r in catalog.queries()["score_distribution_all"](spark, str(SF)).collect()}
    assert sum(got.values()) == spark.read.parquet(f"{SF}/events.parquet").count() and all(got.values())


def test_empty_scores(spark):
    reviews = spark.createDataFrame([(5,), (5,), (4,), (0,), (None,)], "score int")
    assert sorted(map(tuple, analytics.score_distribution(reviews).collect())) == [(1, 0, 0.0), (2, 0, 0.0), (3, 0, 0.0), (4, 1, 33.3), (5, 2, 66.7)]
    assert all(r.n == 0 and r.percent == 0.0 for r in analytics.score_distribution(reviews.where("false")).collect())


@pytest.mark.skipif(not SF.exists(), reason="needs the test tables")
def test_missing_details_keep_the_result(spark):
    rows = lambda name: {(r.term, r.app_id): r for r in catalog.queries()[name](spark, str(SF)).collect()}
    some, every = rows("enrich"), rows("enrich_all")
    assert set(some) == set(every)
    assert all(r.url.endswith("&hl=en&gl=us") for r in every.values()) and any(some[k].url != every[k].url for k in every)


def test_report(spark):
    rows = [("a", "r1", 5, "2024-01-02", "Ann", "x" * 250), ("a", "r2", 4, "2024-01-02", "Bob", "short"), ("a", "r0", 5, None, "Cy", ""), ("b", "r9", 1, None, "Di", "text")]
    df = spark.createDataFrame(rows, "app_id string, id string, score int, day string, user_name string, text string").selectExpr("*", "cast(day as timestamp) as date")
    got = {r.app_id: r for r in analytics.report(df).collect()}
    a, b = got["a"], got["b"]
    assert (a.n_reviews, a.avg_score, a.n5, a.percent5, a.n4, a.percent1) == (3, 4.67, 2, 66.7, 1, 0.0)
    assert (a.latest_user, a.latest_text) == ("Ann", "x" * 200 + "...") and (b.latest_user, b.latest_date) == ("Di", None)
    lines = {r.app_id: r.line.split("\n") for r in sinks.report_lines(analytics.report(df)).collect()}
    assert lines["a"][:5] == ["Reviews: 3", "Stats:", "  Average score: 4.67", "  Score distribution:", "    5 star: 2 (66.7%)"]
    assert lines["b"][-4:] == ["  Date: 0001-01-01", "  Score: 1", "  User: Di", "  Text: text"]
    assert analytics.report(df.where("false")).count() == 0


def test_details_of_the_latest_fetch_in_the_own_locale(spark):
    columns = [c for c in RESULT if c not in ("score", "price", "free")]
    row = lambda app, title, lang, updated: (app, lang, updated, *[title if c == "title" else app if c == "app_id" else "" for c in columns[1:]], 0.0, 0.0, True)
    schema = "app_id string, lang string, updated long, " + ", ".join(f"{c} string" for c in columns[1:]) + ", score double, price double, free boolean"
    apps = spark.createDataFrame([row("x", "old", "en", 1), row("x", "new", "en", 2), row("x", "neu", "de", 9), row("y", "b", "en", 1), row("y", "a", "en", 1)], schema).withColumn("country", F.lit("us"))
    results = spark.createDataFrame([row(a, "own", lang, 0) for a, lang in (("x", "en"), ("x", "de"), ("y", "en"), ("y", "fr"))], schema).drop("updated").withColumn("country", F.lit("us"))
    got = {(r.app_id, r.lang): r.title for r in relational.enrich(results, apps).collect()}
    assert got == {("x", "en"): "new", ("x", "de"): "neu", ("y", "en"): "b", ("y", "fr"): "own"}


def test_paged_reviews_take_one_shuffle(spark):
    pages = spark.createDataFrame([], "app_id string, score_query int, page_no int, body string")
    plan = relational.reviews_all(pages, 500)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("LocalTableScan") + plan.count("Scan ExistingRDD") <= 1
