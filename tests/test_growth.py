"""What keeps queries in proportion to their tables: pages parsed once, pages of bounded length, joins without a broadcast."""

import pytest
from pyspark.sql import functions as F

from storelens.functions.payload import BLANK, block
from storelens.operators import relational, tables
from storelens.plans import catalog
from storelens.schemas import RESULT


def test_a_page_is_parsed_once(spark):
    raw = spark.createDataFrame([], "app_id string, page_no int, body string")
    plan = tables.reviews(raw)._jdf.queryExecution().optimizedPlan().toString()
    # one for the response, one for the document in it; no filter that computes the page's items again
    assert plan.count("parseJson") == 2 and "Filter (" not in plan


def test_blanks_around_a_block_are_trimmed(spark):
    """Without a search at each of its characters."""
    blanks = BLANK.replace("\n", "")  # a line feed ends a block
    assert len(blanks) == 24
    raw = spark.createDataFrame([(f"<script>AF_initDataCallback({{key: 'ds:3', hash: '1', data:{x}[1, \" a \"]{x}, sideChannel: {{}}}});",) for x in ("", *blanks, blanks, blanks * 2)], "body string")
    data = raw.select(F.to_json(block(F.col("body"), "ds:3")).alias("d"))
    assert [r.d for r in data.distinct().collect()] == ['[1," a "]'] and "regexp_replace" not in data._jdf.queryExecution().optimizedPlan().toString()


NAME = "hot bolt"


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """Tables in which all rows share their term, brand and type."""
    folder = tmp_path_factory.mktemp("alike")
    parts = spark.range(5000).select(F.col("id").alias("p_partkey"), F.lit(NAME).alias("p_name"), F.lit("B").alias("p_brand"), F.lit("T").alias("p_type"), F.lit(7).alias("p_size"), F.lit(9.5).alias("p_retailprice"))
    parts.write.parquet(f"{folder}/part.parquet")
    spark.range(1300).select(F.format_string("Customer#%09d", F.floor(F.col("id") / 2)).alias("c_name")).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_pages_of_a_term_are_bounded(spark, alike):
    for pages in (catalog._search_first(spark, alike), catalog._search_more(spark, alike)):
        sizes = [len(r.body) for r in pages.collect()]
        assert len(sizes) == 3 and max(sizes) < 400 * catalog.PAGE_KEYS
    assert [tuple(r) for r in catalog.queries()["search_tokens"](spark, alike).collect()] == [("hot", "tok", "tok2")]


def test_pages_of_suggestions_are_bounded(spark, alike):
    sizes = [r.body.count("Customer") for r in catalog._names(spark, alike).collect()]
    assert max(sizes) <= catalog.NAMES and sum(sizes) == 1300
    got = sorted((r.pos, r.suggestion) for r in catalog.queries()["suggest"](spark, alike).collect())
    assert got == [(k + 1, f"Customer#{k // 2:09d}") for k in range(1300)]


def test_details_are_not_broadcast(spark):
    row = ", ".join(f"{c} {'double' if c in ('score', 'price') else 'boolean' if c == 'free' else 'string'}" for c in RESULT)
    results, apps = spark.createDataFrame([], row), spark.createDataFrame([], f"{row}, updated long")
    assert "Broadcast" not in relational.enrich(results, apps)._jdf.queryExecution().sparkPlan().toString()


def test_all_apps_of_a_brand_are_similar(spark, tmp_path):
    parts = spark.range(90).select(F.col("id").alias("p_partkey"), F.lit(NAME).alias("p_name"), F.lit("B").alias("p_brand"), F.lit("T").alias("p_type"), F.lit(7).alias("p_size"), F.lit(9.5).alias("p_retailprice"))
    parts.write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.queries()["similar_all"](spark, str(tmp_path))
    assert {(r.source_app_id, r.app_id) for r in got.collect()} == {(f"com.p{a}", f"com.p{b}") for a in range(90) for b in range(90)}


def test_details_pages_are_parsed_once(spark):
    raw = spark.createDataFrame([], "app_id string, lang string, country string, body string")
    hop = tables.similar_cluster(raw).where("cluster_url is not null").selectExpr("app_id", "concat('x', cluster_url) as page_url")
    plan = hop.where("page_url is not null")._jdf.queryExecution().optimizedPlan().toString()
    # one pass over the page, and one document for each of the three blocks where the cluster may be
    assert plan.count("regexp_extract_all") == 1 and plan.count("parseJson") == 3


def test_a_large_cluster_is_the_work_of_several_tasks(spark, alike):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = spark.read.parquet(f"{alike}/part.parquet").where("p_partkey < 400")
        got = catalog._similar(parts.withColumn("id", catalog._app_id(F.col("p_partkey"))), ["p_brand", "p_type"])
        tasks = got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count_distinct("source_app_id", "app_id").alias("pairs")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(t.n for t in tasks) == sum(t.pairs for t in tasks) == 160000 and len(tasks) > 1


def test_the_tasks_of_a_cluster_do_not_depend_on_its_bytes(spark, alike):
    """A few short rows make many pairs; with Spark's usual settings they were one task's, whatever the number of pairs."""
    assert spark.conf.get("spark.sql.adaptive.enabled") == spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"
    parts = spark.read.parquet(f"{alike}/part.parquet").where("p_partkey < 400")
    got = catalog._similar(parts.withColumn("id", catalog._app_id(F.col("p_partkey"))), ["p_brand"])
    tasks = got.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.count_distinct("source_app_id", "app_id").alias("pairs")).collect()
    assert sum(t.n for t in tasks) == sum(t.pairs for t in tasks) == 160000
    assert len(tasks) > 8 and max(t.n for t in tasks) < 160000 / 8


def test_all_pairs_of_a_brand_and_type_are_dealt_evenly(spark, alike):
    got = catalog.queries()["similar"](spark, alike).groupBy(F.spark_partition_id()).count().collect()
    assert sum(t["count"] for t in got) == 5000**2 and max(t["count"] for t in got) < 5000**2 / 8
