"""Scalar cases: paths, coercions, envelopes, text and time."""

import json

import pytest
from pyspark.sql import functions as F

from storelens.functions import payload, text, variant


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def json_at(spark, doc, *steps):
    v = variant.path(variant.strict(F.col("d")), *steps)
    return one(spark, F.to_json(v), d=doc)


NESTED = '["zero",["one-zero",["two-zero","two-one"]]]'


@pytest.mark.parametrize("doc, steps, expected", [
    (NESTED, (0,), '"zero"'), (NESTED, (1, 0), '"one-zero"'), (NESTED, (1, 1, 1), '"two-one"'),
    ('["zero",null]', (5,), None), ('["zero",null]', (1, 0), None), ('["zero",null]', (1,), None),
    ('[0,{"138":[["p",{"2":"deep"}]]}]', (1, 138, 0, 1, 2), '"deep"'), ('["text"]', (0, 0), None), ('{"1":{"x":1}}', (2,), None),
])
def test_path(spark, doc, steps, expected):
    assert json_at(spark, doc, *steps) == expected


@pytest.mark.parametrize("doc, ok", [("[1]", True), ("[1] x", False), ("[1],2", False), ("", False), ("{\"a\":1}", True), ("null", True), ("[1,", False), (" [1] ", True)])
def test_strict(spark, doc, ok):
    assert one(spark, variant.strict(F.col("d")).isNotNull(), d=doc) is ok


@pytest.mark.parametrize("doc, expected", [
    ("null", ""), ('"hello"', "hello"), ("123", "123"), ("45.67", "45.67"), ("true", "true"), ("0", "0"), ("1000000", "1e+06"), ("1234567", "1.234567e+06"),
    ("100000", "100000"), ("12345678901", "1.2345678901e+10"), ("-2.5", "-2.5"), ("0.0001", "0.0001"), ("0.00001", "1e-05"), ("1e100", "1e+100"),
])
def test_to_string(spark, doc, expected):
    assert one(spark, variant.to_string(variant.strict(F.col("d"))), d=doc) == expected


@pytest.mark.parametrize("doc, expected", [
    ("null", 0), ("42.0", 42), ("123", 123), ('"456"', 456), ('"456789"', 456789), ("1000000000.0", 1000000000), ('"invalid"', 0), ("true", 0), ('" 4 "', 0), ('"45.6"', 0),
    ("-3.9", -3), ('"99999999999999999999"', (1 << 63) - 1), ("[1]", 0),
])
def test_to_long(spark, doc, expected):
    assert one(spark, variant.to_long(variant.strict(F.col("d"))), d=doc) == expected


@pytest.mark.parametrize("doc, expected", [("null", 0.0), ("3.14", 3.14), ("42", 42.0), ('"3.5"', 3.5), ('"invalid"', 0.0), ("true", 0.0), ('"1e3"', 1000.0)])
def test_to_double(spark, doc, expected):
    assert one(spark, variant.to_double(variant.strict(F.col("d"))), d=doc) == expected


@pytest.mark.parametrize("doc, expected", [
    ("[[5,1000],[4,500],[3,200],[2,100],[1,50]]", [50, 100, 200, 500, 1000]), ("[[5,7]]", [0, 0, 0, 0, 7]), ("[[5],null,[3,2]]", [0, 0, 2, 0, 0]), ('"x"', [0] * 5),
])
def test_histogram(spark, doc, expected):
    out = one(spark, text.histogram(variant.strict(F.col("d"))), d=doc)
    assert (out or [0] * 5) == expected


@pytest.mark.parametrize("html, expected", [
    ("<p>Hello</p>", "Hello"), ("Line1<br>Line2", "Line1\nLine2"), ("a<br/>b<br />c", "a\nb\nc"), ("<b>x</b><i>y</i>", "xy"), ("plain &amp;", "plain &amp;"), ("a<BR>b", "ab"),
])
def test_strip_html(spark, html, expected):
    assert one(spark, text.strip_html(F.col("d")), d=html) == expected


@pytest.mark.parametrize("doc, millis", [("[1704067200]", 1704067200000), ("[1704067200,500]", 1704067200500), ("[1704067200,5000000]", 1704067200500), ("[1704067200,123456789]", 1704067200123), ("[]", None), ('["1"]', None)])
def test_timestamp(spark, doc, millis):
    assert one(spark, F.unix_millis(text.timestamp(variant.strict(F.col("d")))), d=doc) == millis


@pytest.mark.parametrize("doc, expected", [('[["com.example"]]', True), ('[["net.example"]]', True), ('[["io.example"]]', True), ('[["not.package"]]', False), ("[[123]]", False), ("[]", False), ('[["com."]]', False)])
def test_app_id_pattern(spark, doc, expected):
    assert one(spark, text.has_app_id_pattern(variant.strict(F.col("d"))), d=doc) is expected


def test_escape(spark):
    assert one(spark, text.escape(F.col("d")), d="a b~c*d&é") == "a+b~c%2Ad%26%C3%A9"


def page(*blocks):
    return "".join(f"AF_initDataCallback({{key: '{k}', hash: '1', data:{d}, sideChannel: {{}}}});</script>" for k, d in blocks)


@pytest.mark.parametrize("body, expected", [
    (page(("ds:1", "[1]"), ("ds:5", "[2]")), "[2]"), (page(("ds:5", "[1]"), ("ds:5", "[2]")), "[2]"), (page(("ds:5", "[1]"), ("ds:5", "[2] x")), "[1]"),
    (page(("ds:5", '["a b\u0085c\rd"]')).replace("\r", " "), '["a b\u0085c d"]'), ("<html></html>", None), ("", None), (page(("ds:50", "[1]")), None),
])
def test_block(spark, body, expected):
    assert one(spark, F.to_json(payload.block(F.col("d"), "ds:5")), d=body) == expected


LINE = ")]}'\n"


@pytest.mark.parametrize("body, strict, tolerant", [
    ("", "error", "error"), ("nonsense", "error", "error"), (LINE, "error", "error"), (LINE + '[["x","y",null,"z"]]', "error", "empty"), (LINE + "[]", "error", "empty"),
    (LINE + '[["x"]]', "error", "empty"), (LINE + '[["x","y","[null,[],null]"]]', "ok", "ok"), (LINE + '[["x","y","[1"]]', "error", "error"), (LINE + "{}", "error", "error"), (LINE + "[1]", "error", "error"), ('[["x","y","[]"]]', "ok", "ok"),
])
def test_envelope(spark, body, strict, tolerant):
    for expected, flag in ((strict, False), (tolerant, True)):
        assert one(spark, payload.envelope(F.col("d"), flag)["status"], d=body) == expected


def test_depth_first_search_for_apps(spark):
    """The JVM's fold against a stack walk, on random nested documents; no step of a search leaves the JVM."""
    import random

    from storelens.functions.text import first_app_array
    from storelens.operators import tables
    from storelens.sources.live import find_apps

    rng = random.Random(5)

    def tree(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.25:
            return rng.choice([1, None, "x", "com.", "com.a", "net.b.c", ".com", "[[[", True, 2.5])
        if kind < 0.35:
            return {rng.choice("0ab"): tree(depth - 1) for _ in range(rng.randint(0, 2))}
        return [tree(depth - 1) for _ in range(rng.choice([0, 1, 1, 2, 3, 13]))]

    trees = [tree(7) for _ in range(400)] + [[[["com.x.y"]]], [], 5, None, [[[["com.q"], 1]], [["io.z"]]], {"a": [[["com.x"]]]}]
    df = spark.createDataFrame([(k, json.dumps(t)) for k, t in enumerate(trees)] + [(9999, "no json")], "k int, t string").select("k", F.try_parse_json("t").alias("v"))
    got = {r.k: r.found for r in df.select("k", F.to_json(first_app_array(F.col("v"))).alias("found")).collect()}
    expected = {k: find_apps(t) for k, t in enumerate(trees)}
    assert 20 < sum(x is not None for x in expected.values()) < 390
    for k, x in expected.items():
        assert (None if got[k] is None else json.loads(got[k])) == x, trees[k]
    assert got[9999] is None
    plan = tables.search_first(df.selectExpr("'t' as term", "0 as page_no", "cast(v as string) as body"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
