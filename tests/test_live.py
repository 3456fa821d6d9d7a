"""The live source against a local server; the raw store; the stream."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs

import pytest

from storelens.operators import relational, tables
from storelens.sources import live, store
from storelens.streaming import reviews as stream


class Server(BaseHTTPRequestHandler):
    seen, broken = [], []

    def log_message(self, *args):
        pass

    def answer(self, status, body):
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body.encode())

    def do_GET(self):
        self.seen.append(("GET", self.path, self.headers["User-Agent"], time.monotonic()))
        self.answer(404 if "missing" in self.path else 200, f"body of {self.path}")

    def do_POST(self):
        if Server.broken:
            Server.broken.pop()
            return self.answer(503, "")
        form = parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["f.req"][0]
        _, (_, sort, page, _, (_, score)), (app, _) = json.loads(json.loads(form)[0][0][1])
        n = int(page[2]) if len(page) > 1 else 0
        self.seen.append(("POST", score, n, time.monotonic(), app, self.path))
        rows = [[f"{app}-{score}-{n}-{k}", ["u"], score, None, "x", [1704067200]] for k in range(2)]
        inner = json.dumps([rows, [None, str(n + 1)] if n < 2 else None])
        self.answer(200, ")]}'\n" + json.dumps([["wrb.fr", "x", inner]]))


@pytest.fixture(scope="module")
def address():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.fixture(scope="module")
def source(spark):
    live.register(spark)
    return lambda **options: spark.read.format("storelens_live").options(**options).load()


def test_pages_and_errors(source, address):
    got = {r.request: r for r in source(urls=json.dumps([f"{address}/a", f"{address}/missing"]), userAgent="tester").collect()}
    assert got[f"{address}/a"].body == "body of /a" and got[f"{address}/missing"].status == 404 and got[f"{address}/missing"].error
    assert ("GET", "/a", "tester") in [x[:3] for x in Server.seen]


def test_review_pages_filter_and_throttle(source, address):
    raw = source(kind="reviews", appId="app", scores="1,2,3,4,5", count="500", url=address, throttleMs="50")
    Server.seen.clear()
    rows = relational.reviews_comprehensive(raw.where("score_query = 4"), 5).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {4}
    assert {x[1] for x in Server.seen if x[0] == "POST"} == {4}
    Server.seen.clear()
    assert raw.where("score_query = 3").count() == 3
    times = [x[3] for x in Server.seen]
    assert len(times) == 3 and all(b - a >= 0.04 for a, b in zip(times, times[1:], strict=False))


def test_review_total(source, address):
    pages = source(kind="reviews", appId="app", count="3", url=address)
    assert pages.count() == 2
    assert relational.reviews_all(pages, 3).count() == 3


def test_app_id_is_required(source):
    with pytest.raises(Exception, match="app id is required"):
        source(kind="reviews").collect()


def test_raw_store_prunes(spark, tmp_path):
    df = spark.createDataFrame([("app", "en", "us", "a", "x"), ("reviews", "en", "us", "b", "y"), ("app", "de", "de", "c", "z")], "kind string, lang string, country string, app_id string, body string")
    store.write_raw(df, str(tmp_path / "raw"))
    assert [r.app_id for r in store.read_raw(spark, str(tmp_path / "raw"), "app", lang="en").collect()] == ["a"]


def test_stream_counts_each_review_once(spark, tmp_path):
    def page(*ids):
        return ")]}'\n" + json.dumps([["w", "x", json.dumps([[[i, ["u"], 5, None, "t", [1704067200]] for i in ids], None])]])

    for k, ids in enumerate((("r1", "r2"), ("r2", "r3"))):
        spark.createDataFrame([("a", 0, "2024-01-01 00:00:00", page(*ids))], "app_id string, page_no int, t string, body string").selectExpr("app_id", "page_no", "cast(t as timestamp) as fetched_at", "body").write.parquet(str(tmp_path / "in"), mode="append")
    rows = stream.new_reviews(stream.read_raw_stream(spark, str(tmp_path / "in"), 1))
    q = rows.writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in spark.table("seen").collect()) == ["r1", "r2", "r3"]
    assert tables.request_columns(stream.read_raw_stream(spark, str(tmp_path / "in"))) == ["app_id", "page_no", "fetched_at"]


def test_filters_prune_requests(source, address, spark):
    """What app_id, lang, country and score_query rule out, by = or IN, is not asked for; other filters stay with Spark."""
    raw = source(kind="reviews", appIds=json.dumps(["a", "b", "c"]), locales=json.dumps([["en", "us"], ["de", "at"], ["de", "de"]]), scores="1,2,3", count="2", base=address)
    Server.seen.clear()
    rows = raw.where("app_id in ('a', 'c', 'z') and lang = 'de' and country in ('at', 'us') and score_query = 2 and status < 300 and page_no >= 0").collect()
    asked = [(x[4], x[1], x[5].partition("?")[2]) for x in Server.seen]
    assert sorted(asked) == [("a", 2, "hl=de&gl=at"), ("c", 2, "hl=de&gl=at")]
    assert sorted((r.app_id, r.lang, r.country, r.score_query) for r in rows) == [("a", "de", "at", 2), ("c", "de", "at", 2)]
    plan = raw.where("app_id in ('a', 'c') and status < 300")._jdf.queryExecution().executedPlan().toString()
    assert "status" in plan.split("Filter", 1)[1].split("\n")[0] and "app_id" not in plan.split("Filter", 1)[1].split("\n")[0]
    Server.seen.clear()
    assert raw.where("app_id = 'a' and app_id in ('b')").count() == 0 and raw.where("score_query in (7, null)").count() == 0 and not Server.seen
    pages = source(kind="app", appIds=json.dumps(["a", "missing"]), locales=json.dumps([["en", "us"], ["fr", "fr"]]), base=address)
    got = pages.where("lang = 'fr'").collect()
    assert sorted((r.app_id, r.status, r.body) for r in got) == [("a", 200, "body of /store/apps/details?id=a&hl=fr&gl=fr"), ("missing", 404, "")]
    assert [x[1] for x in Server.seen if x[0] == "GET" and "hl=en" in x[1]] == []
    single = source(urls=json.dumps([f"{address}/a", f"{address}/b"])).where("app_id is null or app_id = 'x'")
    assert single.count() == 2  # such requests have no app id: Spark filters


def test_lanes_keep_one_rate(source, address):
    """Three partitions together ask no faster than one would; each has its turns."""
    Server.seen.clear()
    raw = source(urls=json.dumps([f"{address}/lane{k}" for k in range(9)]), throttleMs="150", lanes="3")
    assert raw.rdd.getNumPartitions() == 3 and raw.count() == 9
    times = sorted(x[3] for x in Server.seen)
    assert len(times) == 9 and all(b - a >= 0.1 for a, b in zip(times, times[1:], strict=False))
    assert times[-1] - times[0] < 9 * 0.15 + 1.5  # they do not wait for each other to end


def test_turns_of_lanes_never_meet(monkeypatch):
    """However long calls take and whenever lanes begin, their times are a multiple of the wait apart."""
    clock = [1000.0]
    monkeypatch.setattr(live.time, "time", lambda: clock[0])
    monkeypatch.setattr(live.time, "sleep", lambda s: clock.__setitem__(0, clock[0] + s))
    times = []
    for lane, begin in ((0, 1000.0), (1, 1003.3), (2, 1000.9)):
        clock[0] = begin
        throttle = live.Throttle(0.5, 1000.0, lane, 3)
        for took in (0.01, 2.2, 0.0, 0.7, 1.5):
            times.append(throttle())
            assert round((times[-1] - 1000.0) / 0.5) % 3 == lane
            clock[0] += took
    times.sort()
    assert len(times) == 15 and all(b - a >= 0.499 for a, b in zip(times, times[1:], strict=False))


def test_token_stream_goes_on_where_it_stopped(spark, address, tmp_path):
    """A query that failed in mid-read, and one that was stopped, go on behind their last page: no review is lost or repeated."""

    def run():
        pages = stream.read_token_stream(spark, appIds=json.dumps(["s", "t"]), url=address, count="500")
        return tables.reviews(pages).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()

    ids = lambda: sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    everything = sorted(f"{a}-None-{n}-{k}" for a in "st" for n in range(3) for k in range(2))
    Server.seen.clear()
    first = run()
    while len(Server.seen) < 2:
        time.sleep(0.05)
    Server.broken.append(True)  # one of the next requests fails
    with pytest.raises(Exception, match="request failed|unexpected status 503"):
        first.processAllAvailable()
        first.awaitTermination(30)
    Server.broken.clear()
    assert len(ids()) < len(everything)
    again = run()
    again.processAllAvailable()
    again.stop()
    assert ids() == everything
    more = run()  # it is over: nothing is asked again
    asked = len(Server.seen)
    more.processAllAvailable()
    more.stop()
    assert ids() == everything and len(Server.seen) == asked


def review_page(*ids):
    return ")]}'\n" + json.dumps([["w", "x", json.dumps([[[i, ["u"], 5, None, "t", [1704067200]] for i in ids], None])]])


def arrive(spark, path, day, *ids):
    row = [("a", 0, f"2024-01-{day:02d} 00:00:00", review_page(*ids))]
    spark.createDataFrame(row, "app_id string, page_no int, t string, body string").selectExpr("app_id", "page_no", "cast(t as timestamp) as fetched_at", "body").write.parquet(path, mode="append")


def test_an_id_counts_once_for_all_time(spark, tmp_path):
    """Seen again after 8 days, and after a restart, it is known; in keyed state and in a stored table."""
    source = str(tmp_path / "in")
    arrive(spark, source, 1, "r1", "r2", "r1")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)

    def state():
        return stream.ever_new_reviews(stream.read_raw_stream(spark, source, 1)).writeStream.format("parquet").option("path", str(tmp_path / "state")).option("checkpointLocation", str(tmp_path / "cp1")).start()

    def table():
        return stream.read_raw_stream(spark, source, 1).writeStream.foreachBatch(stream.merged(str(tmp_path / "table"))).option("checkpointLocation", str(tmp_path / "cp2")).start()

    try:
        for day, ids in ((1, None), (9, ("r2", "r3")), (20, ("r1", "r3", "r4"))):
            if ids:
                arrive(spark, source, day, *ids)
            for query in (state(), table()):
                query.processAllAvailable()
                query.stop()
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    for path in ("state", "table"):
        rows = spark.read.parquet(str(tmp_path / path)).collect()
        assert sorted((r.id, r.fetched_at.day) for r in rows) == [("r1", 1), ("r2", 1), ("r3", 9), ("r4", 20)]
    stored = str(tmp_path / "table")
    last = spark.read.parquet(stored).agg({"batch": "max"}).first()[0]
    stream.merged(stored)(spark.read.schema(stream.RAW).parquet(source).where("fetched_at > '2024-01-15'"), last)  # the last batch again
    assert sorted(r.id for r in spark.read.parquet(stored).collect()) == ["r1", "r2", "r3", "r4"]
