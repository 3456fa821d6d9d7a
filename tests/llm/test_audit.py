"""The filter audit against a loop over documents and orders."""

import random
from collections import Counter
from itertools import permutations

import pytest

from storelens.llm import filter_audit, skew

SCHEMA = "doc_id long, text string, source string, part string, digest string, E string, good int"
LABELS = "doc_id long, quality int, toxic int, part string"


def fails(doc_id, text, least):
    words = [w for w in text.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": doc_id is not None and doc_id > least[text],
    }


def brute(docs, labels):
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, *_ in labels if q == 1}
    toxic = {i for i, _, t, *_ in labels if t == 1}
    out = []
    for part in {s or "" for _, _, s, *_ in docs}:
        rows = [(i, fails(i, t or "", least)) for i, t, s, *_ in docs if (s or "") == part]
        orders, shapley = {}, Counter()
        for order in permutations("ABCDE"):
            left = rows
            for k, x in enumerate(order):
                gone, left = [r for r in left if r[1][x]], [r for r in left if not r[1][x]]
                orders["".join(order), k + 1] = gone, left
                shapley[x] += len(gone)
        for (order, k), (gone, left) in orders.items():
            x = order[k - 1]
            failing = [r for r in rows if r[1][x]]
            out.append((part, order, k, len(left), len(gone), len(failing) - len(gone), sum(sum(r[1].values()) == 1 for r in failing), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone), shapley[x]))
    return sorted(out)


def documents():
    rng, out = random.Random(3), []
    for k in range(120):
        words = [rng.choice(["alpha", "beta", "Gamma", "DELTA", "é", "x" * rng.randint(1, 30), str(k)]) if rng.random() < 0.8 else f"w{rng.random()}" for _ in range(rng.choice([0, 3, 49, 50, 60, 200]))]
        text = rng.choice([" ", "\t", "\r\n", "\x0b", "  "]).join(words) + rng.choice(["", "", "#", " A%", "|"])
        out.append((k, text, rng.choice(["s", "t", None, ""])))
    out += [(200 + k, out[k % 7][1], "s") for k in range(30)] + [(None, out[0][1], "u"), (None, None, None), (300, None, "t"), (301, "", "t"), (5, out[5][1], "s"), (5, "another text of one id", "s"), (302, "word " * 20_000, "long")]
    out += [(400 + k, "copy", "h") for k in range(200)]
    return [(*r, "x", "x", "x", 1) for r in out]


def result(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def labels():
    rng = random.Random(4)
    return [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for k in [*range(0, 420, 2), 4, 4, None]]


def test_audit(spark, labels):
    docs = documents()
    got = filter_audit.audit(spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame(labels, LABELS))
    assert result(got) == brute(docs, labels)


def test_no_documents_or_labels(spark, labels):
    nothing = spark.createDataFrame([], SCHEMA)
    assert filter_audit.audit(nothing, spark.createDataFrame(labels, LABELS)).count() == 0
    docs = documents()[:20]
    assert result(filter_audit.audit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], LABELS))) == brute(docs, [])


def test_hot_keys_are_dealt_out(spark):
    rows = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 7 else id end as key")
    keyed = rows.select("key").distinct().selectExpr("key", "key * 2 as double")
    hot = skew.hot_keys(rows, ["key"])
    assert [r.key for r in hot.collect()] == [7]
    joined = skew.salted_join(rows, keyed, ["key"], hot, ["id"])
    assert sorted((r.id, r.double) for r in joined.collect()) == [(i, 14 if i % 3 == 0 else 2 * i) for i in range(3000)]
