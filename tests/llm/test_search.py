"""Exact search against brute force."""

import numpy as np
import pandas as pd

from storelens.llm import vector_search


def brute(rows, k, every=100):
    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(700, 8)).astype(np.float32)
    vectors[100:140] = vectors[7]  # ties
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    rows += [(1000, None), (1100, [1.0, None] + [0.0] * 6), (1200, [float("nan")] * 8), (1300, [float("inf")] * 8), (None, [1.0] * 8), (1400, [0.5, 0.25]), (1401, [0.5, 0.5]), (1500, []), (1600, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, cells string, length int")
    for options in ({"shard_rows": 64, "query_rows": 3}, {"shard_rows": 64, "most_cells": 3, "sample_rows": 50}, {}):
        got = vector_search.top_k(df, 10, **options)
        assert sorted(map(tuple, got.collect())) == brute(rows, 10)
    assert vector_search.top_k(df.where("false")).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert sorted(map(tuple, vector_search.top_k(few).collect())) == brute([r for r in rows if r[0] in (0, 1, 2)], 10)


def test_repeated_rows_and_large_components(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [0.5, 9.0])] + [(k, [float(k), 1.0]) for k in range(1, 30)]
    rows += [(40, [3e38, 3e38]), (41, [-3e38, 3e38]), (42, [1e15, 1e15]), (100, [1e16, 2e16])]
    got = vector_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=8)
    scaled = [(i, [min(max(int(np.floor(1024 * x)), -(2**63)), 2**63 - 1) for x in v]) for i, v in rows]
    expected = []
    for q in (0, 100):
        a = min(v for i, v in scaled if i == q)
        cut = lambda s: min(max(s, -(2**63) + 1), 2**63 - 1)
        scored = sorted((-cut(sum(x * y for x, y in zip(a, b))), i) for i, b in scaled if i != q)
        expected += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:10], 1)]
    assert sorted(map(tuple, got.collect())) == expected


def test_cells_hold_every_vector():
    rng = np.random.default_rng(4)
    sample = rng.integers(-100, 100, (300, 3)).tolist()
    nodes = vector_search.splits(sample, 7)
    cells = vector_search.cell_of(rng.integers(-200, 200, (1000, 3)).tolist() + [[5], [1, 2, 3, 4]], nodes)
    assert len(nodes) == 6 and set(cells.tolist()) == set(range(7))
    assert vector_search.splits([[1, 1]] * 9, 4) == [] and vector_search.cell_of([[7, 7]], []).tolist() == [0]


def test_a_hot_cell_takes_more_shards(spark, monkeypatch):
    """Very many equal vectors: their cell is dealt over as many shards as its rows need."""
    rng, sizes = np.random.default_rng(5), []
    rows = [(k, [7, 7, 7]) for k in range(5000)] + [(5000 + k, rng.integers(-100, 100, 3).tolist()) for k in range(1000)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")

    def built(sharded, k, own=vector_search.built):
        sizes.extend(r["count"] for r in sharded.where("not ask").groupBy("shard").count().collect())
        return own(sharded, k)

    monkeypatch.setattr(vector_search, "built", built)
    got = vector_search.top_k(df, every=1500, shard_rows=256)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 1500)
    assert sum(sizes) == 6000 and max(sizes) <= 2 * 256


def test_tree_prunes_but_loses_nothing():
    rng = np.random.default_rng(2)
    points = rng.integers(-100, 100, (500, 3))
    tree = vector_search.Tree(np.arange(500), points, leaf=8)
    for q in rng.integers(-100, 100, (20, 3)):
        scores = points @ q
        expected = sorted(((int(s), i) for i, s in enumerate(scores)), key=lambda x: (-x[0], x[1]))[:5]
        assert tree.search(q, -1, 5, vector_search.LEAST) == expected
        assert tree.search(q, -1, 5, expected[4][0]) == expected


def test_sql_agrees(spark):
    import duckdb

    rng = np.random.default_rng(3)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(250, 4)).astype(np.float32))]
    embeddings = pd.DataFrame({"vec_id": [r[0] for r in rows], "embedding": [r[1] for r in rows]})  # noqa: F841
    got = vector_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(vector_search.ORACLE_SQL).fetchall())
