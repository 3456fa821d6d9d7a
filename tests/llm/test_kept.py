"""Documents that the pipeline's filters must keep."""

import random

import corpus_pipeline
from storelens.llm import language_id

from .conftest import words


def test_short_documents_stay_with_many_languages(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(words(rng, "en", 3)), f"l{k % 8}") for k in range(400)]  # eight labels for the same words
    df = spark.createDataFrame([*rows, (1000, "12 !", "l1")], "doc_id long, text string, lang string")
    assert {r.doc_id for r in language_id.reject_unknown(df).collect()} == {k for k, _, _ in rows}


def test_rows_without_an_id_or_with_a_repeated_one_stay(spark):
    rng = random.Random(4)
    a, b, c, d = (" ".join(words(rng, "en", 30)) for _ in range(4))
    rows = [(None, a, "x"), (None, a, "y"), (3, a, ""), (5, a, ""), (5, b, ""), (5, b.upper(), ""), (5, None, ""), (5, " ", ""), (6, b, ""), (7, c, ""), (7, d, ""), (4, d, ""), (8, "", "")]
    schema = "doc_id long, text string, source string"
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, schema), "")
    seen = sorted((r.doc_id or 0, (r.text or "").strip().lower(), r.source) for r in got.collect())
    assert got.columns == ["doc_id", "text", "source"]
    assert seen == sorted([(0, a, "x"), (0, a, "y"), (3, a, ""), (5, b, ""), (5, "", ""), (7, c, ""), (4, d, ""), (8, "", "")])
    once = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(None, a, ""), (1, a, ""), (2, a, ""), (3, b, "")], schema), "")
    assert sorted((r.doc_id or 0) for r in once.collect()) == [0, 1, 3]


def test_clashing_names_and_repeated_ids_through_the_stages_that_compare(spark):
    """Columns may have any name; of the rows of one id only what repeats leaves, in stage 2 and in stage 3."""
    rng = random.Random(6)
    some = lambda n: " ".join(f"{rng.random():.9f}" for _ in range(n))
    a, b, c = some(150), some(60), some(60)
    rows = [(1, a), (2, some(50) + " " + a[:900] + " " + some(90)), (2, b), (2, "tiny text here"), (2, None), (3, c), (3, c), (3, b.upper()), (None, b), (4, "")]
    names = ["_node", "_again", "found", "doc", "row", "label", "key", "salt"]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"{x} string" for x in names)
    df = spark.createDataFrame([(i, t, len(t or ""), *[f"{x}{k}" for x in names]) for k, (i, t) in enumerate(rows)], schema)
    two = corpus_pipeline.near_duplicates(spark, df, "")
    assert two.columns == df.columns
    seen = {r.row: r for r in two.collect()}
    assert all(r[x] == f"{x}{k[3:]}" for k, r in seen.items() for x in names)
    assert {k for k in seen if k not in ("row5", "row6")} == {"row0", "row1", "row2", "row3", "row4", "row8", "row9"} and len(seen) == 8
    three = {r.row: r for r in corpus_pipeline.substring_dedup(spark, two, "").collect()}
    assert set(three) == set(seen)
    for k, r in three.items():
        if k != "row1":
            assert r.text == rows[int(k[3:])][1]
    shared = a[:900].split()
    assert three["row1"].text.split() == [w for w in rows[1][1].split() if w not in shared]
