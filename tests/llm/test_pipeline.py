"""The pipeline against a brute-force version of its stages."""

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from storelens.llm import decontamination, sentence_pieces
from storelens.llm.base import stash

from .test_dedup import WORD, shingles
from .test_text import distance

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def near_copies(rows):
    """One row of each component of similar sets, the least doc_id first; rows without an id stay."""
    named, kept = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]), []
    sets = [shingles(r[1]) for r in named]
    label = list(range(len(named)))
    changed = True
    while changed:
        changed = False
        for i in range(len(named)):
            for j in range(i):
                alike = sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
                if alike and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    kept = [r for k, r in enumerate(named) if label[k] == k]
    return kept + [r for r in rows if r[0] is None]


def cut_passages(rows, length=50):
    first, out = {}, []
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - length + 1) if i is not None else ():
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, i), i)
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - length + 1) if i is not None else ():
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        if not all(gone) or not gone:
            out.append((i, " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else t))
    return out


def clean(rows, items):
    plain = decontamination.plain
    found = lambda t, item: distance(plain(item), plain(t)) <= decontamination.budget(plain(item))
    return [(i, t) for i, t in rows if not any(found(t, item) for item in items)]


def key(row):
    return row[0] if row[0] is not None else -1, row[1]


def write(spark, folder, documents, items):
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    documents.write.parquet(f"{folder}/documents.parquet")


def test_stages_against_brute_force(spark, docs, sample, tmp_path):
    planted = sample[4][1]
    items = [planted[:80], "no such passage in any of them"]
    write(spark, tmp_path, docs.drop("found", "key", "block", "start"), list(enumerate(items)))
    expected = [[(r[0], r[1]) for r in sample if r[1] and any(c.isalpha() for c in r[1])]]
    for step in (near_copies, cut_passages, lambda rows: clean(rows, items)):
        expected.append(step(expected[-1]))
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:4], expected, strict=True):
        now = stash(stage(spark, now, str(tmp_path)))
        assert now.columns == DOCUMENT and sorted(((r.doc_id, r.text) for r in now.collect()), key=key) == sorted(rows, key=key), name
    assert len(expected[0]) > len(expected[1]) > len(expected[3]) and expected[1] != expected[2]
    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(((i, library.encode(t)) for i, t in expected[3]), key=key)
    assert {r.doc_id for r in got if not r.lossless} <= {112}


def test_empty_tables_and_odd_rows(spark, docs, nothing, tmp_path):
    few = nothing.drop("found", "key", "block", "start")
    write(spark, f"{tmp_path}/none", few, [])
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    rows = [(1, "plain words here", "en", "s", 3, "a"), (1, "plain words here", "en", "s", 3, "b"), (1, "other words", None, "s", 3, "c"), (None, "plain words here", None, None, None, None), (2, None, "en", "s", 0, "d"), (3, "long word " * 30_000, "en", "s", 1, "e")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    write(spark, f"{tmp_path}/odd", odd, [])
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").select("doc_id", F.size("ids").alias("n")).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 1, 3] and max(r.n for r in got) > 30_000
