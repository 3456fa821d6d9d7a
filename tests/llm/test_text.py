"""Token counts, pieces, language, licenses, decontamination and training order."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from storelens.llm import base, decontamination, language_id, licenses, sentence_pieces, token_counts, training_order

from .conftest import SCHEMA, words


def test_token_counts(docs, sample, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.vocabulary_path())
    expected = sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()), n, n > 2048) for r in sample for n in [len(library.encode(r[1] or "", add_special_tokens=False).ids)])
    got = token_counts.count_tokens(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in got) == expected
    assert token_counts.count_tokens(nothing).count() == 0


def test_other_files_are_refused():
    import json

    spec = json.load(open(token_counts.vocabulary_path(), encoding="utf-8"))
    token_counts.check(spec)
    for change in ({"normalizer": None}, {"post_processor": {}}, {"model": spec["model"] | {"byte_fallback": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError, match="not a byte-level"):
            token_counts.check(spec | change)


def test_token_counts_of_many_characters():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(token_counts.vocabulary_path()), token_counts.counter(token_counts.vocabulary_path())
    for block in [0x20, *range(0x40, 0xD800, 64), *range(0xE000, 0x110000, 64)]:  # every code point there is
        text = "".join(f"a{chr(c)}b {chr(c)}" for c in range(block, block + 64))
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), hex(block)


def test_pieces_are_the_library_s(docs, sample, nothing):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path())
    got = sentence_pieces.encode_checked(docs).collect()
    texts = sorted(((-1 if r[0] is None else r[0], r[1] or "") for r in sample))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in got) == [(i, library.encode(t)) for i, t in texts]
    assert {r.doc_id for r in got if not r.lossless} == {112}  # the space mark itself decodes to a space
    back = sentence_pieces.decode(sentence_pieces.encode(docs)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in back) == [(i, t.replace("▁", " ")) for i, t in texts]
    assert sentence_pieces.encode(nothing).count() == 0


def test_unigram_viterbi_against_brute_force():
    coder = sentence_pieces.Pieces(sentence_pieces.model_path(), "unigram")
    score = {sentence_pieces_text(coder, k): s for k, s in enumerate(coder.score)}
    for word in ("▁the", "▁counting", "anan", "▁ein", "que"):
        best = {0: 0.0}
        for end in range(1, len(word) + 1):
            best[end] = max(best[a] + score[word[a:end]] for a in range(end) if word[a:end] in score)
        (path,) = coder.viterbi([word])
        assert sum(coder.score[k] for k in path) == pytest.approx(best[len(word)])
        assert "".join(sentence_pieces_text(coder, k) for k in path) == word


def sentence_pieces_text(coder, k):
    return coder.raw[coder.ids[k]].decode().replace(" ", "▁")


def test_language_on_held_out_documents(spark, nothing):
    rng = random.Random(9)
    rows = [(k, " ".join(words(rng, lang, rng.randint(4, 40))), lang, "s", 0, "", "", 0, "") for k in range(300) for lang in [("en", "de", "es")[k % 3]]]
    odd = [(1000, None, "en"), (1001, "", None), (1002, "123 !?", "de"), (1003, "the ing", None)]
    df = spark.createDataFrame(rows + [(*o, "s", 0, "", "", 0, "") for o in odd], SCHEMA)
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    truth = {r[0]: r[2] for r in rows}
    held = [i for i in truth if got[i].held_out]
    assert len(held) > 30 and sum(got[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3 and got[1003].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.reject_unknown(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(truth) | {1003}
    assert language_id.identify(nothing).count() == 0 and language_id.reject_unknown(nothing).count() == 0
    again = {(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(df.unionAll(df).repartition(3)).collect()}
    assert len(again) == len(got)  # repeated rows get one result
    unlabelled = df.withColumn("lang", df["lang"].substr(100, 1)).selectExpr("doc_id", "text", "nullif(lang, '') as lang")
    assert {r.lang_pred for r in language_id.identify(unlabelled).collect()} == {"und"}


def test_letters_decide_and_marks_stay_in_words(spark):
    assert language_id.words("हिन्दी ½ ² ① x2y _é́") == ["हिन्दी", "x", "y", "é́"]
    rows = [(5 * k + j, "the same words " * 3, lang) for k in range(20) for j, lang in enumerate(("b", "a"))]
    odd = [(1000, "½ ² ①", "a"), (1001, "the same", None), (None, "words", None), (1002, "x" * 50_000, None), (1003, "the " * 30_000, None)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")).collect()}
    assert (got[1000].lang_pred, got[1000].score) == ("und", 0.0)
    balanced = [(k, "the same words", lang) for k in range(40) for lang in ("b", "a")]  # both rows of an id are learned from
    tied = language_id.identify(spark.createDataFrame(balanced, "doc_id long, text string, lang string")).collect()
    assert {(r.lang_pred, r.score) for r in tied} == {("a", 0.5)}  # ties go to the first in alphabetical order
    assert all(got[i].lang_pred in ("a", "b") and 0.5 <= got[i].score <= 1 for i in (1001, None, 1002, 1003))


def test_every_language_is_learned(spark):
    """250 languages, of which each has words of its own; slices of them give what all at once give."""
    rng = random.Random(7)
    own = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4)] for k in range(250)}
    rows = [(250 * j + k, " ".join(rng.choices(w, k=12)), lang) for k, (lang, w) in enumerate(own.items()) for j in range(4 + (k < 200))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, counts = model = language_id.train(df)
    assert names == sorted(own) and len(counts) == 250
    got = [sorted(map(tuple, language_id.predict(df, model, each=each).collect())) for each in (37, 1000)]
    assert [x[:2] for x in got[0]] == [x[:2] for x in got[1]] == sorted((i, lang) for i, _, lang in rows)
    assert [x[2] for x in got[0]] == pytest.approx([x[2] for x in got[1]])
    assert {len(language_id.sampled(df, 2, few).where("lang = 'l003'").collect()) for few in (0, 10**6)} <= {0, 1, 2, 3, 4, 5}
    few = language_id.sampled(spark.range(40_000).selectExpr("id as doc_id", "'w' as text", "if(id % 4 = 0, 'a', 'b') as lang"), 1000).groupBy("lang").count().collect()
    assert all(800 < r["count"] < 1200 for r in few) and len(few) == 2


def test_piece_counts_against_brute_force():
    from collections import Counter

    path = sentence_pieces.model_path()
    table, size = language_id.vocabulary(path)
    names = {p.lower() for p in _library(path)}
    usual = sorted(x for x in names if x == "▁" or x.removeprefix("▁").isalpha() or language_id.PIECE.fullmatch(x.removeprefix("▁")))
    assert len(usual) == size
    found = Counter({"the": 3, "a": 1, "counting": 2, "éa": 5, "x" * 3000: 1, "हिन्दी": 4})
    expected = np.zeros(size)
    for k, piece in enumerate(usual):
        for word, n in found.items():
            word = "▁" + word
            expected[k] += n * sum(word.startswith(piece, at) for at in range(len(word)))
    assert (language_id.piece_counts(found, path) == expected).all() and expected.sum() > 3000


def _library(path):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))]


def test_memos_are_bounded_in_letters(monkeypatch):
    """Long words are counted without being remembered, and many of middle length empty a memo."""
    rng = random.Random(2)
    monkeypatch.setattr(base, "MOST_LETTERS", 5000)
    memo = base.WordMemo(len)
    assert [memo[f"{k:08d}"] for k in range(3000)] == [8] * 3000 and memo.letters <= 5008 and memo["x" * 2000] == 2000 and "x" * 2000 not in memo
    monkeypatch.setattr(sentence_pieces, "MOST_LETTERS", 5000)
    coder = sentence_pieces.Pieces(sentence_pieces.model_path())
    texts = ["".join(rng.choice("abc de") for _ in range(3000)) + " " + "".join(rng.choice("abc") for _ in range(4000)) for _ in range(8)]
    for t in texts:
        assert coder.decode(coder.encode([t])[0]) == t
    assert max(map(len, coder.memo)) <= base.LONGEST and sum(map(len, coder.memo)) < 10_000
    monkeypatch.setattr(language_id, "MOST_LETTERS", 5000)
    path = sentence_pieces.model_path()
    scorer = language_id.Scorer(np.log(np.random.default_rng(1).dirichlet(np.ones(language_id.vocabulary(path)[1]), 2)), path)
    apart = [scorer.score([t.split()]) for t in texts]
    assert np.allclose(np.concatenate(apart), language_id.Scorer(np.log(scorer.chance.T), path).score([t.split() for t in texts])) and sum(map(len, scorer.memo)) < 20_000


def test_forward_sums_all_segmentations():
    path = sentence_pieces.model_path()
    table, size = language_id.vocabulary(path)
    rng = np.random.default_rng(0)
    model = np.log(rng.dirichlet(np.ones(size), 2))
    scorer = language_id.Scorer(model, path)
    names = ["▁thing", "▁que", "▁" + "ein" * 20]
    for word, got in zip(names, scorer.forward(names), strict=True):
        chance = [np.ones(2)]
        for end in range(1, len(word) + 1):
            total, lone = np.zeros(2), True
            for a in range(max(0, end - table.longest), end):
                (hit,) = table.matches(np.array([[ord(c) for c in word[a:end]]], np.uint64))[-1][0] if end - a <= table.longest else (-1,)
                if hit >= 0:
                    total += chance[a] * np.exp(model[:, hit])
                    lone = lone and a < end - 1
            if lone:
                total += chance[end - 1] * scorer.stranger
            chance.append(total)
        assert got == pytest.approx(np.log(chance[-1]))


def test_licenses(spark, docs, nothing):
    known = licenses.SENTENCES
    texts = [known["mit-released"] + ".", f"Some words here!\n{known['apache-2']}.\nMore.", f"{known['mit-grant']}.\n{known['mit-notice']}.\nTHE SOFTWARE IS PROVIDED \"AS IS\", without warranty of any kind.", f"{known['mit-grant']}. {known['mit-notice']}. x.", f"{known['cc-by-nc-4']}. {known['cc-by-nc-4']}. {known['gpl-3']}", "a license of no kind", known["gpl-free"], None, "", f"{known['apache-2']}. {known['apache-2-you']}. {known['apache-2-copy']}: there. {known['apache-2']}"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, rule_id string")
    got = sorted(map(tuple, licenses.scan(df).collect()))
    assert got == sorted([(0, "mit-released", "MIT", 1, 1), (1, "apache-2", "Apache-2.0", 1, 2), (2, "mit-text", "MIT", 1, 1), (3, "mit-short-text", "MIT", 1, 1), (4, "cc-by-nc-4", "CC-BY-NC-4.0", 2, 1), (4, "gpl-3", "GPL-3.0", 1, 3), (6, "gpl-free", "GPL", 1, 1), (9, "apache-2", "Apache-2.0", 2, 1)])
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    assert sorted(duckdb.sql(licenses.oracle()).fetchall()) == got
    assert licenses.scan(docs).count() == 0 and licenses.scan(nothing).count() == 0
    for sentences in [*(ids for _, _, ids in licenses.RULES), *([k] for k in licenses.KNOWN if k in licenses.SINGLE)]:
        assert any(w in licenses.KNOWN[s].lower() for s in sentences if s is not ... for w in licenses.SIGNALS)


def distance(item, text):
    """Least edit distance of the item to a substring, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination(spark, docs, nothing):
    rng = random.Random(8)
    items = [(k, " ".join(words(rng, "en", 14))) for k in range(8)] + [(50, None), (51, " "), (52, "tiny item"), (53, "tiny item")]
    rows = []
    for k in range(40):
        text = " ".join(words(rng, "en", 25))
        if k % 2:
            planted = list(items[k % 8][1])
            for _ in range(k % 9):
                at = rng.randrange(len(planted))
                planted[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "q"])
            text = f"{text[:40]} {''.join(planted).upper()}\n\n{text[40:]}"
        rows.append((k, text))
    rows += [(90, None), (91, ""), (92, "before tiny  item after")]
    expected = set()
    for i, t in rows:
        for j, item in items:
            p, text = decontamination.plain(item), decontamination.plain(t)
            if p and text and (d := distance(p, text)) <= decontamination.budget(p):
                expected.add((i, j, d))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, doc_id string")
    got = decontamination.contaminated(df, bench)
    assert {(r.doc_id, r.item_id, r.distance) for r in got.collect()} == expected and len(expected) > 10
    kept = decontamination.drop_contaminated(df, bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _, _ in expected}
    by_chunk = decontamination.contaminated(df, bench, most=100)
    assert len(list(decontamination.chunks(bench, 100))) > 3 and {(r.doc_id, r.item_id, r.distance) for r in by_chunk.collect()} == expected
    assert {r.doc_id for r in decontamination.drop_contaminated(df, bench, most=100).collect()} == {r.doc_id for r in kept.collect()}
    # rows without an id, repeated rows, very long texts, and columns of the same names on both sides
    odd = [(None, items[0][1], 1), (None, "clean words", 2), (7, f"{'filler ' * 40_000}{items[1][1]} end", 3), (8, items[1][1], 4), (8, items[1][1], 4), (9, "clean", 5)]
    odd = spark.createDataFrame(odd, "doc_id long, text string, item_id long")
    assert sorted((r.doc_id or 0, r.item_id) for r in decontamination.contaminated(odd, bench).collect()) == [(0, 0), (7, 1), (8, 1), (8, 1)]
    left = decontamination.drop_contaminated(odd, bench)
    assert left.columns == odd.columns and sorted(r.text for r in left.collect()) == ["clean", "clean words"]
    none = bench.where("false")
    assert decontamination.contaminated(docs, none).count() == 0 and decontamination.contaminated(nothing, bench).count() == 0


def test_training_order(spark, docs, sample, nothing):
    shards = training_order.training_shards(docs, length=16, per_shard=32)
    out = shards.collect()
    slots = [s for r in out for s in range(r.first_slot, r.first_slot + r.n_sequences)]
    assert sorted(slots) == list(range(len(slots))) and all(len(r.payload) == r.n_sequences * r.stride == r.n_sequences * 32 for r in out)
    parts = {}
    for r in out:
        cells = np.frombuffer(r.payload, "<u2").reshape(-1, 16)
        for k, (i, s) in enumerate(zip(r.doc_ids, r.sequence_nos, strict=True)):
            parts[i, s] = cells[k]
    coder = training_order.tokenizer(training_order.ranks_path())
    for i, t, *_ in sample:
        tokens = np.frombuffer(coder.encode(t or ""), "<u2")
        whole = np.concatenate([*[parts[i, s] for s in range(-(-len(tokens) // 16))], np.empty(0, "<u2")])
        assert (whole[: len(tokens)] == tokens).all() and (whole[len(tokens) :] == training_order.END_OF_TEXT).all()
    assert sum(r.n_tokens for r in out) == sum(len(coder.encode(r[1] or "")) // 2 for r in sample)
    some = {r.slot: r.tokens for r in training_order.read_slots(shards, 30, 10, 32).collect()}
    assert sorted(some) == list(range(30, 40))
    assert training_order.training_shards(nothing).count() == 0


def test_plain_shards_are_read_from_the_middle(spark, docs, nothing, tmp_path, monkeypatch):
    """A reader that stopped in mid-shard goes on there: it opens the files of the rest, and reads their bytes only."""
    options = {"length": 16, "per_shard": 32}
    shards = training_order.training_shards(docs, **options)
    index = training_order.write_plain(shards, str(tmp_path / "plain"))
    total = sum(r.n_sequences for r in index.collect())
    assert total > 200 and "payload" not in index.columns
    whole = {r.slot: r.tokens for r in training_order.read_slots(shards, 0, total, 32).collect()}
    for first, n, slots in ((0, total, 7), (45, 100, 4096), (total - 3, 50, 2), (31, 2, 1)):
        got = training_order.read_plain(spark, str(tmp_path / "plain"), first, n, 32, slots).collect()
        assert len({r.slot for r in got}) == len(got) and {r.slot: r.tokens for r in got} == {s: whole[s] for s in range(first, min(total, first + n))}
    for k in range(45 // 32):
        (tmp_path / "plain" / training_order._name(k)).unlink()
    assert len(training_order.read_plain(spark, str(tmp_path / "plain"), 45, total, 32).collect()) == total - 45  # earlier files are not touched
    training_order.write_plain(shards, str(tmp_path / "plain"))  # once more: the same bytes
    assert {f.name: f.read_bytes() for f in (tmp_path / "plain").glob("0*/*")} == {f"{r.shard:012d}.bin": bytes(r.payload) for r in shards.collect()}
    assert training_order.write_plain(training_order.training_shards(nothing), str(tmp_path / "none")).count() == 0
    monkeypatch.setattr(training_order, "FEW_RANGES", 0)
    many = training_order.training_shards(docs, **options, range_bytes=1000)  # starts by a shuffle
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, shards.collect()))


def test_training_order_does_not_depend_on_the_split(spark, docs, tmp_path):
    options = {"length": 16, "per_shard": 32}
    whole = [sorted(map(tuple, training_order.training_shards(docs.unionAll(docs.limit(3)).repartition(n), **options, range_bytes=size).collect())) for n, size in ((2, 1 << 20), (5, 4000))]
    assert whole[0] == whole[1] and len(whole[0]) > 20
    shards = training_order.training_shards(docs, **options, range_bytes=4000)
    training_order.write_shards(shards, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    files = back.selectExpr("input_file_name() f", "shard").groupBy("f").agg({"shard": "min"}).count()
    spans = back.selectExpr("input_file_name() f", "shard").groupBy("f").agg(F.min("shard").alias("a"), F.max("shard").alias("b"), F.count("*").alias("n")).collect()
    assert files > 2 and all(r.b - r.a + 1 == r.n for r in spans)  # a file holds neighbouring shards
    total = sum(r.n_sequences for r in back.select("n_sequences").collect())
    first = {r.slot: r.tokens for r in training_order.read_slots(back, 0, 50, 32).collect()}
    rest = {r.slot: r.tokens for r in training_order.read_slots(back, 50, total - 50, 32).collect()}  # resumed behind slot 49
    at_once = {r.slot: r.tokens for r in training_order.read_slots(shards, 0, total, 32).collect()}
    assert first | rest == at_once and len(at_once) == total
    assert sorted(map(tuple, training_order.written_shards(docs, **options).collect())) == sorted(map(tuple, shards.collect()))


@pytest.mark.parametrize("count", [1, 2, 3, 10, 1000, 4097])
def test_feistel_is_a_permutation(count):
    a, b = (training_order.feistel(np.arange(count), count, key) for key in (1, 2))
    assert sorted(a) == list(range(count)) and (count < 10 or (a != b).any())


def test_tokens_are_the_library_s():
    import base64

    import public_tokenizers
    import tiktoken

    with open(training_order.ranks_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("Hello  world\n\n x", "it's 123 ñandú 漢字 😀", "<|endoftext|>", " \t a"):
        assert np.frombuffer(training_order.tokenizer(training_order.ranks_path()).encode(text), "<u2").tolist() == library.encode_ordinary(text)
