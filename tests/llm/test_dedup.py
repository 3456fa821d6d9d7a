"""The join and the two kinds of passage dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from storelens.llm import components, ngram_join, passages, suffix_array, suffix_automata

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    found = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)} or ({tuple(found)} if found else set())


def test_join(docs, sample, nothing):
    rows = [(r[0], shingles(r[1])) for r in sample if r[0] is not None]
    unnamed = [(None, len(shingles(r[1])), None) for r in sample if r[0] is None]
    label = {i: i for i, _ in rows}

    def find(x):
        return x if label[x] == x else find(label[x])

    for i, a in rows:
        for j, b in rows:
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    expected = sorted((i, len(s), find(i)) for i, s in rows)
    assert sorted(map(tuple, ngram_join.near_duplicates(docs).collect()), key=str) == sorted(expected + unnamed, key=str) and unnamed
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in expected})
    # every n-gram of two sets of a batch goes the way of the common ones
    assert sorted(map(tuple, ngram_join.near_duplicates(docs, hot=2).collect()), key=str) == sorted(expected + unnamed, key=str)
    assert ngram_join.near_duplicates(nothing).count() == 0


def test_join_gives_every_link(docs, sample):
    sets = {r[0]: shingles(r[1]) for r in sample if r[0] is not None}
    least = {i: min(j for j in sets if sets[j] == s) if s else None for i, s in sets.items()}
    heads = sorted({x for x in least.values() if x is not None})
    expected = sorted((i, j, len(sets[i] & sets[j])) for i in heads for j in heads if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))
    for hot in (64, 2):
        pairs, members = ngram_join.similar_pairs(docs, hot=hot)
        assert sorted(map(tuple, pairs.collect())) == expected and len(expected) > 10
        assert {r.doc_id: r.class_id for r in members.collect()} == least


def test_overlaps_of_pairs():
    rng = np.random.default_rng(6)
    rows = [np.unique(rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2)) for _ in range(20)]
    a, b = [], []
    for k in range(200):
        x = rows[k % 20]
        a.append(rng.permutation(x))
        b.append(rng.permutation(np.unique(np.r_[x[rng.random(len(x)) < 0.9], rows[(k + 1) % 20][: k % 9]])))
    sizes = [np.array([len(x) for x in y]) for y in (a, b)]
    got = ngram_join.overlaps(a, b, *sizes, 75)
    true = np.array([len(np.intersect1d(x, y)) for x, y in zip(a, b)])
    linked = 100 * true >= 75 * (sizes[0] + sizes[1] - true)
    assert linked.any() and not linked.all() and (got[linked] == true[linked]).all() and ((got < 0) | (got == true)).all()
    huge = np.full(200, 2_000_000_000)  # sizes whose hundredfold leaves 32 bits
    assert (ngram_join.overlaps(a, b, huge, huge, 75) == -1).all()


def test_join_of_a_large_group(spark):
    """Near copies of one text that are mostly not similar to each other, and a chain."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(100)]
    texts = []
    for k in range(150):
        t = list(base)
        for at in rng.sample(range(100), rng.randint(0, 3)):
            t[at] = f"x{k}-{at}"
        texts.append(t)
    chain = [[f"c{k + s}" for k in range(60)] for s in range(0, 80, 4)]
    sample = [(k, " ".join(t)) for k, t in enumerate(texts + chain)]
    sets = [shingles(t) for _, t in sample]
    label = list(range(len(sample)))
    changed = True
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in near:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    for rounds in (0, 2):
        got = ngram_join.near_duplicates(spark.createDataFrame(sample, "doc_id long, text string"), rounds=rounds)
        assert sorted((r.doc_id, r.component_id) for r in got.collect()) == list(enumerate(label))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + k, 101 + k) for k in range(40)]
    parent = {x: x for pair in links for x in pair}
    for _ in range(len(parent)):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r["key"]: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: p for x, p in parent.items() if x != p}


WAYS = [{}, {"most": 0}, {"hot": 2}, {"each": 700}]


@pytest.mark.parametrize("way", WAYS)
def test_suffix_array_dedup(docs, sample, nothing, way):
    """``most`` 0: every class takes the way of very large classes; ``hot`` 2: most take it in some batches only; ``each``: texts are cut."""
    length = 200
    counts = Counter(raw[i : i + length] for r in sample for raw in [(r[1] or "").encode()] for i in range(len(raw) - length + 1))
    expected = []
    for r in sample:
        raw = (r[1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if counts[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        expected.append((r[0] if r[0] is not None else -1, len(raw), int(gone.sum()), len(passages.ranges(gone)[0]), hashlib.sha256(kept).hexdigest()))
    got = suffix_array.digest(suffix_array.remove_repeats(docs, **way)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in got) == sorted(expected)
    if not way:
        assert suffix_array.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("way", WAYS)
def test_suffix_automata_dedup(docs, sample, nothing, way):
    length = 50
    first = defaultdict(lambda: 1 << 62)
    for r in sample:
        w = WORD.findall(r[1] or "")
        for i in range(len(w) - length + 1) if r[0] is not None else ():
            first[tuple(w[i : i + length])] = min(first[tuple(w[i : i + length])], r[0])
    expected, cut = [], {}
    for r in sample:
        w = WORD.findall(r[1] or "")
        gone = [False] * len(w)
        for i in range(len(w) - length + 1) if r[0] is not None else ():
            if first[tuple(w[i : i + length])] < r[0]:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        expected.append((-1 if r[0] is None else r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
        if not gone or not all(gone):
            cut[r[0]] = kept if any(gone) else r[1]
    got = suffix_automata.digest(suffix_automata.remove_repeats(docs, **way)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in got) == sorted(expected)
    assert sum(x[2] for x in expected) > 500
    if way:
        return
    whole = suffix_automata.cut_repeats(docs, **way)
    assert whole.columns == docs.columns and {r.doc_id: r.text for r in whole.collect()} == cut
    assert all(r.n_chars == len(r.text or "") for r in whole.collect())
    assert suffix_automata.cut_repeats(nothing).count() == 0


def test_repeated_rows(spark):
    """Equal rows of one doc_id: one document for the automata, separate ones for the suffix array."""
    text = " ".join(f"word{k}" for k in range(80))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in suffix_automata.remove_repeats(df).collect()) == [(1, 0), (1, 0), (2, 80)]
    assert {r.n_removed for r in suffix_array.remove_repeats(df).collect()} == {len(text)}
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(df).collect()) == [(1, 1), (1, 1), (2, 1)]
    assert ngram_join.keep_first(df).count() == 1


def several_texts_of_an_id():
    """Rows of one id with longer, shorter, empty and missing texts, some of which share passages with other ids, and rows without id."""
    rng = random.Random(9)
    some = lambda n: [f"{rng.random():.9f}" for _ in range(n)]
    a, b, c = some(130), some(90), some(160)
    rows = [(1, a), (2, a[20:110]), (2, some(140)), (2, ["tiny", "text", "here"]), (2, []), (2, None), (3, b), (3, c), (4, some(30) + b[10:80] + some(30)), (4, c[:70]), (4, c[:70]), (None, a[:60] + some(9)), (None, some(70)), (None, None)]
    rows += [(5, some(40) + a[30:90]), (5, a[30:90] + some(40)), (0, some(80))]
    return [(i, None if w is None else " ".join(w)) for i, w in rows]


def cut_bytes(rows, length=200):
    raws = [(t or "").encode() for _, t in rows]
    counts = Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    for (i, _), raw in zip(rows, raws, strict=True):
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if counts[raw[k : k + length]] > 1:
                gone[k : k + length] = True
        yield i, len(raw), int(gone.sum()), bytes(b for b, g in zip(raw, gone, strict=True) if not g)


def cut_words(rows, length=50):
    least: dict = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - length + 1) if i is not None else ():
            least[tuple(w[k : k + length])] = min(i, least.get(tuple(w[k : k + length]), i))
    for i, t in rows:
        w = (t or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - length + 1) if i is not None else ():
            if least[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        yield i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)


def in_order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("way", WAYS)
def test_several_texts_of_an_id(spark, way):
    """Findings belong to a row: nothing but repeats is cut out of the other rows of an id."""
    rows = several_texts_of_an_id()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, doc string, row string").repartition(3)
    got = suffix_array.remove_repeats(df, **way).select("doc_id", "n_bytes", "n_removed", "kept").collect()
    assert in_order((r[0], r[1], r[2], bytes(r[3])) for r in got) == in_order(cut_bytes(rows))
    got = suffix_automata.remove_repeats(df, **way).select("doc_id", "n_words", "n_removed", "kept").collect()
    expected = in_order(cut_words(rows))
    assert in_order(map(tuple, got)) == expected and sum(x[2] for x in expected) > 200
    whole = in_order((r.doc_id, " ".join((r.text or "").split())) for r in suffix_automata.cut_repeats(df, **way).collect())
    assert whole == in_order((i, kept) for i, n, gone, kept in expected if not gone or gone < n)


def test_a_repeated_row_is_searched_once(spark):
    """Very many equal rows of one id are one name: their findings are not collected once for each."""
    text = " ".join(f"{k * 7919 % 1000003:07d}" for k in range(120))
    df = passages.keyed(spark.createDataFrame([(1, text)] * 500 + [(2, text[200:] + " end")], "doc_id long, text string"))
    for way in ({}, {"most": 0}):
        found = passages.per_document(suffix_array.repeats(df, **way), ["start", "count"]).collect()
        assert len(found) == 2 and max(len(r.found) for r in found) < 100
    assert sorted({(r.doc_id, r.n_removed) for r in suffix_automata.remove_repeats(df.select("doc_id", "text")).collect()}) == [(1, 0), (2, 95)]


def test_long_texts_are_read_in_stretches():
    raw = np.arange(1000)
    for most in (1, 7, 300, 5000):
        held = [x for y in passages.stretches(["long", None, "long"], lambda t: raw if t else raw[:0], 20, most) for x in y]
        windows = [(k, at + i) for k, at, units in held for i in range(len(units) - 19)]
        assert windows == [(k, i) for k in (0, 2) for i in range(981)]
        assert all(len(units) <= most + 19 and (units == raw[at : at + len(units)]).all() for _, at, units in held)
    text = " ".join(f"w{k}" for k in range(3000)) + "\n\n tail"
    assert suffix_automata.read_words(text, 50).tolist() == suffix_automata.read_words(text).tolist() and len(suffix_automata.read_words(text)) == 3001
    assert len(suffix_automata.read_words(None)) == 0


def test_suffix_order():
    rng = random.Random(2)
    for _ in range(200):
        a = np.array([rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 60))], np.int64)
        assert suffix_array.suffix_array(a).tolist() == sorted(range(len(a)), key=lambda i: a[i:].tolist())


def test_matching_statistics():
    rng = random.Random(4)
    for _ in range(100):
        known = [[rng.randint(0, 3) for _ in range(rng.randint(0, 20))] for _ in range(3)]
        asked = [rng.randint(0, 3) for _ in range(30)]
        automaton = suffix_automata.Automaton()
        for k in known:
            automaton.add(k)
        inside = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i, len(k) + 1)} | {()}
        best = [max(n for n in range(e + 1) if tuple(asked[e - n : e]) in inside) for e in range(1, len(asked) + 1)]
        assert automaton.matching(asked) == best
