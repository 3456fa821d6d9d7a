"""SuperMinHash near-dedup: signatures against a plain version and as estimators, the whole result against brute force."""

import random
import re

import numpy as np
import pytest

from storelens.llm import superminhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=4):
    found = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(found[i : i + n]) for i in range(len(found) - n + 1)} or ({tuple(found)} if found else set())


def grouped(rows, percent=80):
    """doc_id, set size, least doc_id of the component, kept."""
    rows = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in rows if i is not None}

    def find(x):
        return x if label[x] == x else find(label[x])

    named = [r for r in rows if r[0] is not None]
    for k, (i, a) in enumerate(named):
        for j, b in named[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    out = [(i, len(s), None if i is None else find(i)) for i, s in rows]
    return sorted(((i, n, c, i == c) for i, n, c in out), key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def random_sets(rng, sizes):
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in sizes]
    return np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])


@pytest.mark.parametrize("places", [2, 16, 128, 256])
def test_stops_are_permutations(places):
    keys = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    stops = np.stack([superminhash.stop_places(keys, k, places) for k in range(places)])
    assert (np.sort(stops, 0) == np.arange(places)[:, None]).all()
    if places == 128:  # no place is favoured at any stop
        many = superminhash.stop_places(np.random.default_rng(2).integers(0, 1 << 63, 128_000, dtype=np.uint64), 5, places)
        assert abs(np.bincount(many, minlength=places) - 1000).max() < 200


def test_signature_is_the_least_offer():
    """Early stopping changes nothing: every n-gram makes all stops here, and the least (stop, offer) of a place counts."""
    names, owner = random_sets(np.random.default_rng(3), [1, 2, 7, 0, 60, 900])
    got = superminhash.signatures(names, owner, 6, 32)
    keys = superminhash.mix(names ^ superminhash.MULTIPLIER)
    for k in range(6):
        best = {}
        for x, key in zip(names[owner == k], keys[owner == k], strict=True):
            for stop in range(32):
                place = int(superminhash.stop_places(np.array([key]), stop, 32)[0])
                with np.errstate(over="ignore"):
                    offer = int(superminhash.mix(np.array([x + np.uint64(stop + 1) * superminhash.MULTIPLIER]))[0]) & ~1
                best[place] = min(best.get(place, (stop, offer)), (stop, offer))
        assert got[k].tolist() == [best[p][1] if best else int(superminhash.UNTAKEN) for p in range(32)]


def test_estimates_are_right_and_vary_less():
    """Equal places estimate the similarity; for small sets their variance is below that of independent ranks."""
    rng, errors = np.random.default_rng(4), []
    for _ in range(300):
        both = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
        a, b = (np.unique(np.r_[both[:16], both[16 + 2 * k : 18 + 2 * k]]) for k in (0, 1))
        s = superminhash.signatures(np.r_[a, b], np.repeat([0, 1], [len(a), len(b)]), 2)
        errors.append((s[0] == s[1]).mean() - 16 / 20)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < 0.8 * (0.8 * 0.2 / 128)


def test_whole_result(docs, sample, nothing):
    expected = grouped([r[:2] for r in sample])
    assert any(not kept for *_, kept in expected)
    assert result(superminhash.near_duplicates(docs)) == [(i, n, c, True if i is None else k) for i, n, c, k in expected]
    assert result(superminhash.near_duplicates(nothing)) == []


def test_group_of_near_copies(spark):
    """A chain of edits: neighbours are linked, the ends are not; and copies of one text around a hot class."""
    rng = random.Random(8)
    words = [f"w{rng.random()}" for _ in range(120)]
    rows = []
    for k in range(60):
        rows.append((k, " ".join(words)))
        for _ in range(2):
            words[rng.randrange(120)] = f"w{rng.random()}"
    rows += [(1000 + k, rows[30][1].upper()) for k in range(150)] + [(2000 + k, f"one two three {k % 9}") for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert result(superminhash.near_duplicates(df)) == grouped(rows)


def test_repeated_ids(spark):
    """Rows of one id are one document to the links, each with its own size."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    df = spark.createDataFrame([(5, a), (5, b), (7, a), (8, b), (9, c), (None, c), (5, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in superminhash.near_duplicates(df).collect()}
    assert got == {(5, 27, 5), (5, 0, 5), (7, 27, 5), (8, 27, 5), (9, 27, 9), (None, 27, None)}
