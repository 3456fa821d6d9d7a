"""The conversation trie against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from storelens.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, stretch string, depth string, n int, least long"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    trunc = lambda c: c - int(c / 100) * 100  # noqa: E731  the sign of c
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - trunc(c), [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        stack = [p]
        while stack:
            q = stack.pop()
            yield q
            stack += kids[q]

    out = []
    for p, members in nodes.items():
        ends = sorted(c for c in members if len(built[c]) == len(p))
        saved = sum((len(nodes[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below(p))
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), parent, len(members), len(kids[p]), sum(not kids[q] for q in below(p)), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out)


def conversations(seed, families=4, size=14):
    """Few different turns, so that prefixes are shared across conversations, with copies and odd values."""
    rng, rows = random.Random(seed), []
    for family in range(families):
        for c in [100 * family, *rng.sample(range(100 * family + 1, 100 * family + 99), size)]:
            rows += [(c, t, rng.choice(["user", "bot"]), rng.choice("ab") * rng.randint(0, 2)) for t in range(rng.randint(0, 9))]
    grown = [("user", f"t{k}") for k in range(20)]
    for k in range(20):  # each continues the one before
        rows += [(1000 + k, t, *grown[t]) for t in range(k + 1)]
    for k in range(30):  # copies
        rows += [(2101 + k, t, "user", "same") for t in range(7)]
    rows += [(7, None, None, None), (7, None, "user", "x"), (7, 3, None, "😀é"), (7, 3, None, "😀é"), (None, 1, "user", "x"), (-150, 0, "a", "b"), (-100, 0, "a", "b"), (-100, 1, "c", "d"), (5001, 0, "user", "only one")]
    rng.shuffle(rows)
    return [(*r, "x", "x", 1, 2) for r in rows]


def result(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("stretch", [12, 1])
def test_trie(spark, monkeypatch, stretch):
    """Also with stretches of two turns, so that every sum is carried over several."""
    monkeypatch.setattr(conversation_trie, "STRETCH", stretch)
    rows = conversations(stretch)
    expected = brute(rows)
    assert any(x[2] not in (None, x[0]) for x in expected)
    got = result(conversation_trie.trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == expected


def test_empty_and_turnless(spark):
    assert result(conversation_trie.trie(spark.createDataFrame([], SCHEMA))) == []
    rows = [(k, 0, "user", "x", "", "", 0, 0) for k in range(301, 340)]  # no base: short ones lose their only turn
    assert result(conversation_trie.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_pieces_of_a_large_end(spark):
    """The hash of many conv_ids does not depend on how they were cut."""
    ends = spark.range(1000).selectExpr("5L as owner", "2L as depth", "id * 3 as conv_id").repartition(7)
    want = hashlib.sha256(",".join(str(3 * k) for k in range(1000)).encode()).hexdigest()
    for most in (1, 7, 1 << 16):
        assert result(conversation_trie.end_digests(ends, most)) == [(5, 2, want)]
