"""Suffix-array dedup: remove bytes covered by strings that also start anywhere else.

Candidate runs (see ``passages``) fall into classes; the distinct passages of the classes are dealt out over
shards, and each shard orders its suffixes by the difference-cover algorithm: the suffixes at the places 1
and 2 modulo 3 are sorted by triples, the triples' names are sorted by recursion, the other suffixes are
sorted by a symbol and the rank behind it, and the two orders are merged. Neighbours whose prefixes of
``length`` bytes agree are repeated strings. Equal strings always meet in one shard, so the shards' findings
together are those of one suffix array over the corpus.

A class of very many distinct passages (a common line that ends in different ways) would make one shard hot.
Its windows are named one by one instead and exchanged in even blocks of names, which is exact as well.

Defined cases: every row is a document, rows without a doc_id and rows that repeat one too; null and empty texts have nothing
to remove (the digest of no bytes); texts shorter than ``length`` are kept whole; very long texts are read in stretches;
extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passages as P
from .base import MULTIPLIER, batches, column, mix, slim, stash, text_bytes, window_names
from .blocks import block_count

LENGTH, PART = 200, 100


def dense(*columns: np.ndarray) -> np.ndarray:
    """Order-preserving 63-bit keys of tuples of non-negative numbers."""
    key, top = columns[0].astype(np.int64), int(columns[0].max(initial=0)) + 1
    for c in columns[1:]:
        most = int(c.max(initial=0)) + 1
        if top * most >= 1 << 63:
            values, key = np.unique(key, return_inverse=True)
            top = len(values)
        key, top = key * most + c, top * most
    return key


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The order of all suffixes of ``s`` (numbers from 1), by difference-cover sampling modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    last = n + (n % 3 == 1)  # a dummy sample parts the two halves of the recursion
    one, two = np.arange(1, last, 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    triple = dense(s[sample], s[np.minimum(sample + 1, n)], s[np.minimum(sample + 2, n)])
    values, names = np.unique(triple, return_inverse=True)
    order = np.argsort(names, kind="stable") if len(values) == len(sample) else suffix_array(names + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sample = sample[order]
    sample = sample[sample < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(dense(s[rest], rank[rest + 1]), kind="stable")]
    first, second = sample[sample % 3 == 1], sample[sample % 3 == 2]
    key = dense(np.concatenate([s[rest], s[first]]), np.concatenate([rank[rest + 1], rank[first + 1]]))
    at = np.searchsorted(key[len(rest) :], key[: len(rest)])
    key = dense(np.concatenate([s[rest], s[second]]), np.concatenate([s[rest + 1], s[second + 1]]), np.concatenate([rank[rest + 2], rank[second + 2]]))
    at = at + np.searchsorted(key[len(rest) :], key[: len(rest)]) + np.arange(len(rest))
    out, free = np.empty(n, np.int64), np.ones(n, bool)
    out[at], free[at] = rest, False
    out[free] = sample
    return out


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its windows of ``length`` bytes start more than once in all the texts."""
    size = np.array([len(t) for t in texts])
    ends = np.cumsum(size + 1)
    symbols = np.zeros(ends[-1] if len(ends) else 0, np.int64)
    inside = np.ones(len(symbols), bool)
    inside[ends - 1] = False
    symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    symbols[ends - 1] = 257 + np.arange(len(texts))  # separators, all different
    order = suffix_array(symbols)
    place = np.arange(len(symbols))
    owner = np.repeat(np.arange(len(texts)), size + 1)
    whole = place + length < ends[owner]
    order = order[whole[order]]
    name = window_names(mix(symbols.astype(np.uint64) * MULTIPLIER), length)
    same = name[order[1:]] == name[order[:-1]]  # compare adjacent prefixes
    flag = np.zeros(len(symbols), bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return [flag[e - 1 - n : e - length] if n >= length else np.empty(0, bool) for e, n in zip(ends, size, strict=True)]


SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)


def scrambled(raw: bytes) -> np.ndarray:
    return SYMBOLS[np.frombuffer(raw, np.uint8)]


def read_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer(text.encode() if text else b"", np.uint8)


def _first(*keys: np.ndarray) -> np.ndarray:
    """Which of sorted entries begin a group of equal keys."""
    group = P.groups(*keys)
    return np.r_[True, group[1:] != group[:-1]][: len(group)]


def _many(*keys: np.ndarray) -> np.ndarray:
    group = P.groups(*keys)
    return np.bincount(group)[group] > 1 if len(group) else np.empty(0, bool)


def alone(e: dict) -> tuple[np.ndarray, np.ndarray]:
    first = _first(e["value"], e["zone"])
    return ~first, first & _many(e["value"], e["zone"])


def roles(e: dict, most: int, common: np.ndarray) -> np.ndarray:
    group, zone = P.groups(e["value"]), P.groups(e["value"], e["zone"])
    if not len(group):
        return group
    first = _first(e["value"], e["zone"])
    copies = np.bincount(zone, 1 + (e["twice"] & P.COPIED > 0))[zone]
    zones = np.where(common, most + 2, np.bincount(group[first])[group])  # there are others elsewhere
    twice = np.bincount(group, e["twice"] & P.TWICE)[group] > 0
    role = np.where(copies > 1, np.where(first, P.POOL, P.SURE), P.OPEN)
    role[(zones == 1) & ~twice] = P.SURE
    role[(zones == 1) & (copies == 1) & ~twice] = -1
    return np.where((zones > most) & (role > 0), role + P.SINGLY, role)


def windows_alone(e: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    many = _many(e["name"], e["value"])
    return many, _first(e["name"], e["value"]), ~many


#: A run or window goes where another one is like it; one of a batch travels for all of them.
AGAIN = P.Rule(alone, roles, windows_alone, lambda e: _many(e["name"], e["value"]))


SHARED = "shard long, value long, doc long, row long, start int, role int, zone binary"
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())


def zones(docs: DataFrame, found: DataFrame, length: int, shards: int) -> DataFrame:
    """The text of the runs that have to be compared."""

    def cut(source):
        for batch in P.once(batches(source)):
            out = []
            for doc, row, text, f in zip(*(column(batch, x).to_pylist() for x in (*P.ROW, "text")), P.struct_arrays(batch, "found", ["start", "count", "value", "role"]), strict=True):
                raw = text.encode()
                shard = mix(f["value"].view(np.uint64)) % np.uint64(shards)
                out += [(int(h), int(v), doc, row, int(a), int(r), raw[a : a + n - 1 + length]) for h, v, a, n, r in zip(shard, f["value"], f["start"], f["count"], f["role"], strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), KINDS, strict=True)], ["shard", "value", *P.ROW, "start", "role", "zone"])

    return P.with_documents(docs, P.per_document(found.where("role > 0"), ["start", "count", "value", "role"]).hint("shuffle_hash"), "inner").mapInArrow(cut, SHARED)


def shard_repeats(found: DataFrame, length: int) -> DataFrame:
    """Repeated windows of the open runs, by a suffix array for each shard."""

    def solve(table):
        texts, role = table.column("zone").to_pylist(), table.column("role").to_numpy()
        docs, rows, starts = (table.column(x).to_numpy() for x in (*P.ROW, "start"))
        out: list[list[np.ndarray]] = [[], [], [], []]
        for k, flags in enumerate(repeated_windows(texts, length)):
            if role[k] == P.OPEN and flags.any():
                first, n = P.ranges(flags)
                for x, y in zip(out, (np.full(len(n), docs[k]), np.full(len(n), rows[k]), starts[k] + first, n), strict=True):
                    x.append(y)
        flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
        return pa.table([*(pa.array(x, pa.int64()) for x in flat[:2]), *(pa.array(x.astype(np.int32)) for x in flat[2:])], [*P.ROW, "start", "count"])

    return found.where(f"role <= {P.SINGLY}").groupBy("shard").applyInArrow(solve, P.PLACES)


def repeats(docs: DataFrame, length: int = LENGTH, part: int = PART, most: int = 256, hot: int = 16, each: int = 2 << 20) -> DataFrame:
    """``doc, row, start, count``: runs of windows of ``length`` bytes that also start elsewhere. ``docs``: doc, row, text."""
    size = text_bytes(docs)
    # the bytes of a batch become arrays of eight bytes each, hence the smaller batches
    found = stash(P.candidates(docs, read_bytes, SYMBOLS.__getitem__, length, part, block_count(size, 32 << 20), AGAIN, most, hot, each))
    shards = block_count(size, 16 << 20)
    texts = stash(zones(docs, found, length, shards))
    sure = found.where(f"role in ({P.SURE}, {P.POOL}, {P.POOL + P.SINGLY})").select(*P.ROW, "start", "count")
    return sure.unionByName(shard_repeats(texts, length)).unionByName(P.named_windows(texts, scrambled, length, shards, AGAIN))


def remove_repeats(docs: DataFrame, length: int = LENGTH, part: int = PART, most: int = 256, hot: int = 16, each: int = 2 << 20) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary) for every row of ``docs`` (doc_id, text)."""

    def run(source):
        for batch in batches(source):
            out = []
            for text, f in zip(column(batch, "text").to_pylist(), P.struct_arrays(batch, "found", ["start", "count"]), strict=True):
                raw = text.encode() if text else b""
                if f is None or not raw:
                    out.append((len(raw), 0, 0, raw))
                    continue
                first, end = P.covered(f["start"], f["count"], length)
                kept = b"".join(raw[a:b] for a, b in P.left_over(len(raw), first, end))
                out.append((len(raw), len(raw) - len(kept), len(first), kept))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    docs = P.keyed(slim(docs, "doc_id", "text"))
    found = P.per_document(repeats(docs, length, part, most, hot, each), ["start", "count"])
    return P.with_documents(docs, found.hint("shuffle_hash"), "left").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
