"""Substring dedup of words by suffix automata.

A window of ``length`` words goes where its words also start in a document with a smaller doc_id. Candidate
runs of windows (see ``passages``) fall into classes; most are settled by their content alone. The distinct
passages of the other classes are dealt out over reference shards. In a shard each class has a suffix
automaton that grows with the doc_id: a passage is streamed through the automaton of the smaller documents,
whose matching statistics (the longest suffix at each word that occurs there) give the spans to remove, and
joins the reference itself afterwards.

A class of very many distinct passages would make one shard hot; its windows are named one by one instead and
exchanged in even blocks of names, where each name's least doc_id decides, exact as well.

Defined cases: rows without a doc_id are kept whole and compared with nothing; null and blank texts have no words (the digest of the empty text); shorter texts are kept;
several rows of one doc_id are documents of one rank: neither is smaller than the other, each loses what it shares with smaller ones;
very long texts are read in stretches; extra columns are ignored; an empty table gives no row. Words are unchanged; kept words are joined by one space.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passages as P
from .base import batches, column, mix, slim, stash, text_bytes, word_names
from .blocks import block_count

LENGTH, PART = 50, 8


def split(text: str | None) -> list[bytes]:
    """Words between the ASCII white space characters."""
    return text.encode().split() if text else []


SPACE = re.compile(rb"[ \t-\r]")


def read_words(text: str | None, most: int = 4 << 20) -> np.ndarray:
    """The names of a text's words; a long text's words are never all in hand."""
    raw, at, out = text.encode() if text else b"", 0, []
    while at < len(raw):
        gap = SPACE.search(raw, at + most)
        end = gap.start() if gap else len(raw)
        out.append(word_names(raw[at:end].split()))
        at = end
    return np.concatenate([*out, np.empty(0, np.uint64)])


class Automaton:
    """The suffix automaton of several sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def _copy(self, p: int, q: int, symbol) -> int:
        """A state for the strings of q that end by ``symbol`` after p."""
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = new
            p = self.link[p]
        return new

    def add(self, sequence: list) -> None:
        last = 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:
                last = q if self.size[q] == self.size[last] + 1 else self._copy(last, q, symbol)
                continue
            new, p = len(self.next), last
            self.next.append({})
            self.size.append(self.size[last] + 1)
            self.link.append(0)
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][symbol]
                self.link[new] = q if self.size[q] == self.size[p] + 1 else self._copy(p, q, symbol)
            last = new

    def matching(self, sequence: list) -> list[int]:
        """For each place the length of the longest suffix that occurs in the automaton."""
        state, length, out = 0, 0, []
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            q = self.next[state].get(symbol)
            state, length = (0, 0) if q is None else (q, length + 1)
            out.append(length)
        return out


def _first(*keys: np.ndarray) -> np.ndarray:
    """Which of sorted entries begin a group of equal keys."""
    group = P.groups(*keys)
    return np.r_[True, group[1:] != group[:-1]][: len(group)]


def _later(e: dict, *keys: np.ndarray) -> np.ndarray:
    """Which entries have a smaller document in their group; groups are sorted by document."""
    group, first = P.groups(*keys), _first(*keys)
    return e["doc"] > e["doc"][first][group] if len(group) else first


def roles(e: dict, most: int, common: np.ndarray) -> np.ndarray:
    group = P.groups(e["value"])
    if not len(group):
        return group
    first, later = _first(e["value"], e["zone"]), _later(e, e["value"], e["zone"])
    low_zone = e["doc"][first][P.groups(e["value"], e["zone"])]
    low = np.minimum.reduceat(e["doc"], np.flatnonzero(_first(e["value"])))[group]
    zones = np.bincount(group[first])[group]
    role = np.where(later, P.SURE, np.where(low_zone > low, P.OPEN, np.where(first & (zones > 1), P.POOL, -1)))
    role = np.where((zones > most) & (role > 0), role + P.SINGLY, role)
    return np.where(common & ~later, P.OPEN + P.SINGLY, role)  # smaller documents may be elsewhere


def windows_alone(e: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    later = _later(e, e["name"], e["value"])
    return later, ~later, np.ones(len(later), bool)


#: A run or window goes where a smaller document has it; the smallest one of a batch travels for it.
LATER = P.Rule(lambda e: (_later(e, e["value"], e["zone"]), np.zeros(len(e["doc"]), bool)), roles, windows_alone, lambda e: _later(e, e["name"], e["value"]))


SHARED = "shard long, value long, doc long, row long, start int, role int, zone binary"
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())


def zones(docs: DataFrame, found: DataFrame, length: int, shards: int) -> DataFrame:
    """The word names of the runs that have to be compared."""

    def cut(source):
        for batch in P.once(batches(source)):
            out = []
            for doc, row, text, f in zip(*(column(batch, x).to_pylist() for x in (*P.ROW, "text")), P.struct_arrays(batch, "found", ["start", "count", "value", "role"]), strict=True):
                names = read_words(text)
                shard = mix(f["value"].view(np.uint64)) % np.uint64(shards)
                out += [(int(h), int(v), doc, row, int(a), int(r), names[a : a + n - 1 + length].tobytes()) for h, v, a, n, r in zip(shard, f["value"], f["start"], f["count"], f["role"], strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), KINDS, strict=True)], ["shard", "value", *P.ROW, "start", "role", "zone"])

    return P.with_documents(docs, P.per_document(found.where("role > 0"), ["start", "count", "value", "role"]).hint("shuffle_hash"), "inner").mapInArrow(cut, SHARED)


def shard_matches(found: DataFrame, length: int) -> DataFrame:
    """Windows of the open runs that occur in smaller documents, by the automata of each shard."""

    def solve(table):
        value, docs, rows = (table.column(x).to_numpy() for x in ("value", *P.ROW))
        starts, role, cells = table.column("start").to_numpy(), table.column("role").to_numpy(), table.column("zone").to_pylist()
        out: list[tuple[int, int, int, int]] = []
        order = np.lexsort((docs, value))
        group, seen, waiting = None, None, []
        for i in order.tolist():
            if value[i] != group:
                group, seen, waiting = value[i], Automaton(), []
            if waiting and waiting[0][0] != docs[i]:
                for _, words in waiting:
                    seen.add(words)
                waiting = []
            words = np.frombuffer(cells[i], np.int64).tolist()
            if role[i] == P.OPEN:
                first, n = P.ranges(np.array(seen.matching(words)) >= length)
                out += [(docs[i], rows[i], starts[i] + a - length + 1, k) for a, k in zip(first.tolist(), n.tolist(), strict=True)]
            waiting.append((docs[i], words))
        flat = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table([pa.array(x, t) for x, t in zip(flat, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], [*P.ROW, "start", "count"])

    return found.where(f"role <= {P.SINGLY}").groupBy("shard").applyInArrow(solve, P.PLACES)


def repeats(docs: DataFrame, length: int = LENGTH, part: int = PART, most: int = 256, hot: int = 16, each: int = 4 << 20) -> DataFrame:
    """``doc, row, start, count``: runs of windows that also start in a document with a smaller doc_id. ``docs``: doc_id, doc, row, text."""
    size = text_bytes(docs)
    docs = docs.where(docs["doc_id"].isNotNull())
    found = stash(P.candidates(docs, read_words, lambda names: names, length, part, block_count(size, 32 << 20), LATER, most, hot, each))
    shards = block_count(size, 16 << 20)
    texts = stash(zones(docs, found, length, shards))
    sure = found.where(f"role = {P.SURE}").select(*P.ROW, "start", "count")
    return sure.unionByName(shard_matches(texts, length)).unionByName(P.named_windows(texts, lambda raw: np.frombuffer(raw, np.uint64), length, shards, LATER))


def _kept(text: str | None, found: dict | None, length: int) -> tuple[int, int, bytes]:
    """Words, removed words, and the kept ones joined."""
    words = split(text)
    if found is None or not words:
        return len(words), 0, b" ".join(words)
    first, end = P.covered(found["start"], found["count"], length)
    return len(words), int((end - first).sum()), b" ".join([w for a, b in P.left_over(len(words), first, end) for w in words[a:b]])


def remove_repeats(docs: DataFrame, length: int = LENGTH, part: int = PART, most: int = 256, hot: int = 16, each: int = 4 << 20) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (text) for every row of ``docs`` (doc_id, text)."""

    def run(source):
        for batch in batches(source):
            out = [_kept(t, f, length) for t, f in zip(column(batch, "text").to_pylist(), P.struct_arrays(batch, "found", ["start", "count"]), strict=True)]
            n, gone, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([x.decode() for x in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    docs = P.keyed(slim(docs, "doc_id", "text"))
    found = P.per_document(repeats(docs, length, part, most, hot, each), ["start", "count"])
    return P.with_documents(docs, found.hint("shuffle_hash"), "left").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def cut_repeats(docs: DataFrame, length: int = LENGTH, part: int = PART, most: int = 256, hot: int = 16, each: int = 4 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, without the repeated passages in ``text``.

    A text that loses words becomes its kept words joined by one space, and ``n_chars`` follows; the others
    stay as they are. Documents that lose every word leave.
    """
    names = docs.columns
    doc, row, hidden = (f"{x} {uuid.uuid4().hex}" for x in ("doc", "row", "found"))

    def run(source):
        for batch in batches(source):
            texts, rows = column(batch, "text").to_pylist(), []
            for k, (t, f) in enumerate(zip(texts, P.struct_arrays(batch, hidden, ["start", "count"]), strict=True)):
                n, gone, kept = _kept(t, f, length) if f is not None else (0, 0, b"")
                if gone:
                    texts[k] = kept.decode()
                if not gone or gone < n:
                    rows.append(k)
            columns = {x: column(batch, x) for x in names}
            changed = pa.array(texts, pa.string())
            if "n_chars" in columns:
                size = [len(t) if t is not None and t != old else None for t, old in zip(texts, columns["text"].to_pylist(), strict=True)]
                columns["n_chars"] = pa.array([m if m is not None else old for m, old in zip(size, columns["n_chars"].to_pylist(), strict=True)], columns["n_chars"].type)
            columns["text"] = changed
            yield pa.RecordBatch.from_arrays(list(columns.values()), names).take(pa.array(rows, pa.int64()))

    whole = P.keyed(docs, doc, row)
    search = whole.select("doc_id", "text", F.col(doc).alias("doc"), F.col(row).alias("row"))
    found = P.per_document(repeats(search, length, part, most, hot, each), ["start", "count"])
    found = found.select(F.col("doc").alias(doc), F.col("row").alias(row), F.col("found").alias(hidden))
    return whole.join(found.hint("shuffle_hash"), [doc, row], "left").mapInArrow(run, docs.schema)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
