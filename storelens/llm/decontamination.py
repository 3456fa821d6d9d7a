"""Benchmark decontamination by pigeonhole edit matching.

A test item may differ from a passage by a budget of edits that grows with its length. The item is cut into
one piece more than the budget; at least one piece then occurs unchanged in every passage within the budget.
All pieces are found at once in a text (one automaton over the pieces), and the surroundings of a hit are
verified by Myers' bit-parallel edit distance, whose bit vectors are Python integers of any length.

Texts and items are compared in lower case with white space runs as one blank.

Defined cases: null and blank texts or items match nothing; items without an id take no part; items with equal
texts each match; an item shorter than its pieces need has a smaller budget; whole texts are searched; repeated rows
give repeated results; a document without an id is searched like any other, and its findings carry a null id; extra
columns are ignored. The items are taken in chunks of a bounded size, one after the other: each chunk is broadcast,
searched in one pass over the documents, and freed when the next is there, so that the driver never holds more than
two and a task never more than one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import batches, claim, column, discard, slim, stash

#: One edit is allowed for so many characters of an item.
CHARACTERS_AN_EDIT = 20
CHUNK_BYTES = 16 << 20


def plain(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(item: str, rate: int = CHARACTERS_AN_EDIT) -> int:
    return min(len(item) // rate, len(item) - 1)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of nearly equal length, with their places."""
    cuts = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' bit-parallel matching of one item."""

    def __init__(self, item: str):
        self.item, self.size = item, len(item)
        self.places: dict[str, int] = {}
        for i, c in enumerate(item):
            self.places[c] = self.places.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """The least edit distance of the item to any substring of ``text``, and where the first such ends."""
        full, top = (1 << self.size) - 1, 1 << self.size - 1
        up, down, score = full, 0, self.size
        best, end = score, 0
        for i, c in enumerate(text, 1):
            equal = self.places.get(c, 0)
            vertical = equal | down
            across = ((equal & up) + up ^ up) | equal
            plus, minus = down | ~(across | up) & full, up & across
            score += bool(plus & top) - bool(minus & top)
            plus, minus = plus << 1, minus << 1  # a match may start anywhere: no charge for leading text
            up = (minus | ~(vertical | plus)) & full
            down = plus & vertical & full
            if score < best:
                best, end = score, i
        return best, end


class Matcher:
    """Finds all items in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: int = CHARACTERS_AN_EDIT):
        import ahocorasick

        self.items = [(i, Pattern(t), budget(t, rate)) for i, t in items]
        found: dict[str, list] = {}
        for k, (_, p, edits) in enumerate(self.items):
            for at, piece in pieces(p.item, edits):
                found.setdefault(piece, []).append((k, at + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, places)
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str, first: bool = False) -> list[tuple[int, int, int]]:
        """``item_id, distance, end`` of the best match of each item within its budget; with ``first`` of any one item."""
        if not len(self.automaton) or not text:
            return []
        best: dict[int, tuple[int, int]] = {}
        tried: dict[int, int] = {}
        for last, places in self.automaton.iter(text):
            for k, behind in places:
                _, pattern, edits = self.items[k]
                start = last + 1 - behind  # where the item would start without an edit before the piece
                if best.get(k, (1,))[0] == 0 or tried.get(k) == start:
                    continue
                tried[k] = start
                if first and best:
                    break
                if start >= 0 and text.startswith(pattern.item, start):
                    best[k] = 0, start + pattern.size
                    continue
                low = max(0, start - edits)
                distance, end = pattern.best(text[low : start + pattern.size + edits])
                if distance <= edits and distance < best.get(k, (edits + 1,))[0]:
                    best[k] = distance, low + end
        return [(self.items[k][0], d, end) for k, (d, end) in sorted(best.items())]


_matchers: dict = {}


def chunks(benchmark: DataFrame, most: int = CHUNK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in chunks of about ``most`` bytes, each read when it is asked for."""
    items = slim(benchmark, "item_id", "text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // most)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    for k in range(n):
        if some := [(i, p) for i, t in items.where(part == k).orderBy("item_id", "text").collect() if (p := plain(t))]:
            yield some


def _with_matcher(docs: DataFrame, items: list[tuple[int, str]], rate: int, work, out) -> tuple[DataFrame, object]:
    """``work(matcher, batch)`` over the batches of ``docs``, and the broadcast that it needs."""
    shared, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(source):
        claim("test items", _matchers.clear)
        if key not in _matchers:
            _matchers.clear()
            _matchers[key] = Matcher(shared.value, rate)
        for batch in batches(source):
            yield work(_matchers[key], batch)

    return docs.mapInArrow(run, out), shared


FOUND = "doc_id long, item_id long, distance int, end int"


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: int = CHARACTERS_AN_EDIT, most: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, item_id, distance, end``: each document and item that match within the item's budget.

    ``end`` is the place behind the match in the plain text.
    """

    def search(matcher, batch):
        out = [(doc, *m) for doc, t in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist(), strict=True) for m in matcher.matches(plain(t))]
        cells = zip(*out, strict=True) if out else ((),) * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, kinds, strict=True)], ["doc_id", "item_id", "distance", "end"])

    found, shared = [], None
    for items in chunks(benchmark, most):
        if found:
            found[-1] = stash(found[-1])
            shared.destroy()
        here, shared = _with_matcher(slim(docs, "doc_id", "text"), items, rate, search, FOUND)
        found.append(here)
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], FOUND)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: int = CHARACTERS_AN_EDIT, most: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, whose text matches no test item. Each row is judged by its own text."""
    def clean(matcher, batch):
        return batch.filter(pa.array([not matcher.matches(plain(t), True) for t in column(batch, "text").to_pylist()], pa.bool_()))

    kept, before, shared = docs, None, None
    for items in chunks(benchmark, most):
        if shared is not None:
            kept = stash(kept)
            shared.destroy()
            discard(before)
            before = kept
        kept, shared = _with_matcher(kept, items, rate, clean, docs.schema)
    return kept
