"""Candidate passages: where may a window of ``length`` symbols of one document recur?

Every window is represented by the least name among its ``part``-symbol substrings. Equal windows have equal
representatives, and consecutive windows mostly share one, so a run of windows becomes one entry
(representative, place, number of windows). Runs whose representative occurs once in the corpus hold no
repeated window and end here; the others form classes that are small, independent units of work.

Before the exchange each batch settles what it can for itself: of runs with equal content only one travels, with a mark
that there are others, and a representative with very many contents (a common line that goes on in different ways) sends
one mark in place of its runs, which are told apart window by window. So no class is gathered that copies or a common
passage make large.

This only narrows the search and loses nothing: whether two windows are equal is decided later.

Findings belong to a row, not to a doc_id: ``row`` tells rows of one id apart (see ``keyed``). A long text is read in
stretches that overlap by a window, so what a task holds does not grow with a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import as_longs, batches, column, mix, powers, prefix_sums, slim, window_names
from .blocks import block_of, by_block, pack, schema

#: Entries of a run, as they travel: representative, content of the run, document, first window, windows, flag.
FIELDS = {"value": "<u8", "zone": "<u8", "doc": "<i8", "row": "<i8", "start": "<i4", "count": "<i4", "twice": "<u1"}
RUNS = "doc long, row long, start int, count int, value long, role int"
#: What names a row of documents.
ROW = ["doc", "row"]
#: Roles: every window of the run recurs; the run must be compared; it recurs and others are compared with it.
#: Two more than a role: the run is compared window by window.
SURE, OPEN, POOL, SINGLY = 0, 1, 2, 2
#: Bits of the flag: the representative occurs twice in the run; its batch has copies of it; a mark of a common representative.
TWICE, COPIED, MARK = 1, 2, 4


@dataclass(frozen=True)
class Rule:
    """What counts as a repetition. All functions take sorted entries as arrays.

    ``alone`` of a batch's runs: which are settled, and which have copies; one of each content is not settled.
    ``roles`` of a block's runs, given which have a common representative; ``windows_alone`` of a batch's windows: which recur, which have to travel, and which
    of these are still open; ``windows`` of a block: which recur.
    """

    alone: Callable[[dict], tuple[np.ndarray, np.ndarray]]
    roles: Callable[[dict, int, np.ndarray], np.ndarray]
    windows_alone: Callable[[dict], tuple[np.ndarray, np.ndarray, np.ndarray]]
    windows: Callable[[dict], np.ndarray]


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours, by running minima over blocks from both sides."""
    n = len(x) - width + 1
    fill = -len(x) % width
    padded = np.concatenate([x, np.full(fill, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(symbols: np.ndarray, ends: np.ndarray, length: int, part: int) -> dict[str, np.ndarray] | None:
    """Runs of the windows in concatenated documents that end at ``ends``; ``doc`` counts them from 0."""
    if len(symbols) < length:
        return None
    names = window_names(symbols, part)
    width = length - part + 1
    least = sliding_minimum(names, width)
    owner = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))[: len(least)]
    inside = np.arange(len(least)) + length <= ends[owner]
    new = np.r_[True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])] & inside
    new[1:] |= inside[1:] & ~inside[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return None
    edge = np.flatnonzero(inside & np.r_[~inside[1:] | new[1:], True])
    count = edge - first + 1
    value = least[first]
    twice = np.empty(len(first), bool)
    near = np.lib.stride_tricks.sliding_window_view(names, width)
    for k in range(0, len(first), 1 << 14):  # does the representative occur twice within the run?
        some = slice(k, k + (1 << 14))
        a, b = near[first[some]] == value[some, None], near[edge[some]] == value[some, None]
        twice[some] = (a.sum(1) > 1) | (b.sum(1) > 1) | (a.argmax(1) + first[some] != b.argmax(1) + edge[some])
    # content of the run: a polynomial over the names of its parts, taken relative to its first one
    total = prefix_sums(names)
    zone = mix((total[edge + width] - total[first]) * powers(len(names))[1][first] + count.astype(np.uint64))
    before = np.r_[0, ends][owner[first]]
    return {"value": value, "zone": zone, "doc": owner[first], "start": (first - before).astype(np.int32), "count": count.astype(np.int32), "twice": twice.astype(np.uint8)}


def keyed(docs: DataFrame, doc: str = "doc", row: str = "row") -> DataFrame:
    """``docs`` with two more columns that name a row: its id (0 for none), and a hash of its text, or 0 where ids are unique.

    Rows of equal id and text share a name; what is found for one holds for the other.
    """
    ids = slim(docs, "doc_id").where("doc_id is not null")
    unique = ids.groupBy("doc_id").count().where("count > 1").isEmpty()
    text = F.xxhash64(docs["doc_id"].isNull(), docs["text"]).bitwiseOR(F.lit(1))
    return docs.withColumns({doc: F.coalesce(docs["doc_id"].cast("long"), F.lit(0).cast("long")), row: F.when(docs["doc_id"].isNotNull(), F.lit(0).cast("long")).otherwise(text) if unique else text})


def home(e: dict, blocks: int) -> np.ndarray:
    """The block in which the entries of a row are gathered."""
    return block_of(mix(e["doc"].view(np.uint64) ^ mix(e["row"].view(np.uint64))), blocks)


def once(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a task without the further rows of one name (equal id and text); names are kept where ids repeat only."""
    seen: set[tuple[int, int]] = set()
    for batch in source:
        keep = []
        for name in zip(*(column(batch, x).to_pylist() for x in ROW), strict=True):
            keep.append(not name[1] or name not in seen)
            if name[1]:
                seen.add(name)
        yield batch if all(keep) else batch.filter(pa.array(keep, pa.bool_()))


def stretches(texts: list, read: Callable[[str | None], np.ndarray], length: int, most: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Lists of (text, first window, units) of about ``most`` windows in all; longer texts are cut, overlapping by a window."""
    held, size = [], 0
    for k, text in enumerate(texts):
        units = read(text)
        for at in range(0, len(units) - length + 1, most):
            held.append((k, at, units[at : at + most + length - 1]))
            size += len(held[-1][2])
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def candidates(docs: DataFrame, read: Callable[[str | None], np.ndarray], symbols: Callable[[np.ndarray], np.ndarray], length: int, part: int, blocks: int, rule: Rule, most: int, hot: int, each: int = 4 << 20) -> DataFrame:
    """Runs whose class needs attention: ``doc, row, start, count, value, role``. ``docs``: doc, row, text.

    ``read`` gives the units of a text, ``symbols`` their 64-bit symbols. Classes of more than ``most`` contents, and
    those with ``hot`` of them in one batch, are compared window by window. ``each`` bytes or units are handled at once.
    """

    def found(batch):
        texts = column(batch, "text").to_pylist()
        ids, rows = (as_longs(column(batch, x)) for x in ROW)
        for held in stretches(texts, read, length, each):
            owner, at = (np.array([x[k] for x in held]) for k in (0, 1))
            parts = [symbols(x[2]) for x in held]
            if e := runs(np.concatenate(parts), np.cumsum([len(x) for x in parts]), length, part):
                yield e | {"doc": ids[owner][e["doc"]], "row": rows[owner][e["doc"]], "start": (e["start"] + at[e["doc"]]).astype(np.int32)}

    def cut(source):
        for e in (x for batch in batches(source, each) for x in found(batch)):
            order = np.lexsort((e["start"], e["row"], e["doc"], e["zone"], e["value"]))
            e = {x: e[x][order].astype(kind) for x, kind in FIELDS.items()}
            settled, copied = rule.alone(e)
            value, zone = groups(e["value"]), groups(e["value"], e["zone"])
            new = np.r_[True, zone[1:] != zone[:-1]]
            common = np.bincount(value[new])[value] >= hot
            e["twice"] |= np.where(copied, COPIED, 0).astype(np.uint8)
            block = block_of(mix(e["value"]), blocks)
            here = settled | common
            role = np.where(settled, SURE, np.where(copied, POOL, OPEN) + SINGLY)
            block[here] = blocks + home({x: e[x][here] for x in ROW}, blocks)
            e["twice"][here] = role[here]
            mark = np.flatnonzero(common & np.r_[True, value[1:] != value[:-1]])
            marks = {x: v[mark] for x, v in e.items()} | {"twice": np.full(len(mark), MARK, np.uint8)}
            yield pack(np.r_[block, block_of(mix(marks["value"]), blocks)], {x: np.r_[e[x], marks[x]] for x in FIELDS})

    def solve(e):
        if e.pop("block") >= blocks:
            role = e["twice"].astype(np.int32)
        else:
            order = np.lexsort((e["start"], e["row"], e["doc"], e["zone"], e["value"]))
            e = {x: v[order] for x, v in e.items()}
            group, mark = groups(e["value"]), (e["twice"] & MARK) > 0
            common = np.bincount(group, mark)[group] > 0 if len(group) else mark
            e = {x: v[~mark] for x, v in e.items()}
            role = rule.roles(e, most, common[~mark])
        at = np.flatnonzero(role >= 0)
        return pa.table([*(pa.array(e[x][at]) for x in ("doc", "row", "start", "count")), pa.array(e["value"][at].view(np.int64)), pa.array(role[at].astype(np.int32))], [*ROW, "start", "count", "value", "role"])

    packed = slim(docs, *ROW, "text").mapInArrow(cut, schema(FIELDS))
    return by_block(packed, FIELDS, solve, RUNS, 2 * blocks, "block")


WINDOWS = {"name": "<u8", "value": "<i8", "doc": "<i8", "row": "<i8", "start": "<i4", "open": "<u1"}
PLACED = {"doc": "<i8", "row": "<i8", "start": "<i4"}
PLACES = "doc long, row long, start int, count int"


def named_windows(found: DataFrame, read: Callable[[bytes], np.ndarray], length: int, blocks: int, rule: Rule) -> DataFrame:
    """Decide on each window of passages (doc, row, start, role, value, zone) by its own name: ``doc, row, start, count``.

    Equal windows are of one class, so a window goes by its class and its name, 128 bits together. A batch settles its own repetitions and sends each name on once; names are exchanged in blocks. What recurs is
    exchanged by document, where neighbouring windows become one run again.
    """

    def cut(source):
        for batch in batches(source, 1 << 20):
            parts = []
            for value, doc, row, start, role, raw in zip(*(column(batch, x).to_pylist() for x in ("value", *ROW, "start", "role", "zone")), strict=True):
                names = window_names(read(raw), length)
                parts.append((names, *(np.full(len(names), x) for x in (value, doc, row)), np.arange(start, start + len(names)), np.full(len(names), role == OPEN + SINGLY)))
            e = {x: np.concatenate(v).astype(kind) for (x, kind), v in zip(WINDOWS.items(), zip(*parts, strict=True), strict=True)}
            order = np.lexsort((e["start"], e["row"], e["doc"], e["value"], e["name"]))
            e = {x: v[order] for x, v in e.items()}
            recurs, travels, still = rule.windows_alone(e)
            sent = {x: v[travels] for x, v in e.items()} | {"open": (e["open"] * still)[travels].astype(np.uint8)}
            done = {x: v[recurs & (e["open"] > 0)] for x, v in e.items()}
            block = np.r_[block_of(sent["name"], blocks), blocks + home(done, blocks)]
            yield pack(block, {x: np.r_[sent[x], done[x]] for x in WINDOWS})

    def decide(e):
        if e.pop("block") < blocks:
            order = np.lexsort((e["doc"], e["value"], e["name"]))
            e = {x: v[order] for x, v in e.items()}
            at = np.flatnonzero(rule.windows(e) & (e["open"] > 0))
            e = {x: v[at] for x, v in e.items()}
        return pa.Table.from_batches([pack(home(e, blocks), {x: e[x] for x in PLACED})])

    def join(e):
        order = np.lexsort((e["start"], e["row"], e["doc"]))
        doc, row, start = (e[x][order] for x in PLACED)
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)])
        last = np.r_[first[1:], len(doc)] - 1
        return pa.table([pa.array(doc[first]), pa.array(row[first]), pa.array(start[first]), pa.array((start[last] - start[first] + 1).astype(np.int32))], [*ROW, "start", "count"])

    named = by_block(found.where(f"role > {SINGLY}").mapInArrow(cut, schema(WINDOWS)), WINDOWS, decide, schema(PLACED), 2 * blocks, "block")
    return by_block(named, PLACED, join, PLACES, blocks)


def groups(*keys: np.ndarray) -> np.ndarray:
    """Group number of each entry of sorted keys."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    return np.cumsum(np.any([np.r_[False, k[1:] != k[:-1]] for k in keys], 0))


def per_document(found: DataFrame, columns: list[str]) -> DataFrame:
    """One row per named row: its different entries as arrays (their number is bounded by the text's length)."""
    return found.groupBy(*ROW).agg(F.collect_set(F.struct(*columns)).alias("found"))


def with_documents(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``docs`` (keyed) with the column ``found``."""
    return docs.join(found, ROW, how)


def struct_arrays(batch: pa.RecordBatch, name: str, fields: list[str]) -> Iterator[dict[str, np.ndarray] | None]:
    """The arrays of structs of a column, row by row, as numpy arrays."""
    cells = column(batch, name)
    offsets, values = cells.offsets.to_numpy(), cells.values
    flat = {x: values.field(x).to_numpy(zero_copy_only=False) for x in fields}
    valid = cells.is_valid().to_numpy(zero_copy_only=False)
    for k in range(len(cells)):
        yield {x: v[offsets[k] : offsets[k + 1]] for x, v in flat.items()} if valid[k] else None


def covered(start: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and behind-the-last symbols of the maximal stretches that windows, given as runs, cover."""
    order = np.argsort(start, kind="stable")
    first, end = start[order].astype(np.int64), np.maximum.accumulate((start + count - 1 + length)[order].astype(np.int64))
    new = np.r_[True, first[1:] > end[:-1]][: len(first)]
    return first[new], end[np.r_[new[1:], True][: len(end)]]


def left_over(size: int, first: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int]]:
    """The stretches of ``size`` symbols between covered ones."""
    at = 0
    for a, b in zip(first.tolist(), end.tolist(), strict=True):
        if at < a:
            yield at, a
        at = b
    if at < size:
        yield at, size


def ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of True."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    first = np.flatnonzero(edge == 1)
    return first, np.flatnonzero(edge == -1) - first
