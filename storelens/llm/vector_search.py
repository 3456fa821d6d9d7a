"""Exact top-k search by inner product over KD-trees, one for each shard of the vectors.

Shards are cut in space: the top levels of one KD-tree, fitted on a bounded sample, give each vector a cell, and a cell
of many vectors is dealt out over several shards. A shard's tree splits its vectors at the median of the widest
dimension and keeps a tight bounding box for each node. It is built once and written to the shared folder.

A query visits nodes best-first by the greatest inner product that a box allows, and stops when no box can beat the kth
score so far. Each query first searches the shard in whose cell it lies, where the tree is built. The kth score found
there is propagated: against the shards' root boxes it decides which of the other shards a query is sent to at all, and
bounds the search there. Queries go to a shard in batches of a bounded number.

Scores are integers: each component becomes floor(scale * x). Products are exact; a score beyond the range of a long is
cut to it.

Defined cases: vectors that are null or hold a null or a non-finite component take no part, neither do rows
without an id; rows with a query's own id are no candidates; with fewer than k candidates all are returned; ties go to
the smaller vec_id; repeated rows of one id are candidates as they come, and ask once (with the least of their vectors,
compared by component); vectors of different lengths are compared within their own length only; extra columns are
ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import slim, stash

LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Sums of products of whole numbers up to this many bits in all stay within a long.
SAFE_BITS = 62


def products(rows: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as longs; ``exact`` for numbers whose sums may leave the range of a long, which cuts them."""
    if not exact:
        return rows @ query
    sums = rows.astype(object) @ query.astype(object)
    return np.array([min(max(int(x), LEAST + 1), MOST) for x in sums], np.int64)


def needs_care(queries: np.ndarray, *others: np.ndarray) -> bool:
    """May inner products of the queries with any of the others leave the range of a long?"""
    bits = lambda a: max(int(a.max(initial=0)), -int(a.min(initial=0))).bit_length()
    return bits(queries) + max(map(bits, others)) + queries.shape[-1].bit_length() > SAFE_BITS


class Tree:
    """A KD-tree whose leaves hold up to ``leaf`` vectors of whole numbers."""

    FIELDS = ("ids", "cells", "low", "high", "span", "children")

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = 64):
        order = np.lexsort((ids,))
        ids, vectors = ids[order], vectors[order]
        low, high, span, children = [], [], [], []
        places = np.arange(len(ids))
        work = [(0, len(ids), -1)]
        while work:  # depth-first, children know their parent
            a, b, parent = work.pop()
            node = len(span)
            if parent >= 0:
                children[parent][children[parent][0] >= 0] = node
            rows = vectors[places[a:b]]
            low.append(rows.min(0))
            high.append(rows.max(0))
            span.append((a, b))
            children.append([-1, -1])
            width = high[-1].astype(np.float64) - low[-1]
            wide = int(width.argmax())
            if b - a > leaf and width[wide] > 0:
                middle = (a + b) // 2
                places[a:b] = places[a:b][np.argpartition(rows[:, wide], middle - a)]
                work += [(middle, b, node), (a, middle, node)]
        self.ids, self.cells = ids[places], vectors[places]
        self.low, self.high = np.array(low), np.array(high)
        self.span, self.children = np.array(span, np.int64), np.array(children, np.int64)

    def stored(self) -> list[bytes]:
        return [getattr(self, x).tobytes() for x in self.FIELDS]

    @classmethod
    def read(cls, length: int, *stored: bytes) -> Tree:
        tree = cls.__new__(cls)
        for x, raw in zip(cls.FIELDS, stored, strict=True):
            flat = np.frombuffer(raw, np.int64)
            setattr(tree, x, flat if x == "ids" else flat.reshape(-1, 2 if x in ("span", "children") else length))
        return tree

    def search(self, query: np.ndarray, own: int, k: int, bound: int, exact: bool = False) -> list[tuple[int, int]]:
        """The k best (score, id), best first; only scores of at least ``bound`` are sure to be found."""
        limit = greatest(self.low, self.high, query, exact)
        heap, best = [(-int(limit[0]), 0)], []  # best: worst first
        while heap:
            top, node = heapq.heappop(heap)
            if -top < bound:
                break
            if self.children[node, 0] >= 0:
                for child in self.children[node].tolist():
                    if limit[child] >= bound:
                        heapq.heappush(heap, (-int(limit[child]), child))
                continue
            a, b = self.span[node]
            score, ids = products(self.cells[a:b], query, exact), self.ids[a:b]
            for i in np.flatnonzero((score >= bound) & (ids != own)).tolist():
                found = (int(score[i]), -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
            if len(best) == k:
                bound = max(bound, best[0][0])
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def greatest(low: np.ndarray, high: np.ndarray, query: np.ndarray, exact: bool = False) -> np.ndarray:
    """The greatest inner product that each box allows."""
    return products(np.where(query >= 0, high, low), query, exact)


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, cells`` (array of long) of the vectors that take part."""
    rows = slim(vectors, "vec_id", "embedding").where("vec_id is not null and embedding is not null and size(embedding) > 0")
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(good).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("cells"))


def splits(sample: list[list[int]], cells: int) -> list[tuple[int, float, int, int]]:
    """The top levels of a KD-tree: (dimension, value, left, right); places below 0 are cells, -1 the first."""
    width = max(map(len, sample), default=1)
    points = np.array([[*map(float, v), *[0.0] * (width - len(v))] for v in sample]).reshape(-1, width)
    nodes: list = []
    count = 0

    def grow(at: np.ndarray, parts: int) -> int:
        nonlocal count
        rows = points[at]
        spread = rows.max(0) - rows.min(0) if len(at) else np.zeros(width)
        wide = int(spread.argmax())
        if parts > 1 and spread[wide] > 0:
            value = float(np.quantile(rows[:, wide], (parts // 2) / parts))
            left = rows[:, wide] <= value
            if left.any() and not left.all():
                node = len(nodes)
                nodes.append(None)
                nodes[node] = (wide, value, grow(at[left], parts // 2), grow(at[~left], parts - parts // 2))
                return node
        count += 1
        return -count

    grow(np.arange(len(points)), cells)
    return nodes


def cell_of(vectors: list[list[int]], nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    """The cell of each vector; a dimension that a vector lacks counts as 0."""
    out = np.zeros(len(vectors), np.int64)
    for k, v in enumerate(vectors):
        at = 0 if nodes else -1
        while at >= 0:
            dimension, value, left, right = nodes[at]
            at = left if (v[dimension] if dimension < len(v) else 0) <= value else right
        out[k] = -at - 1
    return out


BUILT = "shard long, length int, n int, ids binary, cells binary, low binary, high binary, span binary, children binary, asked binary, points binary, bounds binary, q binary, v binary, s binary"
KINDS = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 12]
FOUND = "q binary, v binary, s binary"


def _hits(hits: list[tuple[int, int, int]]) -> list[bytes]:
    return [x.tobytes() for x in np.array(hits, np.int64).reshape(-1, 3).T]


def built(rows: DataFrame, k: int) -> DataFrame:
    """Rows (shard, length, vec_id, cells, ask) as one tree per shard and length, with its own queries' first results."""

    def build(table):
        ids, ask = table.column("vec_id").to_numpy(), table.column("ask").to_numpy(zero_copy_only=False)
        cells = table.column("cells").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        asked, points = ids[ask], cells[ask]
        tree, hits = None, []
        bounds = np.full(len(asked), LEAST)
        if not ask.all():
            tree, exact = Tree(ids[~ask], cells[~ask]), needs_care(points, cells)
            for i, (q, x) in enumerate(zip(asked.tolist(), points, strict=True)):
                found = tree.search(x, q, k, LEAST, exact)
                hits += [(q, v, score) for score, v in found]
                if len(found) == k:
                    bounds[i] = found[-1][0]
        row = [table.column("shard")[0].as_py(), table.column("length")[0].as_py(), int((~ask).sum()), *(tree.stored() if tree else [b""] * 6), asked.tobytes(), points.tobytes(), bounds.tobytes(), *_hits(hits)]
        return pa.table([pa.array([x], t) for x, t in zip(row, KINDS, strict=True)], [x.split()[0] for x in BUILT.split(", ")])

    return rows.groupBy("shard", "length").applyInArrow(build, BUILT)


SENT = "target long, part int, length int, asked binary, points binary, bounds binary"


def sent(trees: DataFrame, groups: int, parts: int) -> DataFrame:
    """The queries of each shard that each other shard has to see, by its root box: ``target, part`` and the queries.

    Boxes travel in groups, so that a row of queries meets many boxes at once and no tree.
    """

    def pack(table):
        ids = table.column("shard").to_numpy()
        low, high = (b"".join(table.column(x).to_pylist()) for x in ("low", "high"))
        return pa.table([table.column("g")[:1], table.column("length")[:1], *(pa.array([x], pa.binary()) for x in (ids.tobytes(), low, high))], ["g", "length", "shards", "b_low", "b_high"])

    group = F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int").alias("g")
    # a node's box comes first in its arrays, so the heads of these are the root box
    roots = trees.where("n > 0").select(group, "length", "shard", *[F.expr(f"substring({x}, 1, 8 * length)").alias(x) for x in ("low", "high")])
    boxes = roots.groupBy("g", "length").applyInArrow(pack, "g int, length int, shards binary, b_low binary, b_high binary")
    asking = trees.where(F.octet_length("asked") > 0).select("shard", "length", "asked", "points", "bounds", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))

    def choose(source):
        for batch in source:
            out = []
            for r in batch.to_pylist():
                read = lambda x, r=r: np.frombuffer(r[x], np.int64)
                asked, points, bounds, shards = read("asked"), read("points").reshape(-1, r["length"]), read("bounds"), read("shards")
                low, high = read("b_low").reshape(len(shards), -1), read("b_high").reshape(len(shards), -1)
                exact = needs_care(points, low, high)
                worth = np.array([greatest(low, high, x, exact) >= b for x, b in zip(points, bounds, strict=True)])
                for j, target in enumerate(shards.tolist()):
                    some = worth[:, j]
                    if target != r["shard"] and some.any():
                        out.append((target, r["shard"] % parts, r["length"], asked[some].tobytes(), points[some].tobytes(), bounds[some].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], [x.split()[0] for x in SENT.split(", ")])

    return asking.join(boxes, ["g", "length"]).mapInArrow(choose, SENT)


def far(queries: DataFrame, trees: DataFrame, parts: int, k: int) -> DataFrame:
    """Search each shard for the queries that were sent to it; each part of the queries is a task's work of its own."""
    stored = trees.where("n > 0").select(F.col("shard").alias("target"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "length", *Tree.FIELDS)

    def search(asked, held):
        hits = []
        if len(asked) and len(held):
            length = held.column("length")[0].as_py()
            tree = Tree.read(length, *(held.column(x)[0].as_py() for x in Tree.FIELDS))
            for q_ids, points, bounds in zip(*(asked.column(x).to_pylist() for x in ("asked", "points", "bounds")), strict=True):
                points = np.frombuffer(points, np.int64).reshape(-1, length)
                exact = needs_care(points, tree.low[:1], tree.high[:1])
                for q, x, bound in zip(np.frombuffer(q_ids, np.int64).tolist(), points, np.frombuffer(bounds, np.int64).tolist(), strict=True):
                    hits += [(q, v, score) for score, v in tree.search(x, q, k, bound, exact)]
        return pa.table([pa.array([x], pa.binary()) for x in _hits(hits)], ["q", "v", "s"])

    key = ["target", "part", "length"]
    return queries.groupBy(*key).cogroup(stored.groupBy(*key)).applyInArrow(search, FOUND)


def _rows(found: DataFrame) -> DataFrame:
    def run(source):
        for batch in source:
            columns = [np.frombuffer(b"".join(batch.column(x).to_pylist()), np.int64) for x in ("q", "v", "s")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_id", "vec_id", "score"])

    return found.select("q", "v", "s").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, shard_rows: int = 2048, query_rows: int = 4096, most_cells: int = 256, sample_rows: int = 8192) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of all other rows for each row whose id ``every`` divides.

    ``sample_rows`` bounds the sample (chosen by a hash of the id) that the cells are fitted on, ``most_cells`` their
    number; a cell takes as many shards of about ``shard_rows`` as its rows need, and every row is in one of them.
    """
    rows = stash(whole_numbers(vectors, scale))
    n = rows.count()
    share = min(1.0, 0.8 * sample_rows / max(n, 1))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) <= share * (1 << 20)).select("cells").limit(sample_rows)
    nodes = splits([r["cells"] for r in sample.collect()], max(1, min(most_cells, -(-n // shard_rows))))
    cells = len(nodes) + 1
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("cells").alias("cells"))
    both = rows.withColumn("ask", F.lit(False)).unionByName(queries.withColumn("ask", F.lit(True)))

    def place(source):
        for batch in source:
            found = cell_of(batch.column("cells").to_pylist(), nodes)
            yield pa.RecordBatch.from_arrays([pa.array(found), *batch.columns], ["cell", *batch.schema.names])

    placed = both.select("vec_id", "cells", "ask").mapInArrow(place, "cell long, vec_id long, cells array<long>, ask boolean")
    held = dict(placed.where("not ask").groupBy("cell").count().collect())  # at most ``most_cells`` rows
    deal = [max(1, -(-held.get(k, 0) // shard_rows)) for k in range(cells)]  # shards of each cell; equal rows are dealt by their ids
    at, parts_of = (F.element_at(F.array(*map(F.lit, x)), F.col("cell").cast("int") + 1) for x in ([sum(deal[:k]) for k in range(cells)], deal))
    sharded = placed.select((at + F.pmod(F.xxhash64("vec_id"), parts_of)).cast("long").alias("shard"), F.size("cells").alias("length"), "vec_id", "cells", "ask")
    trees = stash(built(sharded, k))
    asked = trees.agg(F.sum(F.octet_length("asked"))).first()[0] or 0
    groups, parts = max(1, -(-sum(deal) // 256)), max(1, -(-asked // (8 * query_rows)))
    found = _rows(trees.select("q", "v", "s")).unionByName(_rows(far(sent(trees, groups, parts), trees, parts, k)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
