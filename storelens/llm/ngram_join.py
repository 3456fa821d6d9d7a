"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Columns (n-gram names) are cut into blocks. A block's entries are sorted by numpy, which gives each n-gram's
number of documents; entries of n-grams of one document leave, since they add to no overlap. What is left is
gathered by document: a partner shares at least three quarters of a document's n-grams, so documents with
fewer shared ones leave too. The rest orders its n-grams from rare to common; a pair is an entry of the product that
can reach the similarity only if the two meet in a column from which on each has enough n-grams left, a bound that
follows from the two sizes. For these entries the product is formed: overlap counts are accumulated column block by
column block, and a pair goes as soon as its count and what is left cannot reach the bound.

Documents with equal n-gram sets are one class and one row of the matrix. Large groups of near copies never
meet all in all: each document is first compared with one centre of its columns (the member whose n-grams are
the most common), and pairs are only formed between documents that are not yet connected. ``similar_pairs`` forms
them all, for those who need each link.

No column is gathered that a common passage makes long: an n-gram that many sets of one batch hold is common for
sure, so its entries go straight to their documents, its column gets one mark per batch, and it ranks behind all
counted ones everywhere.

Defined cases: rows without a doc_id are returned, without a component, and compared with nothing; null and blank texts have no n-grams and are linked
with nothing; a text with fewer words than ``n`` is one n-gram; doc_id is the identity of a document: several rows of
one doc_id are returned as they come, and the component is the least doc_id; ties in the order of n-grams go by their
names; extra columns are ignored; an empty table gives no row. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import as_longs, batches, column, discard, mix, slim, stash, text_bytes, window_names, word_names
from .blocks import block_count, block_of, by_block
from .components import components

def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted names of the distinct n-grams of a text's words, A-Z in lower case."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    names = word_names(words)
    if len(words) < n:
        return mix(window_names(names, len(words)) + np.uint64(len(words)))
    return np.unique(window_names(names, n))


def set_key(names: np.ndarray) -> int:
    """A hash of a set of names; never 0 but for the empty set."""
    return int(mix(np.array([mix(names).sum(dtype=np.uint64) + np.uint64(len(names))], np.uint64))[0] | np.uint64(1)) if len(names) else 0


#: Cells of a block: documents (key, size, entries here) with their entries; whole documents at home here; common names.
INCIDENCE = {"keys": "<u8", "sizes": "<i4", "counts": "<i4", "names": "<u8", "df": "<i4", "docs": "<i8", "doc_keys": "<u8", "doc_sizes": "<i4", "common": "<u8"}
ROWS = "block int, " + ", ".join(f"{x} binary" for x in INCIDENCE)
#: The number of documents that stands for "common" in the order of n-grams.
COMMON = np.iinfo(np.int32).max
NONE = np.empty(0, np.uint64)


def _rows(block: np.ndarray, owner: np.ndarray, keys: np.ndarray, sizes: np.ndarray, names: np.ndarray, df: np.ndarray, home: tuple | None = None, common: np.ndarray = NONE, common_block: np.ndarray = NONE) -> list[tuple]:
    """Cells by block of entries that are sorted by owner; ``df`` may be empty, not yet known."""
    order = np.argsort(block, kind="stable")
    block, owner, names, df = block[order], owner[order], names[order], df[order] if len(df) else df
    new = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (owner[1:] != owner[:-1])]) if len(block) else np.empty(0, np.int64)
    counts = np.diff(np.r_[new, len(block)]).astype(np.int32)
    at, who = block[new], owner[new]
    homes = home[0] if home else np.empty(0, np.int32)
    out = []
    ends = np.r_[0, np.cumsum(counts)]
    for b in np.union1d(np.union1d(at, homes), common_block):
        i, j = np.searchsorted(at, b), np.searchsorted(at, b, "right")
        here = [x[homes == b].tobytes() for x in home[1:]] if home else [b""] * 3
        here.append(common[common_block == b].tobytes())
        out.append((int(b), keys[who[i:j]].tobytes(), sizes[who[i:j]].tobytes(), counts[i:j].tobytes(), names[ends[i] : ends[j]].tobytes(), df[ends[i] : ends[j]].tobytes(), *here))
    return out


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), *[pa.binary()] * len(INCIDENCE)]
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["block", *INCIDENCE])


def incidence(docs: DataFrame, n: int, blocks: int, hot: int) -> DataFrame:
    """The matrix in column blocks; behind them, by document, the entries of n-grams that ``hot`` sets of a batch hold."""

    def cut(source):
        for batch in batches(source):
            ids = as_longs(column(batch, "doc_id"))
            sets = [shingles(t, n) for t in column(batch, "text").to_pylist()]
            keys, sizes = np.array([set_key(s) for s in sets], np.uint64), np.array([len(s) for s in sets], np.int32)
            _, once = np.unique(keys, return_index=True)
            once = np.sort(once)
            names = np.concatenate([*[sets[k] for k in once], NONE])
            owner = np.repeat(once, sizes[once])
            home = (block_of(mix(ids.view(np.uint64)), blocks), ids, keys, sizes)
            found, count = np.unique(names, return_counts=True)
            common = found[count >= hot]
            far = np.isin(names, common)
            rows = _rows(block_of(names[~far], blocks), owner[~far], keys, sizes, names[~far], NONE, home, common, block_of(common, blocks))
            if far.any():
                rows += _rows(blocks + block_of(mix(keys[owner[far]]), blocks), owner[far], keys, sizes, names[far], np.full(far.sum(), COMMON, np.int32))
            yield from _table(rows).to_batches()

    return slim(docs, "doc_id", "text").mapInArrow(cut, ROWS)


def shared_entries(buckets: int) -> Callable[[dict], pa.Table]:
    """Solve a column block: entries of n-grams of two or more documents, dealt by document; its documents as block -1."""

    def solve(e: dict) -> pa.Table:
        if e["block"] >= buckets:  # entries that are dealt by document already
            return _table([(e["block"] - buckets, *[e[x].tobytes() for x in INCIDENCE])])
        keys, once = np.unique(e["keys"], return_index=True)
        keep = np.zeros(len(e["keys"]), bool)
        keep[once] = True  # the same set may come from several tasks
        whole = np.repeat(np.searchsorted(keys, e["keys"]), e["counts"])
        inside = np.repeat(keep, e["counts"]) | np.isin(e["names"], e["common"])  # a batch that took a name for common left it out
        names, owner = e["names"][inside], whole[inside]
        order = np.lexsort((owner, names))
        names, owner = names[order], owner[order]
        once = np.r_[True, (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])][: len(names)]
        names, owner = names[once], owner[once]
        new = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else np.empty(0, np.int64)
        count = np.diff(np.r_[new, len(names)])
        df = np.repeat(np.where(np.isin(names[new], e["common"]), COMMON, count), count).astype(np.int32)
        some = np.flatnonzero(df > 1)
        some = some[np.argsort(owner[some], kind="stable")]
        names, owner, df = names[some], owner[some], df[some]
        sizes = np.empty(len(keys), np.int32)
        sizes[np.searchsorted(keys, e["keys"])] = e["sizes"]
        rows = _rows(block_of(mix(keys[owner]), buckets), owner, keys, sizes, names, df)
        return _table([*rows, (-1, *[b""] * 5, e["docs"].tobytes(), e["doc_keys"].tobytes(), e["doc_sizes"].tobytes(), b"")])

    return solve


def least_shared(size, percent: int):
    """The least overlap that a set of this size has with any partner."""
    return -(-size * percent // 100)


DOCUMENT = "key long, size int, prefix int, names binary"


def candidates_of(percent: int) -> Callable[[dict], pa.Table]:
    """Solve a bucket of documents: those that share enough, with their n-grams from rare to common."""

    def solve(e: dict) -> pa.Table:
        key = np.repeat(e["keys"], e["counts"])
        order = np.lexsort((e["names"], e["df"], key))
        key, names = key[order], e["names"][order]
        once = np.r_[True, (key[1:] != key[:-1]) | (names[1:] != names[:-1])][: len(key)]  # a common n-gram may come twice
        key, names = key[once], names[once]
        keys, first, n = np.unique(key, return_index=True, return_counts=True)
        sizes = np.zeros(len(keys), np.int32)
        sizes[np.searchsorted(keys, e["keys"])] = e["sizes"]
        prefix = n - least_shared(sizes.astype(np.int64), percent) + 1
        at = np.flatnonzero(prefix > 0)
        cells = [names[first[k] : first[k] + n[k]].tobytes() for k in at]
        return pa.table([pa.array(keys[at].view(np.int64)), pa.array(sizes[at]), pa.array(prefix[at].astype(np.int32)), pa.array(cells, pa.binary())], ["key", "size", "prefix", "names"])

    return solve


def heads(documents: DataFrame) -> DataFrame:
    """``key, size, n, names``: how many shared n-grams each document has, and those of its prefix."""
    return documents.select("key", "size", F.expr("cast(octet_length(names) / 8 as int)").alias("n"), F.expr("substring(names, 1, 8 * prefix)").alias("names"))


def postings(heads: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``token, key, size, behind, rare, label``: the prefix entries.

    ``behind`` is the number of shared n-grams from this one on, ``rare`` the share of a document's n-grams that
    it shares with none. Labels meet documents, before these become entries, so that a long one is no hot key.
    """

    def run(source):
        for batch in batches(source):
            names = [np.frombuffer(x, np.int64) for x in column(batch, "names").to_pylist()]
            n, size, count = column(batch, "n").to_numpy(), column(batch, "size").to_numpy(), np.array([len(x) for x in names])
            behind = np.concatenate([np.arange(k, k - len(x), -1, np.int32) for x, k in zip(names, n, strict=True)]).astype(np.int32)
            repeat = lambda x: pa.array(np.repeat(x, count))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), repeat(column(batch, "key").to_numpy()), repeat(size), pa.array(behind), repeat(1 - n / size), repeat(column(batch, "label").to_numpy())], ["token", "key", "size", "behind", "rare", "label"])

    known = heads.withColumn("label", F.col("key")) if labels is None else heads.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    return known.select("key", "size", "n", "names", "label").mapInArrow(run, "token long, key long, size int, behind int, rare double, label long")


def similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return (F.least(a, b).cast("long") * 100) >= (F.greatest(a, b).cast("long") * percent)


#: Column blocks of the product of a batch of pairs.
PRODUCT_BLOCKS = 4


def overlaps(a: list[np.ndarray], b: list[np.ndarray], size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Overlaps of the pairs of rows, accumulated over column blocks; -1 where the bound is out of reach."""
    pairs = np.arange(len(a))
    sides = []
    for rows in (a, b):
        names = np.concatenate([*rows, NONE])
        owner = np.repeat(pairs, [len(x) for x in rows])
        sides.append((names, owner, (names >> np.uint64(62)).astype(np.int64)))
    left = [np.array([len(x) for x in rows], np.int64) for rows in (a, b)]
    needed = -(-(size_a.astype(np.int64) + size_b) * percent // (100 + percent))
    count, alive = np.zeros(len(a), np.int64), np.minimum(*left) >= needed
    for block in range(PRODUCT_BLOCKS):
        here = [np.flatnonzero((blocks == block) & alive[owner]) for _, owner, blocks in sides]
        names = np.concatenate([side[0][at] for side, at in zip(sides, here, strict=True)])
        owner = np.concatenate([side[1][at] for side, at in zip(sides, here, strict=True)])
        order = np.lexsort((names, owner))
        names, owner = names[order], owner[order]
        both = np.flatnonzero((names[1:] == names[:-1]) & (owner[1:] == owner[:-1]))
        count += np.bincount(owner[both], minlength=len(a))
        left = [x - np.bincount(side[1][at], minlength=len(a)) for x, side, at in zip(left, sides, here, strict=True)]
        alive &= count + np.minimum(*left) >= needed
    return np.where(alive, count, -1)


def links(pairs: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose overlap reaches the similarity, with it."""
    side = lambda x: documents.select(F.col("key").alias(x), F.col("size").alias(f"size_{x}"), F.col("names").alias(f"names_{x}"))

    def run(source):
        for batch in batches(source):
            rows = [[np.frombuffer(x, np.uint64) for x in column(batch, y).to_pylist()] for y in ("names_a", "names_b")]
            sizes = [column(batch, x).to_numpy().astype(np.int64) for x in ("size_a", "size_b")]
            count = overlaps(*rows, *sizes, percent)
            keep = (count >= 0) & (100 * count >= percent * (sizes[0] + sizes[1] - count))
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b"), pa.array(count)], ["a", "b", "overlap"]).filter(pa.array(keep))

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "size_a", "size_b", "names_a", "names_b").mapInArrow(run, "a long, b long, overlap long")


def centre_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """For each document the centre that most of its columns name, if that is not yet connected with it."""
    centre = posts.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), *[f(F.struct(*x)).alias(k) for k, f, x in (("c0", F.min, ("rare", "key", "size", "label")), ("c1", F.min, ("label", "rare", "key", "size")), ("c2", F.max, ("label", "rare", "key", "size")))]).where("low < high")
    near = posts.join(centre.select("token", F.explode(F.array(*[F.struct(*[F.col(f"{c}.{x}").alias(x) for x in ("key", "size", "label")]) for c in ("c0", "c1", "c2")])).alias("c")), "token")
    near = near.where((F.col("label") != F.col("c.label")) & similar_sizes(F.col("size"), F.col("c.size"), percent))
    votes = near.groupBy("key", F.col("c.key").alias("centre")).count()
    return votes.groupBy("key").agg(F.max(F.struct("count", "centre")).alias("best")).select(F.col("key").alias("a"), F.col("best.centre").alias("b"))


def meetings(posts: DataFrame, percent: int) -> DataFrame:
    """``a, b`` for each column in which two documents not yet connected meet early enough to be linked.

    A link takes an overlap that follows from the two sizes. All common n-grams stand from the first common one
    on, so both documents must have that many shared ones from there on; pairs below the bound are discarded.
    Within a column only the members outside the largest component are paired with the others.
    """
    sums = posts.groupBy("token", "label").count().groupBy("token").agg(F.max(F.struct("count", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").select("token", F.col("top.label").alias("top"))
    mixed = posts.join(sums, "token")
    side = lambda x: [F.col(y).alias(f"{y}_{x}") for y in ("key", "size", "behind", "label")]
    pairs = mixed.where("label <> top").select("token", *side("a")).join(mixed.select("token", "top", *side("b")), "token")
    overlap = F.ceil((F.col("size_a").cast("long") + F.col("size_b")) * percent / (100 + percent))
    once = (F.col("label_b") == F.col("top")) | (F.col("key_a") < F.col("key_b"))
    return pairs.where((F.col("label_a") != F.col("label_b")) & once & (F.least("behind_a", "behind_b") >= overlap)).select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"))


def matrix(docs: DataFrame, n: int, percent: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, key, n_shingles), classes (key, least doc_id), and the rows that may have a partner.

    In the rows a class goes by its least doc_id, so that a component's least node is its least document.
    """
    docs = docs.where(docs["doc_id"].isNotNull())
    blocks = block_count(text_bytes(docs))
    shared = stash(by_block(incidence(docs, n, blocks, hot), INCIDENCE, shared_entries(blocks), ROWS, 2 * blocks, "block"))

    def unpack(source):
        for batch in source:
            cells = [np.frombuffer(b"".join(column(batch, x).to_pylist()), INCIDENCE[x]) for x in ("docs", "doc_keys", "doc_sizes")]
            yield pa.RecordBatch.from_arrays([pa.array(cells[0]), pa.array(cells[1].view(np.int64)), pa.array(cells[2].astype(np.int64))], ["doc_id", "key", "n_shingles"])

    members = stash(shared.where("block < 0").mapInArrow(unpack, "doc_id long, key long, n_shingles long"))
    least = members.where("key <> 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    rows = by_block(shared.where("block >= 0"), INCIDENCE, candidates_of(percent), DOCUMENT, blocks).join(least, "key")
    rows = stash(rows.select(F.col("least").alias("key"), "size", "prefix", "names"))
    discard(shared)
    return members, least, rows


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75, rounds: int = 2, hot: int = 64) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (doc_id, text)."""
    members, least, documents = matrix(docs, n, percent, hot)
    short = stash(heads(documents))
    found, labels = None, None
    for turn in range(rounds + 1):
        posts, before = stash(postings(short, labels)), found
        new = links(centre_pairs(posts, percent) if turn < rounds else meetings(posts, percent).distinct(), documents, percent).select("a", "b")
        found = stash(new if found is None else found.unionByName(new))
        discard(posts, before)
        labels = components(found)
    discard(documents, short, found)
    of_key = least.join(labels.withColumnRenamed("key", "least"), "least", "left").select("key", F.coalesce("label", "least").alias("component"))
    out = members.join(of_key, "key", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.unionByName(unnamed(docs, n))


def unnamed(docs: DataFrame, n: int) -> DataFrame:
    """The result of rows without a doc_id."""

    def run(source):
        for batch in batches(source):
            sizes = [len(shingles(t, n)) for t in column(batch, "text").to_pylist()]
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(sizes, pa.int64()), none], ["doc_id", "n_shingles", "component_id"])

    return slim(docs, "doc_id", "text").where("doc_id is null").mapInArrow(run, "doc_id long, n_shingles long, component_id long")


def similar_pairs(docs: DataFrame, n: int = 5, percent: int = 75, hot: int = 64) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, as ``a, b, overlap`` of the classes' least doc_ids, and the membership
    ``doc_id, class_id`` (null for documents without n-grams). Documents of one class are linked with each other."""
    members, least, documents = matrix(docs, n, percent, hot)
    pairs = links(meetings(postings(heads(documents), None), percent).distinct(), documents, percent)
    return pairs, members.join(least, "key", "left").select("doc_id", F.col("least").alias("class_id"))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, all columns, with the least doc_id of each component only.

    Rows without an id leave. Rows of one doc_id with equal shingle sets count once; with different ones each is a document of its own.
    """
    named = docs.where(docs["doc_id"].isNotNull())
    repeated = named.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        first = near_duplicates(docs, n, percent).where("doc_id = component_id").select("doc_id").distinct()
        kept = named.join(first, "doc_id", "left_semi")
    else:  # rows of a repeated id are told apart by the name of their text; new columns have names that no other has
        node, again = (f"{x} {uuid.uuid4().hex}" for x in ("node", "again"))
        ids = stash(repeated).withColumnRenamed("doc_id", again)
        nodes = named.join(ids, named["doc_id"] == ids[again], "left")
        nodes = stash(nodes.withColumn(node, F.when(F.col(again).isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "text"))).drop(again))
        near = near_duplicates(nodes.select(F.col(node).alias("doc_id"), "text"), n, percent).withColumnRenamed("doc_id", node).distinct()
        near = near.join(nodes.select(node, "doc_id").distinct(), node)
        blank = F.col("n_shingles") == 0  # blank texts of one id have equal sets, those of different ids are not linked
        first = near.groupBy(blank.alias("blank"), F.when(blank, F.col("doc_id")).otherwise(F.col("component_id")).alias("c")).agg(F.min(F.struct("doc_id", node))[node].alias(node))
        kept = nodes.join(first.select(node), node, "left_semi").dropDuplicates([node])
    return kept.select(*docs.columns)
