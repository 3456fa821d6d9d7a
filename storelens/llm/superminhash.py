"""MinHash near-dedup by SuperMinHash signatures.

A signature has ``places`` values. Every n-gram of a document visits all places in an order of its own, a random permutation,
and offers at its j-th stop a value between j and j + 1; a place keeps the least offer. So the n-grams of a small set cannot
crowd at the same places, which gives estimates of less variance than independent ranks. An offer of stop j never beats one of
an earlier stop: when all places of a document are taken, the rest of its stops is not worked out (early stopping). A batch
of documents makes each stop together, as numpy arrays; permutations are short keyed bijections, so none is stored.

1. Documents with equal n-gram sets are one class, with one signature, cut into bands of ``rows`` values.
2. Classes that share a band are candidates: a pair at the similarity of 0.8 misses all 32 bands of 4 once in 20 million times.
3. Candidates are verified on their full sets. A class is first compared with one centre of its bands, twice: the class that
   shares its bands with the most others. Near copies whose edits differ are similar to the centre, but often not to each
   other, though they share bands; so those that are not connected yet are not paired by bands, thousands with thousands, but
   where two of them meet in n-grams that are rare among the candidates, early enough for a link (the size bounds of
   ``ngram_join``; a link always meets there).
4. Verified links are grouped: union-find within each batch of links, whose forests are merged by large-star / small-star.

Bands, centres and copies that very many rows name are dealt out in each join (see ``skew``).

Defined cases: a null or blank text has no n-grams and is linked with nothing; one with fewer words than ``n`` is one n-gram;
rows without a doc_id are returned, without a component, kept and compared with nothing; doc_id is a document's identity:
several rows of one doc_id are returned as they come, each with its own number of n-grams, and links of any of them count.
Ties between components go to the least doc_id; extra columns are ignored; an empty table gives no row.
Sets and n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import MULTIPLIER, as_longs, batches, column, discard, mix, slim, stash
from .components import components
from .ngram_join import heads, matrix, meetings, overlaps, postings, set_key, shingles, similar_sizes
from .skew import hot_keys, hot_of, salted_join

PLACES, ROWS = 128, 4
UNTAKEN = np.uint64(0xFFFFFFFFFFFFFFFF)


def stop_places(keys: np.ndarray, stop: int, places: int) -> np.ndarray:
    """Where each n-gram is at a stop: a bijection of the places, from bits of its key. ``places`` is a power of two up to 256."""
    bits = keys.view(np.uint8).reshape(-1, 8)
    low = np.uint8(places - 1)
    half = np.uint8(max(1, (places.bit_length() - 1) // 2))
    x = np.full(len(keys), stop, np.uint8)
    for k in (0, 2, 4, 6):
        x = (x * (bits[:, k] | np.uint8(1)) + bits[:, k + 1]) & low
        x ^= x >> half
    return x.astype(np.int64)


def signatures(names: np.ndarray, owner: np.ndarray, count: int, places: int = PLACES) -> np.ndarray:
    """One row of ``places`` values for each of ``count`` documents, whose distinct n-grams are ``names`` with their ``owner``.

    Documents without n-grams keep the value of untaken places.
    """
    values, free = np.full(count * places, UNTAKEN), np.full(count, places)
    keys = mix(names ^ MULTIPLIER)
    for stop in range(places):
        if stop:
            on = free[owner] > 0
            names, owner, keys = names[on], owner[on], keys[on]
        if not len(names):
            break
        at = owner * places + stop_places(keys, stop, places)
        offers = np.flatnonzero(values[at] == UNTAKEN)  # taken at an earlier stop: nothing to win
        at = at[offers]
        offer = mix(names[offers] + np.uint64((stop + 1) * int(MULTIPLIER) % (1 << 64))) & ~np.uint64(1)
        np.minimum.at(values, at, offer)
        free -= np.bincount(np.unique(at) // places, minlength=count)
    return values.reshape(count, places)


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """64-bit names of the bands of each signature; the band's number is part of its name."""
    count, places = signature.shape
    cells = mix(signature + np.arange(places, dtype=np.uint64) * MULTIPLIER)
    return mix(cells.reshape(count, places // rows, rows).sum(2, dtype=np.uint64))


def members(docs: DataFrame, n: int, places: int, rows: int) -> DataFrame:
    """``doc_id, key`` (0: no n-gram), ``n_shingles``, ``bands`` (binary; null for copies of the same batch)."""

    def run(source):
        for batch in batches(source, 2 << 20):
            sets = [shingles(t, n) for t in column(batch, "text").to_pylist()]
            keys, sizes = np.array([set_key(s) for s in sets], np.uint64), np.array([len(s) for s in sets], np.int64)
            _, once = np.unique(keys, return_index=True)
            once = once[sizes[once] > 0]
            names = np.concatenate([*[sets[k] for k in once], np.empty(0, np.uint64)])
            found = bands(signatures(names, np.repeat(np.arange(len(once)), sizes[once]), len(once), places), rows)
            cells: list[bytes | None] = [None] * len(sets)
            for k, x in zip(once.tolist(), found, strict=True):
                cells[k] = x.tobytes()
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(keys.view(np.int64)), pa.array(sizes), pa.array(cells, pa.binary())], ["doc_id", "key", "n_shingles", "bands"])

    return slim(docs, "doc_id", "text").mapInArrow(run, "doc_id long, key long, n_shingles long, bands binary")


def entries(classes: DataFrame) -> DataFrame:
    """``band, node, size``: one row for each band of each class."""

    def run(source):
        for batch in batches(source):
            names = [np.frombuffer(x, np.int64) for x in column(batch, "bands").to_pylist()]
            count = [len(x) for x in names]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), *[pa.array(np.repeat(as_longs(column(batch, x)), count)) for x in ("node", "size")]], ["band", "node", "size"])

    return classes.select("node", "size", "bands").mapInArrow(run, "band long, node long, size long")


def shared_bands(classes: DataFrame) -> DataFrame:
    """The entries of bands that two or more classes have, with the number of these, ``n``."""
    posts = entries(classes)
    shared = stash(posts.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    hot = hot_of(shared, ["band"], "n", classes.count())  # a class has a band once
    return stash(salted_join(posts, shared, ["band"], hot, ["node"]))


def candidates(docs: DataFrame, shared: DataFrame, n: int, percent: int, hot: int) -> DataFrame:
    """``key, size, prefix, names`` of the classes with a band in common: their n-grams from rare to common, as in ``ngram_join``."""
    nodes = shared.select(F.col("node").alias("doc_id")).distinct()
    texts = stash(slim(docs, "doc_id", "text").join(nodes, "doc_id", "left_semi"))
    documents = matrix(texts, n, percent, hot)[2]
    discard(texts)
    return documents


def verified(pairs: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""

    def run(source):
        for batch in batches(source):
            rows = [[np.frombuffer(x, np.uint64) for x in column(batch, f"names_{y}").to_pylist()] for y in "ab"]
            sizes = [as_longs(column(batch, f"size_{y}")) for y in "ab"]
            both = overlaps(*rows, *sizes, percent)
            keep = (both >= 0) & (100 * both >= percent * (sizes[0] + sizes[1] - both))
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], ["a", "b"]).filter(pa.array(keep))

    hot = {side: hot_keys(pairs, [side]) for side in "ab"}
    for side, other in ("ab", "ba"):
        names = documents.select(F.col("key").alias(side), F.col("size").alias(f"size_{side}"), F.col("names").alias(f"names_{side}"))
        pairs = salted_join(pairs, names, [side], hot[side], [other])
    return pairs.mapInArrow(run, "a long, b long")


def centre_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """For each class the centre that most of its bands name, if the two are not connected yet."""
    ways = {"c0": (F.max, "fame"), "c1": (F.min, "label"), "c2": (F.max, "label")}
    centre = posts.groupBy("band").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), *[f(F.struct(F.col(x).alias("by"), "node", "size", "label")).alias(k) for k, (f, x) in ways.items()]).where("low < high")
    centre = stash(centre.select("band", "n", F.array(*[F.struct(*[F.col(f"{c}.{x}").alias(x) for x in ("node", "size", "label")]) for c in ways]).alias("centres")))
    near = salted_join(posts, centre.drop("n"), ["band"], hot_of(centre, ["band"], "n", posts.count()), ["node"])
    near = near.withColumn("c", F.explode("centres")).where((F.col("label") != F.col("c.label")) & similar_sizes(F.col("size"), F.col("c.size"), percent))
    votes = near.groupBy("node", F.col("c.node").alias("centre")).count()
    return votes.groupBy("node").agg(F.max(F.struct("count", "centre")).alias("best")).select(F.col("node").alias("a"), F.col("best.centre").alias("b"))


def forests(links: DataFrame) -> DataFrame:
    """Links with the same components, by union-find within each batch: from a node to the least one of its tree."""

    def run(source):
        for batch in source:
            root: dict[int, int] = {}

            def find(x):
                while (up := root.setdefault(x, x)) != x:
                    root[x] = x = root[up]
                return x

            for a, b in zip(column(batch, "a").to_pylist(), column(batch, "b").to_pylist(), strict=True):
                low, high = sorted((find(a), find(b)))
                root[high] = low
            out = [(x, find(x)) for x in list(root)]
            out = [x for x in out if x[0] != x[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return links.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 4, percent: int = 80, places: int = PLACES, rows: int = ROWS, rounds: int = 2, hot: int = 64) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text)."""
    rows_of = stash(members(docs, n, places, rows))
    named = rows_of.where("key <> 0 and doc_id is not null")
    classes = stash(named.groupBy("key").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("size"), F.max("bands").alias("bands"), F.count("*").alias("n")))
    shared = shared_bands(classes)
    documents = candidates(docs, shared, n, percent, hot)
    fame = shared.groupBy("node").agg(F.sum("n").alias("fame")).join(documents.select(F.col("key").alias("node")).distinct(), "node", "left_semi")
    famous = stash(shared.drop("n").join(fame, "node"))
    short = stash(heads(documents))
    found, labels = None, None
    for turn in range(rounds + 1):
        if turn < rounds:
            posts = stash(famous.withColumn("label", F.col("node")) if labels is None else famous.join(labels.withColumnRenamed("key", "node"), "node", "left").withColumn("label", F.coalesce("label", "node")))
            pairs = centre_pairs(posts, percent)
        else:
            posts = stash(postings(short, labels))
            pairs = meetings(posts, percent).distinct()
        pairs = stash(pairs)
        new = forests(verified(pairs, documents, percent))
        last, found = found, stash(new if found is None else found.unionByName(new))
        discard(pairs, last, posts)
        labels = components(found)
    discard(documents, shared, famous, short, found)
    component = classes.select("key", "node").join(labels.withColumnRenamed("key", "node"), "node", "left").select("key", F.coalesce("label", "node").alias("component_id"))
    out = salted_join(named.select("doc_id", "key", "n_shingles"), component, ["key"], hot_of(classes, ["key"], "n", named.count()), ["doc_id"])
    alone = rows_of.where("key = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = out.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
