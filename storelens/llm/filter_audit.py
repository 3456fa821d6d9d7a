"""Filter interaction audit: what each filter removes in every order of the filters.

The orders form a permutation trie. It is walked depth first: a node's survivors are a persisted DataFrame, an edge
applies one more filter to them and counts what it really removes. The survivors depend only on the set of filters that
were applied, so nodes that agree in it are one state, visited once (5 filters: 325 nodes, 32 states, 80 edges).
A state's survivors are given up as soon as the states below it are done, so no more of them are held than there are
filters. The counts of a state go to a table in the shared folder; the driver sees no count.

Before the walk one pass over the texts notes which filters a document fails; the survivors are rows of these notes.
Whether a text stands under a smaller doc_id is settled by its digest: the least doc_id by digest, joined back with
digests of many copies dealt out.

Defined cases: a null text is empty, a null source the empty string; an empty text has no words (it fails A only, and E
if a smaller doc_id is empty too). A document without a doc_id is compared with no other and has no label. Rows of one
doc_id and one text are not copies of each other. Of several labels of a document one is enough to make it good or toxic;
labels without a doc_id are ignored. An empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import shared_dir, slim, stash
from .skew import hot_keys, hot_of, salted_join

SPACE = r"[\x20\x09-\x0D]+"


def failures(text: Column, words: Column) -> dict[str, Column]:
    """The filters that look at one document, by letter: true where it fails."""
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        "C": F.char_length(F.regexp_replace(text, "[^A-Z]", "")).cast("long") * 100 > F.char_length(text).cast("long") * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def copies(noted: DataFrame) -> DataFrame:
    """``noted`` (doc_id, digest, ...) with ``E``: a smaller doc_id has the same digest."""
    first = stash(noted.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1"))
    hot = hot_of(first, ["digest"], "n", noted.count())
    joined = salted_join(noted, first.select("digest", "least"), ["digest"], hot, ["doc_id"], "left")
    return joined.withColumn("E", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).drop("digest", "least")


def labelled(noted: DataFrame, labels: DataFrame) -> DataFrame:
    """``noted`` (doc_id, ...) with ``good`` and ``toxic``."""
    marks = slim(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id")
    marks = marks.agg(*[F.coalesce(F.max(F.col(x) == 1), F.lit(False)).alias(y) for x, y in (("quality", "good"), ("toxic", "toxic"))])
    named = noted.where("doc_id is not null")
    joined = salted_join(named, marks, ["doc_id"], hot_keys(named, ["doc_id"]), list(named.columns), "left")
    return joined.unionByName(noted.where("doc_id is null"), allowMissingColumns=True).fillna(False, ["good", "toxic"])


def note(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, part, good, toxic`` and a boolean by filter, for every row of ``docs`` (doc_id, text, source)."""
    texts = docs.select(docs["doc_id"], F.coalesce(docs["source"], F.lit("")).alias("part"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    texts = texts.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    judged = [fails.alias(x) for x, fails in failures(F.col("text"), F.col("words")).items()]
    noted = stash(texts.select("doc_id", "part", *judged, F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("digest")))
    return stash(labelled(stash(copies(noted)), labels))


def states(noted: DataFrame, filters: str) -> DataFrame:
    """``part, before, kept`` and ``removed_F, good_F, toxic_F`` for every filter F, by state: the letters of ``before``, sorted,
    were applied. A part without survivors has no row."""
    path = f"{shared_dir(noted.sparkSession)}/{uuid.uuid4().hex}"
    seen: set[str] = set()

    def counts(survivors: DataFrame, before: str) -> DataFrame:
        out = [F.lit(before).alias("before"), F.count("*").alias("kept")]
        for x in filters:
            for name, which in (("removed", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic"))):
                out.append((F.lit(0).cast("long") if x in before else F.count_if(F.col(x) & which)).alias(f"{name}_{x}"))
        return survivors.groupBy("part").agg(*out[1:]).select("part", out[0], *[c for c in _names(filters)])

    def visit(survivors: DataFrame, before: str) -> None:
        seen.add(before)
        counts(survivors, before).coalesce(1 if not before else 8).write.mode("append").parquet(path)
        for x in filters:
            after = "".join(sorted({*before, x}))
            if x not in before and after not in seen and len(after) < len(filters):
                left = survivors.where(~F.col(x)).persist(StorageLevel.MEMORY_AND_DISK)
                visit(left, after)
                left.unpersist()

    top = noted.select("part", "good", "toxic", *filters).persist(StorageLevel.MEMORY_AND_DISK)
    visit(top, "")
    top.unpersist()
    return noted.sparkSession.read.parquet(path)


def _names(filters: str) -> list[str]:
    return ["kept", *[f"{name}_{x}" for x in filters for name in ("removed", "good", "toxic")]]


def edges(counted: DataFrame, filters: str) -> DataFrame:
    """``part, before, filter, kept, removed, good_lost, toxic_lost`` of every edge of every part, zeros included."""
    befores = sorted({"".join(sorted(p)) for n in range(len(filters)) for p in permutations(filters, n)})
    parts = counted.where("before = ''").select("part", F.explode(F.array(*map(F.lit, befores))).alias("before"))
    grid = parts.join(counted, ["part", "before"], "left").fillna(0, _names(filters))
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("filter"), *[F.col(f"{old}_{x}").alias(new) for old, new in (("removed", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))]) for x in filters]))
    out = grid.select("part", "before", "kept", each.alias("e")).where(~F.col("before").contains(F.col("e.filter")))
    return out.select("part", "before", "e.filter", (F.col("kept") - F.col("e.removed")).alias("kept"), "e.removed", "e.good_lost", "e.toxic_lost")


def audit(docs: DataFrame, labels: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``: one row per
    part, order of the filters and step in it."""
    edge = stash(edges(states(note(docs, labels), filters), filters))
    last, size = len(filters) - 1, F.char_length("before")
    orders = F.element_at(F.create_map(*[F.lit(x) for n in range(last + 1) for x in (n, factorial(n) * factorial(last - n))]), size)
    total = edge.groupBy("part", "filter").agg(
        F.sum(F.when(size == 0, F.col("removed"))).alias("failing"),
        F.sum(F.when(size == last, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * orders).alias("shapley"),  # so many orders lead over the edge
    )
    spark = docs.sparkSession
    paths = [("".join(p), k + 1, "".join(sorted(p[:k])), p[k]) for p in permutations(filters) for k in range(len(filters))]
    steps = F.broadcast(spark.createDataFrame(paths, "filter_order string, step int, before string, filter string"))  # as many rows as the filters alone say
    out = edge.join(total, ["part", "filter"]).join(steps, ["before", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


ORACLE_SQL = r"""
WITH doc AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
label AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
noted AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
     coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM doc LEFT JOIN label USING (doc_id)),
kind AS (SELECT part, good, toxic, fails, count(*) AS n FROM noted GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
perm AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
gone AS (
  SELECT kind.*, o, list_min(list_transform(['A', 'B', 'C', 'D', 'E'], lambda x, i: CASE WHEN fails[i] THEN instr(o, x) ELSE 9 END)) AS first
  FROM kind, perm),
step AS (
  SELECT part, o, s, substr(o, s, 1) AS f,
    sum(CASE WHEN first > s THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN first = s THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN first < s AND fails[ascii(substr(o, s, 1)) - 64] THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails[ascii(substr(o, s, 1)) - 64] AND len(list_filter(fails, lambda y: y)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN first = s AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN first = s AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM gone, (SELECT unnest(range(1, 6)) AS s) GROUP BY part, o, s)
SELECT part, o AS filter_order, s::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM step
"""
