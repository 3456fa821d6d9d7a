"""Conversation prefix trie: which conversations share how many first turns, and what sharing them would save.

A node is a distinct sequence of first turns. It belongs to its member with the least conv_id, and so does every longer
prefix of that member: each conversation owns a chain of nodes, from its first owned depth to its end (none, if all of
its turns are a smaller conversation's). So the trie is a tree of chains, each hanging at a node of another chain.

1. Turns are numbered and prefixes are digested by running sums of hashes of (depth, turn); sums run within stretches
   of a conversation and over the stretches' totals, so that a very long one is no single task's work.
2. The least conv_id of each prefix digest is a table. A binary search finds each conversation's last depth that a smaller
   one owns, bit by bit from the highest: a round probes one depth of every conversation at once, by a join. A depth
   is probed only in the round of its lowest set bit, so all rounds together read each prefix once at most.
3. A chain's totals (conversations, leaves, code points) are summed bottom-up over the chains below it, with pointers
   that double their reach each round: the rounds grow with the logarithm of the tree's height, not with it.
4. A node's figures are sums over the chains that hang at it or further down its own chain, again by stretches.

Prefixes that very many conversations share are dealt out in each join (see ``skew``). The numbers of the conversations that
end in one node are joined to pieces where they were sorted; then one task feeds the pieces to the node's hash, one batch at a time.

Defined cases: rows without a conv_id take no part; null roles and texts are empty; turns with equal numbers go by role,
then text; equal rows are turns of their own; a conversation may be turnless after the rebuilding; conv_ids may
be negative (their base is the next multiple of 100 towards zero). Extra columns are ignored. An empty table gives no node.
Prefixes are told apart by two 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import column, discard, slim, stash
from .skew import hot_of, salted_join

#: Turns of a stretch, as a power of two.
STRETCH = 12
NEVER = -(1 << 62)


def running(rows: DataFrame, key: str, stretch: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running sums within ``key``: within each stretch, behind the totals of the stretches before."""
    rows = rows.withColumns({"stretch": stretch} | {f"{x} here": value for x, value in sums.items()})
    inside = Window.partitionBy(key, "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    total = rows.groupBy(key, "stretch").agg(*[F.sum(f"{x} here").alias(x) for x in sums])
    carry = total.select(key, "stretch", *[F.sum(x).over(before).alias(f"{x} before") for x in sums]).where(F.col(f"{next(iter(sums))} before").isNotNull())
    rows = rows.withColumns({x: F.sum(f"{x} here").over(inside) for x in sums}).join(carry, [key, "stretch"], "left")
    rows = rows.withColumns({x: F.col(x) + F.coalesce(f"{x} before", F.lit(0)) for x in sums})
    return rows.drop("stretch", *[f"{x} {y}" for x in sums for y in ("here", "before")])


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 1), two hashes of the turn, and its code points."""
    turns = slim(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    turns = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(x, F.lit("")).alias(x) for x in ("role", "text")])
    stretch = F.coalesce(F.shiftright("turn", STRETCH), F.lit(NEVER))
    turns = running(turns, "conv_id", stretch, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], {"pos": F.lit(1).cast("long")})
    return turns.select("conv_id", "pos", *[F.xxhash64(F.lit(k), "role", "text").alias(f"h{k}") for k in (1, 2)], F.char_length("text").cast("long").alias("points"))


def rebuilt(turns: DataFrame, family: int, most: int) -> DataFrame:
    """Conversation c as the first ``crc32(c) % most`` turns of the base of its family, then its own turns behind as many."""
    sizes = stash(turns.groupBy("conv_id").agg(F.count("*").alias("own")))
    hot = hot_of(sizes, ["conv_id"], "own", turns.count())
    base = (F.col("conv_id") - F.col("conv_id") % family).alias("base")
    convs = sizes.select("conv_id", base, (F.crc32(F.col("conv_id").cast("string")) % most).alias("head"))
    known = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = stash(convs.join(known, "base", "left").withColumn("head", F.col("head").cast("long")).withColumn("given", F.least("head", F.coalesce("base_own", F.lit(0)))).drop("base_own"))
    first = turns.where(f"pos < {most} and conv_id % {family} = 0").withColumnRenamed("conv_id", "base").join(convs, "base").where("pos <= head")
    rest = salted_join(turns, convs.drop("base"), ["conv_id"], hot, ["pos"]).where("pos > head")
    fields = ["h1", "h2", "points"]
    return convs, first.select("conv_id", F.col("pos").alias("depth"), *fields).unionByName(rest.select("conv_id", (F.col("given") + F.col("pos") - F.col("head")).alias("depth"), *fields))


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, points, upto`` (code points so far), ``d1, d2`` (the prefix's digest), ``level`` (lowest set bit of the depth)."""
    wide = lambda k: F.xxhash64(F.lit(k), "depth", f"h{k}").cast("decimal(20,0)")
    out = running(turns, "conv_id", F.shiftright("depth", STRETCH), [F.col("depth")], {"d1": wide(1), "d2": wide(2), "upto": F.col("points")})
    level = F.bit_count(F.col("depth").bitwiseAND(-F.col("depth")) - 1)
    return out.select("conv_id", "depth", "points", "upto", *[F.col(x).cast("decimal(38,0)").alias(x) for x in ("d1", "d2")], level.cast("int").alias("level"))


PREFIX = ["depth", "d1", "d2"]


def search(convs: DataFrame, prefix: DataFrame, minima: DataFrame, hot: DataFrame) -> DataFrame:
    """``conv_id, n, upto`` with ``unowned``, the last depth that a smaller conversation owns (0: none), its ``owner`` there, and
    the code points up to there, ``shared``."""
    state = None
    for level in reversed(range(_bits(convs.agg(F.max("n")).first()[0]))):
        enters = convs.where(f"n >= {1 << level} and n < {2 << level}")
        enters = enters.select("conv_id", "n", "upto", F.lit(0).cast("long").alias("unowned"), F.lit(None).cast("long").alias("owner"), F.lit(0).cast("long").alias("shared"))
        last, state = state, enters if state is None else state.unionByName(enters)
        here = prefix.where(F.col("level") == level).select("conv_id", *PREFIX, F.col("upto").alias("upto_here"))
        probe = state.withColumn("depth", F.col("unowned") + (1 << level)).join(here, ["conv_id", "depth"], "left")
        # too short ones ask for nothing, each under a key of its own
        probe = probe.withColumns({"depth": F.when(F.col("d1").isNull(), -F.col("depth")).otherwise(F.col("depth")), "d1": F.coalesce("d1", F.col("conv_id").cast("decimal(38,0)")), "d2": F.coalesce("d2", F.lit(0).cast("decimal(38,0)"))})
        least = minima.where(F.col("level") == level).select(*PREFIX, "least")
        answer = salted_join(probe, least, PREFIX, hot, ["conv_id"], "left")
        theirs = F.col("least") < F.col("conv_id")
        pick = lambda new, old: F.when(theirs, F.col(new)).otherwise(F.col(old)).alias(old)
        state = stash(answer.select("conv_id", "n", "upto", pick("depth", "unowned"), pick("least", "owner"), pick("upto_here", "shared")))
        discard(last)
    none = convs.where("n = 0").select("conv_id", "n", "upto", F.lit(0).cast("long").alias("unowned"), F.lit(None).cast("long").alias("owner"), F.lit(0).cast("long").alias("shared"))
    return none if state is None else state.unionByName(none)


def _bits(n: int | None) -> int:
    return (n or 0).bit_length()


TOTALS = ["convs", "leaves", "ends", "chain"]


def bottom_up(chains: DataFrame) -> DataFrame:
    """Each chain's own figures (TOTALS) plus those of all chains below it. ``chains``: conv_id, parent, and the figures."""
    now = stash(chains.select("conv_id", F.col("parent").alias("above"), *TOTALS))
    while not (low := now.where("above is not null")).isEmpty():
        up = stash(low.groupBy("above").agg(F.count("*").alias("n"), *[F.sum(x).alias(f"more_{x}") for x in TOTALS]))
        hot = hot_of(up, ["above"], "n", low.count())
        next_of = now.select(F.col("conv_id").alias("above"), F.col("above").alias("next"))
        far = salted_join(low, next_of, ["above"], hot, ["conv_id"]).select("conv_id", F.col("next").alias("above"), *TOTALS)
        far = far.unionByName(now.where("above is null"))
        summed = far.join(up.drop("n").withColumnRenamed("above", "conv_id"), "conv_id", "left")
        last, now = now, stash(summed.select("conv_id", "above", *[(F.col(x) + F.coalesce(f"more_{x}", F.lit(0))).alias(x) for x in TOTALS]))
        discard(last, up)
    return now.drop("above")


ENDS = "owner long, depth long, first long, piece string"


def end_digests(ends: DataFrame, most: int = 1 << 16) -> DataFrame:
    """SHA-256 of the conv_ids of each (owner, depth), ascending, joined by commas: ``owner, depth, digest``."""

    def pieces(source):
        """Neighbours of one node joined, up to ``most`` conv_ids at once."""
        node, ids = None, []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*node, ids[0])] + [pa.array([",".join(map(str, ids))])], ["owner", "depth", "first", "piece"])

        for batch in source:
            for owner, depth, conv in zip(*(column(batch, x).to_pylist() for x in ("owner", "depth", "conv_id")), strict=True):
                if ids and ((owner, depth) != node or len(ids) >= most):
                    yield row()
                    ids = []
                node = (owner, depth)
                ids.append(conv)
        if ids:
            yield row()

    def digest(source):
        node, state = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([state.hexdigest()])], ["owner", "depth", "digest"])

        for batch in source:
            for owner, depth, piece in zip(*(column(batch, x).to_pylist() for x in ("owner", "depth", "piece")), strict=True):
                if (owner, depth) == node:
                    state.update(b",")
                else:
                    if state:
                        yield row()
                    node, state = (owner, depth), hashlib.sha256()
                state.update(piece.encode())
        if state:
            yield row()

    ranged = ends.repartitionByRange("owner", "depth", "conv_id").sortWithinPartitions("owner", "depth", "conv_id").mapInArrow(pieces, ENDS)
    return ranged.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first").mapInArrow(digest, "owner long, depth long, digest string")


def trie(conversations: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node of the
    rebuilt ``conversations`` (conv_id, turn, role, text)."""
    convs, turns = rebuilt(stash(numbered(conversations)), family, most)
    prefix = stash(prefixes(turns), "level")
    size = prefix.groupBy("conv_id").agg(F.max("depth").alias("n"), F.max("upto").alias("upto"))
    convs = stash(convs.select("conv_id").join(size, "conv_id", "left").fillna(0, ["n", "upto"]))
    root = convs.agg(F.min("conv_id")).first()[0]
    total = prefix.count()
    minima = stash(prefix.groupBy("level", *PREFIX).agg(F.min("conv_id").alias("least"), F.count("*").alias("n")).where("n > 1"), "level")
    found = search(convs, prefix, minima, hot_of(minima, PREFIX, "n", total))

    is_root = F.col("conv_id") == F.lit(root)
    found = found.withColumn("parent", F.when(~is_root, F.coalesce("owner", F.lit(root)))).drop("owner").withColumn("owns", is_root | (F.col("n") > F.col("unowned")))
    found = stash(found)
    hangs = found.where("parent is not null")
    grows = hangs.where("owns").groupBy(F.col("parent").alias("conv_id"), F.col("unowned").alias("n")).agg(F.count("*").alias("kids"))
    own = found.join(grows, ["conv_id", "n"], "left").withColumn("leaf", (F.col("owns") & F.col("kids").isNull()).cast("long"))
    chains = stash(own.select("conv_id", "n", "unowned", "parent", "owns", "leaf", F.lit(1).cast("long").alias("convs"), F.col("leaf").alias("leaves"), F.col("upto").alias("ends"), (F.col("upto") - F.col("shared")).alias("chain")))
    totals = bottom_up(chains)

    below = chains.where("parent is not null").select("conv_id", "parent", "unowned", "owns").join(totals, "conv_id")
    below = below.groupBy(F.col("parent").alias("conv_id"), F.col("unowned").alias("depth")).agg(F.count_if("owns").alias("kids"), *[F.sum(x).alias(f"below_{x}") for x in TOTALS])
    twins = stash(chains.where("not owns").select(F.col("parent").alias("owner"), F.col("unowned").alias("depth"), "conv_id"))
    firsts = chains.where("owns").select(F.col("conv_id").alias("owner"), F.col("n").alias("depth"), "conv_id")
    many = end_digests(twins.unionByName(firsts.join(twins.select("owner", "depth").distinct(), ["owner", "depth"], "left_semi")))

    chain = chains.select("conv_id", "n", "unowned", "parent", "leaf", F.col("ends").alias("all_points"))
    sizes = convs.select("conv_id", "n")
    nodes = salted_join(prefix.select("conv_id", "depth", (F.col("upto") - F.col("points")).alias("before")), chain, ["conv_id"], hot_of(sizes, ["conv_id"], "n", total), ["depth"]).where("depth > unowned")
    top = chain.where(is_root).select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("before"), "n", "unowned", "parent", "leaf", "all_points")
    nodes = nodes.unionByName(top).join(below, ["conv_id", "depth"], "left").fillna(0, ["kids", *[f"below_{x}" for x in TOTALS]])
    nodes = running(nodes, "conv_id", -F.shiftright("depth", STRETCH), [F.col("depth").desc()], {f"sum_{x}": F.col(f"below_{x}") for x in TOTALS})
    nodes = nodes.join(many.withColumnRenamed("owner", "conv_id"), ["conv_id", "depth"], "left")
    members = F.col("sum_convs") + 1
    saved = F.col("all_points") + F.col("sum_ends") - members * F.col("before") - (F.col("all_points") - F.col("before") + F.col("sum_chain"))
    return nodes.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.when(F.col("depth") > F.col("unowned") + 1, F.col("conv_id")).otherwise(F.coalesce("parent", "conv_id"))).alias("parent_conv_id"),
        members.alias("n_convs"),
        (F.col("kids") + (F.col("depth") < F.col("n")).cast("long")).alias("n_children"),
        (F.col("leaf") + F.col("sum_leaves")).alias("n_leaves"),
        saved.alias("saved_tokens"),
        F.coalesce("digest", F.sha2(F.when(F.col("depth") == F.col("n"), F.col("conv_id").cast("string")).otherwise(""), 256)).alias("ends_sha256"),
    )


ORACLE_SQL = """
WITH turn_of AS (
  SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(x ORDER BY pos) AS s,
    xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, b: CASE WHEN b < 0 THEN xor(a >> 1, 3988292384 * (a & 1)) ELSE xor(a, b) END)) % 6 AS h
  FROM turn_of GROUP BY conv_id),
rebuilt AS (
  SELECT own.conv_id, list_concat(coalesce(base.s[1:own.h], []), own.s[own.h + 1:]) AS s
  FROM own LEFT JOIN own base ON base.conv_id = own.conv_id - own.conv_id % 100),
prefix AS (SELECT conv_id, len(s) AS n, d, s[1:d] AS p FROM rebuilt, LATERAL (SELECT unnest(range(0, len(s) + 1)) AS d)),
node AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(length(p[d].t), 0) AS points, list(conv_id ORDER BY conv_id) FILTER (n = d) AS ends
  FROM prefix GROUP BY p, d),
child AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
known AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (p, d)),
up AS (SELECT p[1:a] AS p, a AS d, n_children = 0 AS leaf, (n_convs - 1) * points AS saved FROM known, LATERAL (SELECT unnest(range(0, d + 1)) AS a)),
summed AS (SELECT p, d, sum(leaf::INTEGER) AS n_leaves, sum(saved) AS saved FROM up GROUP BY p, d)
SELECT known.conv_id, known.d AS depth, parent.conv_id AS parent_conv_id, known.n_convs, known.n_children,
  n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(array_to_string(known.ends, ','), '')) AS ends_sha256
FROM known JOIN summed USING (p, d) LEFT JOIN node parent ON parent.d = known.d - 1 AND parent.p = known.p[1:known.d - 1]
"""
