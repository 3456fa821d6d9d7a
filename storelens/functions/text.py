"""Text, time and histogram functions of the records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .variant import array_path, items, let, numbers_only, path, text_only, to_long

# Heads of package names, and the spellings of a line break.
PREFIXES = ("com", "org", "io", "me", "net", "app", "dev")
LINE_BREAKS = ("<br>", "<br/>", "<br />")
#: The first and last millisecond of the years 1 to 9999.
YEARS = (-62_135_596_800_000, 253_402_300_799_999)


def strip_html(html: Column) -> Column:
    """Line breaks become line feeds, other tags go; entities stay."""
    lines = reduce(lambda c, tag: F.replace(c, F.lit(tag), F.lit("\n")), LINE_BREAKS, html)
    return F.regexp_replace(lines, "<[^>]*>", "")


def timestamp(v: Column) -> Column:
    """[seconds, parts]: the first three characters of the parts' whole number count as milliseconds.

    Times outside the years 1 to 9999 are NULL.
    """
    return let(numbers_only(v, (0,), (1,)), lambda n: moment(F.get(n, F.lit(0)), F.get(n, F.lit(1))))


def moment(seconds: Column, parts: Column) -> Column:
    extra = F.coalesce(F.left(parts.cast("string"), F.lit(3)).try_cast("bigint"), F.lit(0))
    return let(F.try_add(F.try_multiply(seconds, F.lit(1000)), extra), lambda t: F.when(t.between(*YEARS), F.timestamp_millis(t)))


def histogram(v: Column) -> Column:
    """Counts of 1 to 5 stars; the payload starts with 5 stars."""
    count = lambda cell: let(items(cell), lambda pair: F.when(F.size(pair) > 1, to_long(F.get(pair, F.lit(1)))))
    slots = lambda cells: F.transform(F.array(*map(F.lit, (4, 3, 2, 1, 0))), lambda i: F.coalesce(count(F.get(cells, i)), F.lit(0).cast("long")))
    return let(items(v), slots)


def screenshots(v: Column) -> Column:
    return F.coalesce(F.filter(F.transform(items(v), lambda x: text_only(array_path(x, 3, 2))), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def has_package_prefix(app_id: Column) -> Column:
    return let(app_id, lambda x: F.substring_index(x, ".", 1).isin(*PREFIXES) & (F.length(x) > F.length(F.substring_index(x, ".", 1)) + 1))


def has_app_id_pattern(v: Column) -> Column:
    """Does any of the usual places of an app row hold a package name?"""
    ids = F.array(*[text_only(path(v, *p)) for p in ((0, 0), (0, 0, 0), (0, 0, 0, 0), (12, 0))])
    return F.coalesce(F.exists(ids, lambda x: x.isNotNull() & (F.length(x) > 3) & has_package_prefix(x)), F.lit(False))


def escape(text: Column) -> Column:
    """Query escaping: ~ stays, * is escaped."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def first_app_array(data: Column) -> Column:
    """Depth-first through arrays, objects left out: the first array with a child that looks like an app; NULL for none.

    The work list is folded over as many steps as the document can have arrays; a step takes its first array, and is the last
    if that has such a child, or puts its arrays in front. It stays within the JVM, row by row.
    """
    none = F.array().cast("array<variant>")
    text = F.to_json(data)
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - F.length(F.replace(text, F.lit("["), F.lit("")))))

    def step(state: Column, _: Column) -> Column:
        def visit(children: Column) -> Column:
            arrays = F.filter(children, lambda x: items(x).isNotNull())
            rest = F.slice(state["work"], F.lit(2), F.size(state["work"]))
            hit = F.exists(arrays, has_app_id_pattern)
            found = F.struct(none.alias("work"), F.get(state["work"], F.lit(0)).alias("found"))
            return F.when(hit, found).otherwise(F.struct(F.concat(arrays, rest).alias("work"), state["found"].alias("found")))

        return F.when(F.size(state["work"]) == 0, state).otherwise(let(F.coalesce(items(F.get(state["work"], F.lit(0))), none), visit))

    start = F.struct(F.when(items(data).isNotNull(), F.array(data)).otherwise(none).alias("work"), F.lit(None).cast("variant").alias("found"))
    return F.aggregate(F.coalesce(steps, F.array().cast("array<int>")), start, step, lambda state: state["found"])
