"""Payload envelopes: data blocks embedded in pages, and responses that carry JSON within JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .variant import is_string, items, let, strict

#: Fixed by the payload format: a block's key and its data.
BLOCK = r"AF_initDataCallback\(\{key:\s*'(ds:\d+)'.*?data:(.*?), sideChannel:"
BEFORE, BEHIND = "data:", ", sideChannel:"
BLANK = "\t\n\x0b\f\r \x85\xa0                　"


def blocks(body: Column) -> Column:
    """All blocks of a page as texts, by one pass over it. (?d): only a line feed ends a line."""
    return F.regexp_extract_all(body, F.lit(f"(?d){BLOCK}"), F.lit(0))


def _key(block: Column) -> Column:
    return F.split_part(block, F.lit("'"), F.lit(2))


def _data(block: Column) -> Column:
    start = F.instr(block, BEFORE) + len(BEFORE)
    return F.substring(block, start, F.length(block) - len(BEHIND) - start + 1)


def block_of(found: Column, key: str) -> Column:
    """Of ``blocks`` the last well-formed one of this key; NULL if there is none. Other blocks are not parsed."""
    parsed = F.transform(F.filter(found, lambda b: _key(b) == key), lambda b: strict(F.btrim(_data(b), F.lit(BLANK))))
    return F.try_element_at(F.filter(parsed, lambda v: v.isNotNull()), F.lit(-1))


def block(body: Column, key: str) -> Column:
    return block_of(blocks(body), key)


def block_keys(body: Column) -> Column:
    return F.transform(blocks(body), _key)


def unprefixed(body: Column) -> Column:
    """What follows the first line; the whole body if it has no line end."""
    at = F.instr(body, "\n")
    return F.when(at > 0, F.substring(body, at + 1, F.length(body))).otherwise(body)


def envelope(body: Column, tolerant: bool) -> Column:
    """A struct (status, error, data) of a response.

    status is ok, empty or error. A body that is not an array of arrays, or whose inner document is malformed,
    is an error; a short envelope or one without an inner text is an error too, unless ``tolerant``, then empty.
    """

    def result(status: str, error: str | None, value: Column | None = None) -> Column:
        value = F.lit(None).cast("variant") if value is None else value
        return F.struct(F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"), value.alias("data"))

    lacking = result("empty", None) if tolerant else result("error", "invalid response structure")

    def of_data(data: Column) -> Column:
        return F.when(items(data).isNull(), result("error", "malformed data")).otherwise(result("ok", None, data))

    def of_inner(inner: Column) -> Column:
        text = let(strict(F.try_variant_get(inner, "$", "string")), of_data)
        return F.when(F.coalesce(is_string(inner), F.lit(False)), text).otherwise(lacking)

    def of_outer(outer: Column) -> Column:
        rows = F.forall(outer, lambda v: F.is_variant_null(v) | items(v).isNotNull())
        first = items(F.get(outer, F.lit(0)))
        return F.when(F.coalesce(rows, F.lit(False)), let(F.get(F.when(F.size(first) >= 3, first), F.lit(2)), of_inner)).otherwise(result("error", "malformed response"))

    # each document is parsed once: a value that is named twice would be computed twice
    of_rest = lambda rest: F.when(F.coalesce(F.length(rest), F.lit(0)) == 0, result("error", "invalid response")).otherwise(let(items(strict(rest)), of_outer))
    return let(unprefixed(body), of_rest)
