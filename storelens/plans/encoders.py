"""Writes payload-shaped bodies from plain columns, for checks of the readers by a round trip.

Nothing here is shared with the readers: places are written out again, as trees of {place: column or tree}.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def array(tree: dict | list | Column) -> Column:
    """A positional array as VARIANT; gaps are null. Lists are dense, columns are leaves."""
    if isinstance(tree, Column):
        return F.coalesce(tree.cast("variant"), F.parse_json(F.lit("null")))
    cells = dict(enumerate(tree)) if isinstance(tree, list) else tree
    null = F.parse_json(F.lit("null"))
    return F.array(*[array(cells[i]) if i in cells else null for i in range(max(cells, default=-1) + 1)]).cast("variant")


def many(items: Column) -> Column:
    """An array of VARIANT as one VARIANT."""
    return items.cast("variant")


def text(v: Column) -> Column:
    return F.to_json(v)


def hole() -> Column:
    """Stands in a document for what ``filled`` puts there."""
    return F.lit("<<rows>>")


def filled(document: Column, rows: Column) -> Column:
    """A document's text with JSON text in the place of ``hole``, so that long rows are not built anew around it."""
    return F.replace(document, F.lit('"<<rows>>"'), rows)


def script(key: str, data: Column) -> Column:
    return F.concat(F.lit(f"<script nonce=\"n\">AF_initDataCallback({{key: '{key}', hash: '1', data:"), data, F.lit(", sideChannel: {}});</script>"))


def page(*blocks: Column) -> Column:
    return F.concat(F.lit("<!doctype html><html><head><title>x</title></head><body>\n"), *[F.concat(b, F.lit("\n")) for b in blocks], F.lit("</body></html>"))


def response(inner: Column) -> Column:
    """A prefix line, then an array whose first row holds the inner document as text."""
    outer = array([[F.lit("wrb.fr"), F.lit("rpc"), inner, F.lit("generic")]])
    return F.concat(F.lit(")]}'\n"), text(outer))
