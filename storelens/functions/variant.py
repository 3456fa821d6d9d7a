"""Dynamic JSON as VARIANT: strict parsing, positional paths, and loose coercions that never fail.

A missing value is SQL NULL inside these functions; the coercions turn it into the zero of their type.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


LONG_MAX = (1 << 63) - 1
WHOLE = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strict(text: Column) -> Column:
    """Parse a whole JSON document; NULL if it is malformed or has anything behind it."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"S"]'))).try_cast("array<variant>")
    sealed = lambda w: (F.size(w) == 2) & (F.try_variant_get(F.get(w, F.lit(1)), "$", "string") == "S")
    return let(wrapped, lambda w: F.when(sealed(w), F.get(w, F.lit(0))))


def kind(v: Column) -> Column:
    """VOID, BOOLEAN, STRING, a number's type, ARRAY<...> or OBJECT<...>."""
    return F.schema_of_variant(v)


def is_string(v: Column) -> Column:
    return kind(v) == "STRING"


def is_number(v: Column) -> Column:
    return kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")


def items(v: Column) -> Column:
    """The elements of an array; NULL for anything else."""
    return v.try_cast("array<variant>")


def _present(v: Column) -> Column:
    return let(v, lambda x: F.when(~F.is_variant_null(x), x))


def _indices(steps: Sequence[int]) -> str:
    return "$" + "".join(f"[{i}]" for i in steps)


def _step(at: Column, i: int) -> Column:
    return let(at, lambda x: F.coalesce(F.variant_get(x, f"$[{i}]", "variant"), F.variant_get(x, f"$['{i}']", "variant")))


def _walked(v: Column, steps: Sequence[int]) -> Column:
    # every path is a literal: Spark parses those once, others anew for each value
    return F.coalesce(F.variant_get(v, _indices(steps), "variant"), reduce(_step, steps, v))


def paths(v: Column, *many: Sequence[int]) -> Column:
    """``path`` for each of several, as an array."""
    return F.transform(F.array(*[_walked(v, p) for p in many]), lambda x: F.when(~F.is_variant_null(x), x))


def _cells(v: Column, many: Sequence[Sequence[int]]) -> Column:
    return F.array(*[F.variant_get(v, _indices(p), "variant") for p in many])


def path(v: Column, *steps: int) -> Column:
    """Walk index steps: an array by place, an object by the step as its key; NULL when a step fails or ends in null."""
    return _present(_walked(v, steps) if steps else v)


def array_path(v: Column, *steps: int) -> Column:
    """Walk arrays only."""
    return _present(F.variant_get(v, _indices(steps), "variant"))


def _number_text(d: Column) -> Column:
    """A double as the shortest text, with an exponent from a million on and below a ten-thousandth."""
    java, size = F.regexp_replace(d.cast("string"), r"\.0$", ""), F.abs(d)

    def exponent(p: Column) -> Column:
        digits = F.abs(p).cast("string")
        return F.concat(F.when(p < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(digits, F.greatest(F.lit(2), F.length(digits)), F.lit("0")))

    digits = F.regexp_replace(F.regexp_replace(java, r"[-.]", ""), "0+$", "")
    sign = F.when(d < 0, F.lit("-")).otherwise(F.lit(""))
    million = F.concat(sign, F.left(digits, F.lit(1)), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, 2, 20))).otherwise(F.lit("")), F.lit("e+06"))
    small = F.regexp_replace(d.try_cast("decimal(38,22)").cast("string"), "0+$", "")
    scientific = F.concat(F.regexp_replace(F.regexp_extract(java, r"^([^E]*)", 1), r"\.0$", ""), exponent(F.regexp_extract(java, r"E(-?[0-9]+)$", 1).cast("int")))
    return (
        F.when(size == 0, F.lit("0"))
        .when((size >= 1e6) & (size < 1e7), million)
        .when((size >= 1e-4) & (size < 1e-3), small)
        .when(java.contains("E"), scientific)
        .otherwise(java)
    )


def to_string(v: Column) -> Column:
    """Text as it is, other scalars in their usual form, '' for none; arrays and objects as JSON."""
    return let(v, _string)


def _string(x: Column) -> Column:
    number = let(F.try_variant_get(x, "$", "double"), _number_text)
    found = F.when(is_string(x) | (kind(x) == "BOOLEAN"), F.try_variant_get(x, "$", "string")).when(is_number(x), number).when(kind(x) != "VOID", F.to_json(x))
    return F.coalesce(found, F.lit(""))


def strings(v: Column, *many: Sequence[int]) -> Column:
    """``to_string`` of each of several paths, as an array."""
    return F.transform(paths(v, *many), _string)


def longs(v: Column, *many: Sequence[int]) -> Column:
    """``to_long`` of each of several paths, as an array."""
    return F.transform(paths(v, *many), _long)


def _as_long(d: Column) -> Column:
    return let(d, lambda x: F.when(x.between(-9.3e18, 9.3e18), x.try_cast("bigint")))


def _parsed_long(text: Column) -> Column:
    edge = F.when(text.startswith("-"), F.lit(-LONG_MAX - 1)).otherwise(F.lit(LONG_MAX))
    return F.when(text.rlike(WHOLE), F.coalesce(text.try_cast("bigint"), edge))


def to_long(v: Column) -> Column:
    """A number cut to its whole part; text of digits, at most the largest value; 0 for anything else."""
    return let(v, _long)


def _long(x: Column) -> Column:
    found = F.when(is_number(x), _as_long(F.try_variant_get(x, "$", "double"))).when(is_string(x), let(F.try_variant_get(x, "$", "string"), _parsed_long))
    return F.coalesce(found, F.lit(0)).cast("long")


def to_double(v: Column) -> Column:
    """A number; text that is one; 0 for anything else."""

    def of(x: Column) -> Column:
        parsed = let(F.try_variant_get(x, "$", "string"), lambda t: F.when(t.rlike(DECIMAL), t.try_cast("double")))
        return F.when(is_number(x), F.try_variant_get(x, "$", "double")).when(is_string(x), parsed)

    return F.coalesce(let(v, of), F.lit(0.0))


def text_only(v: Column) -> Column:
    """A text, or NULL: no coercion."""
    return let(v, _text)


def _text(x: Column) -> Column:
    return F.when(is_string(x), F.try_variant_get(x, "$", "string"))


def number_only(v: Column) -> Column:
    """A number cut to its whole part, or NULL: no coercion."""
    return let(v, _number)


def _number(x: Column) -> Column:
    return F.when(is_number(x), _as_long(F.try_variant_get(x, "$", "double")))


def texts_only(v: Column, *many: Sequence[int]) -> Column:
    """``text_only`` of each of several paths of arrays, '' for none."""
    return F.transform(_cells(v, many), lambda x: F.coalesce(_text(x), F.lit("")))


def numbers_only(v: Column, *many: Sequence[int]) -> Column:
    """``number_only`` of each of several paths of arrays."""
    return F.transform(_cells(v, many), _number)
