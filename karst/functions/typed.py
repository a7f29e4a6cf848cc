"""Arguments and results that keep their types, as VARIANT: ``1``, ``"1"``, ``1.0`` and ``true`` are four values.

Variants cannot be grouped or joined by, so equality goes by a canonical text, in which every scalar carries its type and lists and objects are
taken apart to ``DEPTH``; what lies deeper is its JSON text, which tells texts from numbers but not 1 from 1.0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import named

DEPTH = 3
_INT, _FLOAT = r"^(BIGINT|INT|SMALLINT|TINYINT)$", r"^(DOUBLE|FLOAT|DECIMAL\(.*)$"


def parse(text: Column) -> Column:
    """JSON as a variant; null where it is none."""
    return F.try_parse_json(text)


def kind(value: Column) -> Column:
    """null, bool, int, float, text, list or object; null of a null column."""
    return named(F.schema_of_variant(value), lambda s: _kind(value, s))


def _kind(value: Column, s: Column) -> Column:
    return (
        F.when(F.is_variant_null(value), "null").when(s == "BOOLEAN", "bool").when(F.regexp_like(s, F.lit(_INT)), "int").when(F.regexp_like(s, F.lit(_FLOAT)), "float")
        .when(s == "STRING", "text").when(F.startswith(s, F.lit("ARRAY<")), "list").when(F.startswith(s, F.lit("OBJECT<")), "object").otherwise(F.lower(s))
    )


def as_text(value: Column) -> Column:
    """A scalar's text without quotes; lists and objects as JSON."""
    return F.when(kind(value) == "text", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def canonical(value: Column, strict: bool = True, depth: int = DEPTH) -> Column:
    """A text that equal values share, and only they: ``int:1``, ``float:1.0``, ``text:"1"``, ``bool:true``, ``null``, ``[...]``, ``{"key":...}``.

    ``strict`` false: numbers that are equal are the same whatever their type, and true and false are 1 and 0, as where values are compared by ``==``.
    Objects do not depend on the order of their keys; lists do.  A null column counts as null.
    """
    return named(kind(value), lambda k: _canonical(value, k, strict, depth))


def _canonical(value: Column, k: Column, strict: bool, depth: int) -> Column:
    number = F.try_variant_get(value, "$", "double")
    if strict:
        whole = F.concat(F.lit("int:"), F.to_json(value))
        fraction, flag = F.concat(F.lit("float:"), number.cast("string")), F.concat(F.lit("bool:"), F.to_json(value))
    else:
        # integers beyond 2^53 keep their digits
        exact = F.try_variant_get(value, "$", "decimal(38,0)")
        integral = (number == F.floor(number)) & (F.abs(number) < 1e18)
        whole = F.concat(F.lit("number:"), exact.cast("string"))
        fraction = F.concat(F.lit("number:"), F.when(integral, number.cast("decimal(38,0)").cast("string")).otherwise(number.cast("string")))
        flag = F.concat(F.lit("number:"), F.try_variant_get(value, "$", "boolean").cast("int").cast("string"))
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    out = F.when(value.isNull() | (k == "null"), "null").when(k == "int", whole).when(k == "float", fraction).when(k == "bool", flag).when(k == "text", F.concat(F.lit("text:"), quoted(F.try_variant_get(value, "$", "string"))))
    if depth > 1:
        inner = lambda x: canonical(x, strict, depth - 1)
        items = F.transform(F.try_variant_get(value, "$", "array<variant>"), inner)
        fields = F.array_sort(F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), lambda e: F.concat(quoted(e["key"]), F.lit(":"), inner(e["value"]))))
        out = out.when(k == "list", F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))).when(k == "object", F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")))
    return out.otherwise(F.concat(k, F.lit(":"), F.to_json(value)))


def canonical_call(name: Column, arguments: Column, strict: bool = True) -> Column:
    """A call with a variant object of arguments as one comparable text."""
    return F.concat(F.coalesce(name, F.lit("null")), F.lit("("), canonical(arguments, strict), F.lit(")"))


def digest(value: Column, strict: bool = True) -> Column:
    """128 bits of the canonical text, for keys of joins on large values."""
    return F.md5(canonical(value, strict))


def to_map(arguments: Column) -> Column:
    """The arguments as a map of texts, as the operators on untyped traces take them."""
    return F.transform_values(F.try_variant_get(arguments, "$", "map<string,variant>"), lambda _, v: as_text(v))
