"""The numeric tools as native column expressions over arrays of doubles.

Nulls and NaN are no values.  What would be an error in a call (no values, an absent query value, division by
zero) is null.  Every result is rounded to 5 decimals (half up).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 5


def rounded(x: Column) -> Column:
    return F.round(x, DIGITS)


def known(values: Column) -> Column:
    """The values that are neither null nor NaN."""
    return F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def add(values: Column) -> Column:
    """A1: the sum; 0 of no values."""
    return rounded(_sum(known(values)))


def subtract(a: Column, b: Column) -> Column:
    """A2."""
    return rounded(a - b)


def greater_than(a: Column, b: Column) -> Column:
    """A3."""
    return a > b


def less_than(a: Column, b: Column) -> Column:
    """A4."""
    return a < b


def multiply(values: Column) -> Column:
    """A5: the product, 1 of no values; a null among them makes it null."""
    return rounded(F.aggregate(values, F.lit(1.0), lambda s, x: s * x))


def divide(a: Column, b: Column) -> Column:
    """Null where b is 0."""
    return rounded(a / F.when(b != 0, b))


def mean(values: Column) -> Column:
    """A7."""
    n = F.size(known(values))
    return F.when(n > 0, rounded(_sum(known(values)) / n))


def maximum(values: Column) -> Column:
    """A8."""
    return rounded(F.array_max(known(values)))


def minimum(values: Column) -> Column:
    """A9."""
    return rounded(F.array_min(known(values)))


def count(values: Column) -> Column:
    """A10: values of any type that are not null."""
    return F.size(F.filter(values, lambda x: x.isNotNull())).cast("long")


def rank(values: Column, query: Column) -> Column:
    """1-based, descending, equal values share the best rank; null if the query value is absent."""
    v = known(values)
    return F.when(F.array_contains(v, query), F.size(F.filter(v, lambda x: x > query)) + 1).cast("long")


def sort(values: Column) -> Column:
    """A12."""
    return F.array_sort(known(values))


def index(values: Column, query: Column) -> Column:
    """0-based place among the values that are not null; null if absent."""
    return (F.nullif(F.array_position(known(values), query), F.lit(0)) - 1).cast("long")


def mode(values: Column) -> Column:
    """The most frequent value, the smallest among equals."""
    v = known(values)
    distinct = F.array_sort(F.array_distinct(v))
    times = F.transform(distinct, lambda d: F.size(F.filter(v, lambda x: x == d)))
    return F.try_element_at(distinct, F.array_position(times, F.array_max(times)).cast("int"))


def median(values: Column) -> Column:
    """Of an even number of values, half the rounded sum of the middle two."""
    s = F.array_sort(known(values))
    n = F.size(s)
    odd = F.get(s, F.floor(n / 2).cast("int"))
    even = rounded(F.get(s, F.floor(n / 2).cast("int") - 1) + odd) / 2
    return F.when(n > 0, F.when(n % 2 == 1, rounded(odd)).otherwise(even))
