"""The numeric tools on literals, nulls, ties, no values and zeros."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from karst.functions import numeric as N
from karst.functions import registry
from karst.functions.text import canonical_call, list_literal, numbers, suffix_coded


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(*values):
    return F.array(*(F.lit(v).cast("double") for v in values)).cast("array<double>")


def d(x):
    return F.lit(x).cast("double")


CASES = [
    (lambda: N.add(arr(1, 2, 3)), 6.0), (lambda: N.add(arr()), 0.0), (lambda: N.add(arr(1, None, float("nan"))), 1.0),
    (lambda: N.subtract(d(10), d(4)), 6.0), (lambda: N.subtract(d(None), d(4)), None),
    (lambda: N.greater_than(d(5), d(3)), True), (lambda: N.greater_than(d(3), d(3)), False), (lambda: N.less_than(d(2), d(7)), True),
    (lambda: N.multiply(arr(2, 3, 4)), 24.0), (lambda: N.multiply(arr()), 1.0), (lambda: N.multiply(arr(2, None)), None),
    (lambda: N.divide(d(20), d(5)), 4.0), (lambda: N.divide(d(1), d(0)), None), (lambda: N.divide(d(80.543), d(1427.331)), 0.05643),
    (lambda: N.mean(arr(1, 2, 3, 4, 5)), 3.0), (lambda: N.mean(arr()), None), (lambda: N.mean(arr(None)), None),
    (lambda: N.maximum(arr(1, 5, 3, 2)), 5.0), (lambda: N.minimum(arr(4, 1, None)), 1.0), (lambda: N.maximum(arr(None)), None),
    (lambda: N.count(arr(1, None, 3)), 2), (lambda: N.count(F.array(F.lit(False), F.lit(True))), 2),
    (lambda: N.rank(arr(10, 20, 30, 40), d(20)), 3), (lambda: N.rank(arr(5, 7, 7, 1), d(5)), 3), (lambda: N.rank(arr(1, 2), d(3)), None),
    (lambda: N.sort(arr(3, None, 1)), [1.0, 3.0]), (lambda: N.index(arr(10, 20, 30, 40), d(30)), 2), (lambda: N.index(arr(None, 7), d(7)), 0), (lambda: N.index(arr(1), d(2)), None),
    (lambda: N.median(arr(1, 3, 2)), 2.0), (lambda: N.median(arr(1, 2)), 1.5), (lambda: N.median(arr()), None), (lambda: N.mode(arr(2, 1, 2, 1)), 1.0),
    (lambda: N.add(arr(0.000004, 0.000004)), 1e-05),
]


@pytest.mark.parametrize("build, want", CASES)
def test_tools(spark, build, want):
    assert one(spark, build()) == want


def test_list_literals(spark):
    assert one(spark, list_literal(F.lit("['a', 'b']"))) == ["a", "b"]
    assert one(spark, numbers(F.lit('["1", 2, "x"]'))) == [1.0, 2.0, None]
    assert one(spark, list_literal(F.lit("no list"))) is None


def test_calls_compare_by_content(spark):
    a = canonical_call(F.lit("add"), F.create_map(F.lit("values"), F.lit("[2, 1.0]")))
    b = canonical_call(F.lit("add"), F.create_map(F.lit("values"), F.lit("['1', 2.0]")))
    assert one(spark, a) == one(spark, b)


def test_suffix(spark):
    assert one(spark, suffix_coded(F.lit("NY.GDP.PCAP.CD"), ["CD"]))
    assert not one(spark, suffix_coded(F.lit("SP.POP.TOTL"), ["CD", "TOT"]))


def test_catalogue(spark):
    assert registry.catalogue(spark).count() == 22
    assert {r.name for r in registry.catalogue(spark, "utils").collect()} == {"final_answer", "think"}
    assert registry.schema(registry.BY_NAME["rank"])["function"]["parameters"]["required"] == ["values", "query_value"]
    assert "input_schema" in registry.schema(registry.BY_NAME["add"], "claude")
    names = registry.register_sql(spark)
    assert "tool_divide" in names
    assert spark.sql("SELECT tool_divide(1, 0) AS a, tool_rank(array(1D, 3D), 1D) AS b, tool_add(array(1D, NULL)) AS c").first() == (None, 2, 1.0)
