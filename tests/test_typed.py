"""Values that keep their types: canonical texts, digests, scoring."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import functions as F

from karst.functions import typed
from karst.operators import scoring

VALUES = [
    "1", '"1"', "1.0", "true", "false", "0", "null", '"null"', '"true"', "[]", "{}", "[1]", "[1.0]", '["1"]', "[true]", "[null]", '{"a": 1}', '{"a": 1.0}', '{"a": "1"}', '{"a": null}', '{"b": 1}',
    '{"a": 1, "b": [1, {"c": true}]}', '{"a": 1, "b": [1.0, {"c": true}]}', '"a\\"b,c"', '["a", "b"]', '["a,b"]', '"[1]"', "1.5", "-1", "12345678901234567", "12345678901234568",
]
#: The same value written in other ways.
SAME = [("1.0", "1.00"), ("1.0", "1e0"), ('{"a": 1, "b": 2}', '{"b":2,"a":1}'), ("[1,2]", "[ 1 , 2 ]"), ("-0.0", "0.0"), ('"é"', '"\\u00e9"')]


def canon(spark, texts, strict=True):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", typed.parse(F.col("t")).alias("v"))
    return [r.c for r in df.select("i", typed.canonical(F.col("v"), strict).alias("c")).orderBy("i").collect()]


def test_types_are_told_apart(spark):
    got = canon(spark, VALUES)
    assert all(x is not None for x in got)
    assert [(VALUES[i], VALUES[j]) for i, j in itertools.combinations(range(len(got)), 2) if got[i] == got[j]] == []
    for a, b in SAME:
        x, y = canon(spark, [a, b])
        assert x == y, (a, b)


def test_loose_equality_is_that_of_python(spark):
    got = canon(spark, VALUES, strict=False)
    value = [json.loads(t) for t in VALUES]
    for i, j in itertools.combinations(range(len(got)), 2):
        assert (got[i] == got[j]) == (value[i] == value[j]), (VALUES[i], VALUES[j])


def test_odd_values(spark):
    assert canon(spark, [None, "no json", ""]) == ["null"] * 3
    df = spark.createDataFrame([('{"a": 1, "b": "x", "c": [1, "y"], "d": null}',)], "t string").select(typed.parse(F.col("t")).alias("v"))
    assert df.select(typed.to_map(F.col("v")).alias("m")).first().m == {"a": "1", "b": "x", "c": '[1,"y"]', "d": "null"}
    assert len(df.select(typed.digest(F.col("v")).alias("d")).first().d) == 32


def test_typed_calls_as_multisets(spark, tmp_path):
    rows = [(1, "f", '{"x": 1}', '{"x": 1}'), (1, "f", '{"x": 1}', '{"x": "1"}'), (1, "f", '{"x": 1.0}', '{"x": 1.00}'), (2, "g", '{"y": true}', '{"y": 1}')]
    df = spark.createDataFrame(rows, "row_id int, name string, p string, g string")
    df.select("row_id", "name", typed.parse(F.col("p")).alias("p"), typed.parse(F.col("g")).alias("g")).write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert dict(back.dtypes)["p"] == "variant"
    got = scoring.compare(back.select("row_id", "name", F.col("p").alias("arguments")), back.select("row_id", "name", F.col("g").alias("arguments")))
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 'f({"x":float:1.0})', 1, 0, 0), (1, 'f({"x":int:1})', 1, 1, 0), (1, 'f({"x":text:"1"})', 0, 0, 1), (2, 'g({"y":bool:true})', 0, 1, 0), (2, 'g({"y":int:1})', 0, 0, 1),
    ]


def test_the_type_of_a_value_is_asked_once_a_level(spark):
    rows = spark.range(1).select(typed.canonical(typed.parse(F.concat(F.lit("["), F.col("id").cast("string"), F.lit("]")))).alias("c"))
    assert rows.first().c == "[int:0]"
    # one for the value, its items and its fields, and for theirs; an expression that repeats it grows by the number of branches a level
    assert rows._jdf.queryExecution().analyzed().toString().lower().count("schema_of_variant") <= 7
