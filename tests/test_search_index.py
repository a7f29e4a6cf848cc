"""The kept search index against searches of the catalogue itself, and the tools as SQL table functions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from karst import model
from karst.functions import registry
from karst.operators import lookup
from karst.operators.search_index import SearchIndex

WORDS = ["Cold", "(dry)", "widget,", "gear", "GDP", "per", "capita", "  ", "é", "of", "small", "ring"]


def catalogue(rng, ids):
    return [(f"I{i}", None if i % 17 == 0 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 5))), f"d{rng.randrange(99)}") for i in ids]


@pytest.fixture
def index(spark):
    out = SearchIndex(spark, "karst_test_index")
    yield out
    out.drop()
    SearchIndex(spark, "karst_test_index_m").drop()


def test_searches_equal_those_of_the_catalogue(spark, index):
    rng = random.Random(2)
    table = lambda rows: spark.createDataFrame(rows, model.INDICATORS).repartition(3)
    first, second = catalogue(rng, range(120)), catalogue(rng, [*range(60, 180), 7, 7])
    asks = ["cold, gear", "['DRY', 'per capita']", "é", "nothing", "", "small", "widget", None, "[]", *(n.lower() for _, n, _ in second[:30:7] if n)]
    args = spark.createDataFrame(list(enumerate(asks)), "query_id int, keywords string")
    key = lambda r: tuple(map(str, r))

    def same(found, rows):
        got, want = (sorted((tuple(r) for r in df.collect()), key=key) for df in (found, lookup.search_names(args, table(rows))))
        assert got == want and len(want) > 20

    assert index.add(table(first)) == 0
    same(index.search(args), first)
    assert index.add(table(second)) == 1
    new = {r[0] for r in second}
    live = [r for r in first if r[0] not in new] + second
    same(index.search(args), live)
    same(index.merge().search(args), live)


def test_the_index_is_not_shuffled(spark, index):
    rng = random.Random(3)
    index.add(spark.createDataFrame(catalogue(rng, range(300)), model.INDICATORS))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = index.search(spark.createDataFrame([(1, "cold gear")], "query_id int, keywords string"))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for at, line in enumerate(lines):
        if "Scan parquet" in line and ("_postings" in line or "_docs" in line):
            d = depth(line)
            for above in reversed(lines[:at]):
                if depth(above) < d:
                    d = depth(above)
                    assert "Exchange" not in above
                    if "Join" in above:
                        break
    assert "karst_test_index_postings" in plan


def test_table_functions(spark):
    geo = spark.createDataFrame([("AAA", "Aland", "N", 0), ("BBB", "Boland", "N", 1), ("ATA", "Ice", None, 2)], model.GEO)
    indicators = spark.createDataFrame([("I1", "Cold (dry) widget", "d1"), ("I2", "hot gear", "d2")], model.INDICATORS)
    obs = spark.createDataFrame([("I1", "AAA", 2003, 1.0), ("I1", "AAA", 2003, 2.0), ("I1", "BBB", 2003, None)], model.OBSERVATIONS)
    assert registry.register_tables(spark, geo, indicators, obs) == ["tool_region_members", "tool_retrieve_value", "tool_search_names"]
    assert [r.country_code for r in spark.sql("SELECT * FROM tool_region_members('N') ORDER BY pos").collect()] == ["AAA", "BBB"]
    assert spark.sql("SELECT * FROM tool_region_members(NULL)").collect() == []
    asks = spark.createDataFrame([("AAA", "I1", 2003), ("BBB", "I1", 2003), ("ZZZ", "I1", 2003), ("AAA", "I9", 2003), (None, None, None)], "c string, i string, y int")
    got = spark.sql("SELECT c, i, v.* FROM {a}, LATERAL tool_retrieve_value(c, i, y) v", a=asks)
    assert {(r.c, r.i): (r.value, r.status) for r in got.collect()} == {("AAA", "I1"): (1.5, "ok"), ("BBB", "I1"): (None, "no_data"), ("ZZZ", "I1"): (None, "invalid_country"), ("AAA", "I9"): (None, "invalid_indicator"), (None, None): (None, "invalid_country")}
    assert "NestedLoop" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = spark.sql("SELECT * FROM tool_search_names(array('DRY', 'gear', 'none')) ORDER BY keyword_no").collect()
    assert [(r.keyword, r.indicator_code) for r in found] == [("DRY", "I1"), ("gear", "I2")]
    assert spark.range(1).select(F.lit(1)).count() == 1
