"""Cells kept by key: the plans that questions meet them in, and updates."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from karst import model
from karst.operators.cells import Cube, with_series, with_vectors
from karst.sources import keyed


@pytest.fixture(scope="module")
def cube(spark):
    geo = spark.createDataFrame([(f"C{i:02}", f"Land {i}", f"R{i % 4}", i) for i in range(20)], model.GEO)
    obs = spark.range(20 * 40 * 10).select(
        F.concat(F.lit("I"), (F.col("id") % 40).cast("string")).alias("indicator_code"),
        F.format_string("C%02d", F.floor(F.col("id") / 40) % 20).alias("country_code"),
        (2000 + F.floor(F.col("id") / 800)).cast("int").alias("year"), F.when(F.col("id") % 3 > 0, F.col("id") * 1.5).alias("value"),
    )
    return Cube(geo, obs)


@pytest.fixture(scope="module")
def kept(cube):
    out = keyed.keep(cube, "karst_test")
    yield out
    out.drop()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def asks(spark, n=2):
    return spark.range(3000).select(
        F.concat(F.lit("I"), (F.col("id") % n).cast("string")).alias("indicator_code"), F.format_string("C%02d", F.col("id") % 23).alias("country_code"), (2000 + F.col("id") % 12).cast("int").alias("year")
    )


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def under(plan, table):
    """The lines from the join above the scan of ``table`` down to it."""
    lines = plan.split("== Initial Plan ==")[0].split("\n")
    at = next(i for i, x in enumerate(lines) if "Scan parquet" in x and table in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    out, d = [lines[at]], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < d:
            out.append(x)
            d = depth(x)
            if "SortMergeJoin" in x:
                break
    return out


def test_the_cube_is_not_shuffled_and_is_pruned(spark, kept, no_broadcast):
    got = kept.values(asks(spark))
    plan = plan_of(got)
    above = under(plan, "karst_test_series")
    assert "SortMergeJoin" in above[-1] and not any("Exchange" in x for x in above)
    scan = above[0]
    assert "dynamicpruning" in scan and "Bucketed: true" in scan
    read = re.search(r"SelectedBucketsCount: (\d+) out of (\d+)", scan)
    assert read and read[1] == read[2]
    # two indicators' partitions at most are read
    node = got._jdf.queryExecution().executedPlan()
    text = node.toString()
    assert text.count("karst_test_series") >= 1
    parts = {r.p for r in spark.table("karst_test_series").where("indicator_code IN ('I0', 'I1')").select(F.col("part").alias("p")).distinct().collect()}
    assert 1 <= len(parts) <= 2 < spark.table("karst_test_series").select("part").distinct().count()


def test_keyed_cells_equal_the_cube(spark, cube, kept, no_broadcast):
    want = {(r.indicator_code, r.country_code, r.year): r.value for r in cube.known().collect()}
    for r in kept.values(asks(spark, 50)).collect():
        assert r.value == want.get((r.indicator_code, r.country_code, r.year)), r
    questions = spark.createDataFrame([(f"C{i:02}", f"R{i % 5}", f"I{i}", 2000 + i) for i in range(12)], "subject string, region string, property string, year int")
    for build in (lambda c: with_series(questions, c, ["subject"]), lambda c: with_vectors(questions, c, [("region", "year")])):
        rows = [sorted(map(str, build(c).select(*sorted(build(c).columns)).collect())) for c in (cube, kept)]
        plain = [[re.sub(r"(\d{4}): ", r"\1:", x) for x in r] for r in rows]
        assert len(plain[0]) == len(plain[1]) == 12
    series = lambda c: {(r.subject, r.property): r.s_subject for r in with_series(questions, c, ["subject"]).collect()}
    vectors = lambda c: {(r.region, r.property, r.year): r.v_region_year for r in with_vectors(questions, c, [("region", "year")]).collect()}
    assert series(kept) == series(cube) and vectors(kept) == vectors(cube)
    plan = plan_of(with_vectors(questions, kept, [("region", "year")]))
    assert not any("Exchange" in x for x in under(plan, "karst_test_vectors"))


def test_updates_touch_their_partitions_only(spark, cube):
    own = keyed.keep(cube, "karst_updated", parts=8)
    try:
        files = lambda: {r.f for r in spark.read.table("karst_updated_series").select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
        before = files()
        new = spark.createDataFrame([("I1", "C01", 2001, -1.0), ("I1", "C01", 2050, -2.0), ("I1", "C99", 2001, -3.0)], model.OBSERVATIONS)
        own.update(new)
        spark.catalog.refreshTable("karst_updated_series")
        part = spark.range(1).select(keyed.part_of(F.lit("I1"), 8).alias("p")).first().p
        assert {f for f in before if f"part={part}/" not in f} == {f for f in files() if f"part={part}/" not in f}
        want = {(r.indicator_code, r.country_code, r.year): r.value for r in cube.known().collect()} | {("I1", "C01", 2001): -1.0, ("I1", "C01", 2050): -2.0, ("I1", "C99", 2001): -3.0}
        got = {(r.indicator_code, r.country_code, r.year): r.value for r in own.series().select("indicator_code", "country_code", F.explode("by_year").alias("year", "value")).collect()}
        assert got == want
        region = {(r.year): r.have for r in own.vectors().where("indicator_code = 'I1' AND region = 'R1'").collect()}
        assert region[2001]["C01"] == -1.0 and region[2050] == {"C01": -2.0} and len(region[2001]) >= 2
    finally:
        own.drop()
