"""The named queries: every operator applied to the driver's tables, with its DuckDB text where there is one."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..functions import typed
from ..functions.registry import TOOLS, catalogue, register_tables
from ..operators import dispatch, lookup, matcher, provenance, rows, scoring
from ..operators.search_index import SearchIndex
from ..session import new_folder
from ..sources import files, keyed, sinks, star, stores
from ..streaming import producers, stops
from . import oracle as O
from . import questions as Q
from .actions import gold_actions
from .templates import SKIPPED, TEMPLATES, answer, bind

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
C = F.col


def query(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


# ------------------------------------------------------------------ templates

_NAMES = {
    "PropertyOfSubject": "t_property_of_subject", "SubjectPropertyChange": "t_subject_property_change", "AverageChange": "t_average_change",
    "CountryPropertyComparison": "t_country_property_comparison", "PropertyRatioComparison": "t_property_ratio", "AverageProperty": "t_average_property",
    "TotalProperty": "t_total_property", "RegionPropertyRatio": "t_region_property_ratio", "RegionComparison": "t_region_comparison",
    "RegionComparisonResult": "t_region_comparison_result", "RegionPropertyChange": "t_region_property_change", "TopNTotal": "t_top_n_total",
    "SubjectPropertyRank": "t_subject_property_rank", "RankChange": "t_rank_change", "RegionProportion": "t_region_proportion",
    "RegionProportionChange": "t_region_proportion_change", "AveragePropertyComparison": "t_average_property_comparison",
    "RegionAverageComparison": "t_region_average_comparison", "RegionRangeComparison": "t_region_range_comparison", "CountryThresholdCount": "t_country_threshold_count",
}

def _cube(spark: SparkSession, sf_dir: str):
    cube = star.cube(spark, sf_dir)
    # the cube is met by several joins of one plan: aggregate the orders once
    return type(cube)(cube.geo, cube.observations.cache())


def _years(cube) -> DataFrame:
    return cube.observations.select("year").distinct()


def _questions(cube, name: str) -> DataFrame:
    return Q.combinations(cube, name, _years(cube))


def _template(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = _cube(spark, sf_dir)
    out = answer(_questions(cube, name), cube, name).drop("question_id")
    return out.withColumn("answer", F.array_join("answer", "|")) if TEMPLATES[name].answer_format == "list[str]" else out


for _t, _n in _NAMES.items():
    query(_n, O.TEMPLATE_SQL[_t])(partial(_template, _t))


# ------------------------------------------------------------------ numeric tools


def _vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = _cube(spark, sf_dir)
    bound = bind(_questions(cube, "AverageProperty"), cube, TEMPLATES["AverageProperty"])
    return bound.select("property", "region", "year", F.transform("v_region_year", lambda m: m["value"]).alias("v"), C("v_region_year").alias("cells"))


def _list_tool(build: Callable[[Column], Column], spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector(spark, sf_dir).select("property", "region", "year", build(C("v")).alias("result"))


for _n, _b, _s in [
    ("add", N.add, "total"), ("mean", N.mean, "mean"), ("maximum", N.maximum, "mx"), ("minimum", N.minimum, "mn"), ("count", N.count, "CAST(k AS BIGINT)"),
]:
    query(f"tool_{_n}", f"{O.CUBE} SELECT property, region, year, {_s} AS result FROM reg")(partial(_list_tool, _b))
query("tool_sort", f"{O.CUBE} SELECT property, region, year, coalesce(string_agg(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY value) FILTER (WHERE value IS NOT NULL), '') AS result FROM cells GROUP BY 1, 2, 3")(
    partial(_list_tool, lambda v: F.array_join(F.transform(N.sort(v), lambda x: F.round(x * 100).cast("long").cast("string")), ","))
)
query(
    "tool_median",
    f"{O.CUBE}, s AS (SELECT property, region, year, list(value ORDER BY value) FILTER (WHERE value IS NOT NULL) AS l FROM cells GROUP BY 1, 2, 3) SELECT property, region, year, CASE WHEN len(l) % 2 = 1 THEN l[len(l) // 2 + 1] WHEN len(l) > 0 THEN round(l[len(l) // 2] + l[len(l) // 2 + 1], 5) / 2 END AS result FROM s",
)(partial(_list_tool, N.median))


query("tool_mode", f"{O.CUBE}, m AS (SELECT region, property, year, round(value / 1e5) AS v FROM cells), t AS (SELECT region, property, year, v, count(*) AS n FROM m WHERE v IS NOT NULL GROUP BY 1, 2, 3, 4) SELECT r.property, r.region, r.year, (SELECT arg_min(v, (-n, v)) FROM t WHERE t.region = r.region AND t.property = r.property AND t.year = r.year) AS result FROM reg r")(
    partial(_list_tool, lambda v: N.mode(F.transform(v, lambda x: F.round(x / 1e5))))
)


def _member_tool(build: Callable[[Column, Column], Column], spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _vector(spark, sf_dir).select("property", "region", "year", "v", F.explode("cells").alias("m"))
    return one.select("property", "region", "year", C("m.code").alias("subject"), build(C("v"), C("m.value")).alias("result"))


query("tool_rank", f"{O.CUBE} SELECT property, region, year, code AS subject, CASE WHEN value IS NOT NULL THEN CAST(rk AS BIGINT) END AS result FROM ranked")(partial(_member_tool, N.rank))
query(
    "tool_index",
    f"{O.CUBE}, o AS (SELECT *, row_number() OVER (PARTITION BY property, region, year ORDER BY pos) - 1 AS i FROM cells WHERE value IS NOT NULL) SELECT c.property, c.region, c.year, c.code AS subject, CAST((SELECT min(o.i) FROM o WHERE o.property = c.property AND o.region = c.region AND o.year = c.year AND o.value = c.value) AS BIGINT) AS result FROM cells c",
)(partial(_member_tool, N.index))


def _line_tool(build: Callable[..., Column], columns: list[str], spark: SparkSession, sf_dir: str) -> DataFrame:
    line = star.table(spark, sf_dir, "lineitem")
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", build(*map(C, columns)).alias("result"))


for _n, _b, _c, _s in [
    ("subtract", N.subtract, ["l_extendedprice", "l_quantity"], "round(l_extendedprice - l_quantity, 5)"),
    ("divide", N.divide, ["l_quantity", "l_tax"], "round(l_quantity / nullif(l_tax, 0), 5)"),
    ("greater_than", N.greater_than, ["l_discount", "l_tax"], "l_discount > l_tax"),
    ("less_than", N.less_than, ["l_discount", "l_tax"], "l_discount < l_tax"),
    ("multiply", lambda *x: N.multiply(F.array(*x)), ["l_quantity", "l_discount", "l_tax"], "round(1.0::DOUBLE * l_quantity * l_discount * l_tax, 5)"),
]:
    query(f"tool_{_n}", f"{O.LINE}{_s} AS result FROM lineitem")(partial(_line_tool, _b, _c))


# ------------------------------------------------------------------ lookups


def _indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = star.table(spark, sf_dir, "part")
    return part.select(C("p_partkey").cast("string").alias("id"), C("p_name").alias("name"), C("p_type").alias("description"))


@query("lookup_country_code", "SELECT c_custkey, 'NATION_' || CAST(c_custkey % 30 AS VARCHAR) AS country_name, CAST(n_nationkey AS VARCHAR) AS country_code, CASE WHEN n_nationkey IS NULL THEN 'invalid_country_name' ELSE 'ok' END AS status FROM customer LEFT JOIN nation ON n_name = 'NATION_' || CAST(c_custkey % 30 AS VARCHAR)")
def lookup_country_code(spark, sf_dir):
    args = star.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("NATION_"), (C("c_custkey") % 30).cast("string")).alias("country_name"))
    return lookup.country_code(args, star.geo(spark, sf_dir)).select("c_custkey", "country_name", "country_code", "status")


@query("lookup_country_name", "SELECT c_custkey, CAST(c_custkey % 30 AS VARCHAR) AS country_code, n_name AS country_name, CASE WHEN n_nationkey IS NULL THEN 'invalid_country' ELSE 'ok' END AS status FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 30")
def lookup_country_name(spark, sf_dir):
    args = star.table(spark, sf_dir, "customer").select("c_custkey", (C("c_custkey") % 30).cast("string").alias("country_code"))
    return lookup.country_name(args, star.geo(spark, sf_dir)).select("c_custkey", "country_code", "country_name", "status")


@query("lookup_indicator_code", "WITH p AS (SELECT p_name, min(CAST(p_partkey AS VARCHAR)) AS code FROM part GROUP BY 1) SELECT a.p_partkey, '  ' || a.p_name || CASE WHEN a.p_partkey % 9 = 0 THEN 'x ' ELSE ' ' END AS indicator_name, p.code AS indicator_code, CASE WHEN p.code IS NULL THEN 'invalid_indicator_name' ELSE 'ok' END AS status FROM part a LEFT JOIN p ON p.p_name = trim(a.p_name || CASE WHEN a.p_partkey % 9 = 0 THEN 'x ' ELSE ' ' END)")
def lookup_indicator_code(spark, sf_dir):
    args = star.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.when(C("p_partkey") % 9 == 0, "x ").otherwise(" ")).alias("indicator_name"))
    return lookup.indicator_code(args, _indicators(spark, sf_dir)).select("p_partkey", "indicator_name", "indicator_code", "status")


@query("lookup_indicator_name", "SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, CAST(l.l_partkey + l.l_linenumber * 1000 AS VARCHAR) AS indicator_code, p.p_name AS indicator_name, CASE WHEN p.p_partkey IS NULL THEN 'invalid_indicator' ELSE 'ok' END AS status FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey + l.l_linenumber * 1000")
def lookup_indicator_name(spark, sf_dir):
    args = star.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (C("l_partkey") + C("l_linenumber") * 1000).cast("string").alias("indicator_code"))
    return lookup.indicator_name(args, _indicators(spark, sf_dir)).select("l_orderkey", "l_linenumber", "l_suppkey", "indicator_code", "indicator_name", "status")


@query("lookup_region_members", "WITH a AS (SELECT r_name AS region FROM region UNION ALL SELECT 'ATLANTIS'), m AS (SELECT r_name, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS codes FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1) SELECT region, codes AS country_codes, CASE WHEN codes IS NULL THEN 'invalid_region' ELSE 'ok' END AS status FROM a LEFT JOIN m ON r_name = region")
def lookup_region_members(spark, sf_dir):
    args = star.table(spark, sf_dir, "region").select(C("r_name").alias("region")).union(spark.sql("SELECT 'ATLANTIS'"))
    return lookup.region_members(args, star.geo(spark, sf_dir)).select("region", F.array_join("country_codes", ",").alias("country_codes"), "status")


def _order_asks(spark, sf_dir) -> DataFrame:
    orders = star.table(spark, sf_dir, "orders").join(star.table(spark, sf_dir, "customer"), C("o_custkey") == C("c_custkey"))
    segment = F.when(C("o_orderkey") % 11 == 0, "NONE").otherwise(C("c_mktsegment"))
    return orders.select("o_orderkey", (C("o_orderkey") % 27).cast("string").alias("country_code"), F.concat_ws("|", "o_orderpriority", segment).alias("indicator_code"), F.year("o_orderdate").alias("year"))


@query(
    "lookup_retrieve_value",
    f"WITH {O.OBS}, a AS (SELECT o_orderkey, CAST(o_orderkey % 27 AS VARCHAR) AS code, o_orderpriority || '|' || CASE WHEN o_orderkey % 11 = 0 THEN 'NONE' ELSE c_mktsegment END AS property, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders JOIN customer ON c_custkey = o_custkey) SELECT a.o_orderkey, a.code AS country_code, a.property AS indicator_code, a.year, o.value, CASE WHEN a.code NOT IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation) THEN 'invalid_country' WHEN a.property NOT IN (SELECT property FROM obs) THEN 'invalid_indicator' WHEN o.value IS NULL THEN 'no_data' ELSE 'ok' END AS status FROM a LEFT JOIN obs o ON o.code = a.code AND o.property = a.property AND o.year = a.year",
)
def lookup_retrieve_value(spark, sf_dir):
    cube = _cube(spark, sf_dir)
    return lookup.retrieve_value(_order_asks(spark, sf_dir), cube.geo, cube.observations).select("o_orderkey", "country_code", "indicator_code", "year", "value", "status")


def _table_functions(spark, sf_dir) -> None:
    cube = star.cube(spark, sf_dir)
    register_tables(spark, cube.geo, _indicators(spark, sf_dir), cube.observations)


@query("sql_region_members", "SELECT r_name, CAST(n_nationkey AS INTEGER) AS pos, CAST(n_nationkey AS VARCHAR) AS country_code FROM region JOIN nation ON n_regionkey = r_regionkey")
def sql_region_members(spark, sf_dir):
    _table_functions(spark, sf_dir)
    return spark.sql("SELECT r_name, m.pos, m.country_code FROM {r} LEFT JOIN LATERAL tool_region_members(r_name) m", r=star.table(spark, sf_dir, "region"))


@query("sql_retrieve_value", ORACLE["lookup_retrieve_value"])
def sql_retrieve_value(spark, sf_dir):
    _table_functions(spark, sf_dir)
    return spark.sql("SELECT a.*, v.value, v.status FROM {a} a, LATERAL tool_retrieve_value(a.country_code, a.indicator_code, a.year) v", a=_order_asks(spark, sf_dir))


@query("sql_search_names", "WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part) SELECT w, n AS keyword_no, CASE n WHEN 0 THEN upper(w) ELSE 'gear' END AS keyword, CAST(p_partkey AS VARCHAR) AS indicator_code FROM w, range(2) r(n), part WHERE list_contains(string_split(lower(p_name), ' '), CASE n WHEN 0 THEN w ELSE 'gear' END)")
def sql_search_names(spark, sf_dir):
    _table_functions(spark, sf_dir)
    first = star.table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", 1).alias("w")).distinct()
    return spark.sql("SELECT w, s.keyword_no, s.keyword, s.indicator_code FROM {w}, LATERAL tool_search_names(array(upper(w), 'gear')) s", w=first)


@query(
    "lookup_search_names",
    """WITH q AS (SELECT 1 AS query_id, 'cold, gear' AS keywords UNION ALL SELECT 2, '[''Widget'', ''hot red'']' UNION ALL SELECT 3, 'small ring' UNION ALL SELECT 4, 'nothing'),
i AS (SELECT CAST(p_partkey AS VARCHAR) AS indicator_code, p_name AS indicator_name, p_type AS indicator_description FROM part),
w AS (SELECT DISTINCT query_id, 0 AS keyword_no, keywords AS keyword, i.* FROM q JOIN i ON lower(indicator_name) = keywords),
k AS (SELECT * FROM (VALUES (1, 0, 'cold'), (1, 1, 'gear'), (2, 0, 'Widget'), (2, 1, 'hot'), (2, 2, 'red'), (4, 0, 'nothing')) v(query_id, keyword_no, keyword))
SELECT * FROM w UNION ALL SELECT k.query_id, k.keyword_no, k.keyword, i.* FROM k JOIN i ON list_contains(string_split(lower(indicator_name), ' '), lower(keyword))""",
)
def lookup_search_names(spark, sf_dir):
    args = spark.createDataFrame([(1, "cold, gear"), (2, "['Widget', 'hot red']"), (3, "small ring"), (4, "nothing")], "query_id int, keywords string")
    return lookup.search_names(args, _indicators(spark, sf_dir))


# ------------------------------------------------------------------ cells kept by key, files, logs


@query(
    "cells_keyed_lookup",
    f"WITH {O.OBS} SELECT o_orderkey, a.code AS country_code, a.property AS indicator_code, a.year, o.value FROM (SELECT o_orderkey, CAST(o_orderkey % 27 AS VARCHAR) AS code, o_orderpriority || '|' || CASE WHEN o_orderkey % 11 = 0 THEN 'NONE' ELSE c_mktsegment END AS property, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders JOIN customer ON c_custkey = o_custkey) a LEFT JOIN obs o ON o.code = a.code AND o.property = a.property AND o.year = a.year",
)
def cells_keyed_lookup(spark, sf_dir):
    """The cell that every order asks for, from the cube stored by key."""
    kept = keyed.keep(star.cube(spark, sf_dir))
    return kept.values(_order_asks(spark, sf_dir)).select("o_orderkey", "country_code", "indicator_code", "year", "value")


def _keyed_template(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = star.cube(spark, sf_dir)
    return answer(_questions(cube, name), keyed.keep(cube), name).drop("question_id")


for _t in ("RegionComparison", "SubjectPropertyChange"):
    query(f"cells_keyed_{_NAMES[_t].removeprefix('t_')}", O.TEMPLATE_SQL[_t])(partial(_keyed_template, _t))


@query("cells_keyed_update", f"WITH {O.OBS} SELECT property AS indicator_code, code AS country_code, year, CASE WHEN year % 2 = 0 THEN -value ELSE value END AS value FROM obs")
def cells_keyed_update(spark, sf_dir):
    """Odd years are stored first, then all with another sign, then the even years put over the odd ones' table."""
    cube = star.cube(spark, sf_dir)
    part = lambda where, sign: cube.observations.where(where).withColumn("value", sign * C("value"))
    kept = keyed.keep(type(cube)(cube.geo, part("year % 2 = 1", 1).unionByName(part("year % 2 = 0 AND country_code < '5'", 1))))
    kept.update(part("year % 2 = 0", -1))
    return kept.series().select("indicator_code", "country_code", F.explode("by_year").alias("year", "value"))


@query("source_wide_files", f"WITH {O.OBS} SELECT property AS indicator_code, code AS country_code, year, value FROM obs WHERE split_part(property, '|', 1) LIKE '%H%' AND year BETWEEN 1996 AND 1999")
def source_wide_files(spark, sf_dir):
    """The cube written as wide files, one an indicator, and read back: only the files and years asked for."""
    observations = star.observations(spark, sf_dir)
    folder = new_folder(spark, "wide")
    stores.write_wide(observations, folder)
    # the indicators asked for, a catalogue's handful of names
    asked = [r.indicator_code for r in observations.select("indicator_code").where("split_part(indicator_code, '|', 1) LIKE '%H%'").distinct().collect()]
    return stores.read_wide(spark, folder).where(C("indicator_code").isin(asked) & C("year").between(1996, 1999) & C("value").isNotNull())


@query("sink_epochs", "SELECT event_id, user_id, event_type, event_id % 4 AS part FROM events")
def sink_epochs(spark, sf_dir):
    """Events appended in four epochs, some of them twice, and a run taken up again over all."""
    e = star.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (C("event_id") % 4).alias("part"))
    folder = new_folder(spark, "log")
    for part in (0, 1, 1, 2, 0):
        stores.append_epoch(e.where(C("part") == part), folder, f"part-{part}")
    sinks.append_new(e, folder, "event_id", "rest")
    sinks.append_new(e, folder, "event_id", "rest")
    return stores.read_log(spark, folder)


@query("index_search_names", f"{ORACLE['lookup_search_names']}")
def index_search_names(spark, sf_dir):
    """The searches of ``lookup_search_names`` by an index: a first batch with some names that the second replaces, then all others."""
    index, every = SearchIndex(spark, f"karst_{uuid.uuid4().hex}"), _indicators(spark, sf_dir)
    atexit.register(keyed.forget, index)
    index.add(every.where("id % 3 = 0").withColumn("name", F.when(C("id") % 2 == 0, F.lit("cold small ring")).otherwise(C("name"))))
    index.add(every.where("id % 3 > 0 OR id % 2 = 0"))
    args = spark.createDataFrame([(1, "cold, gear"), (2, "['Widget', 'hot red']"), (3, "small ring"), (4, "nothing")], "query_id int, keywords string")
    return index.search(args)


# ------------------------------------------------------------------ questions


@query("gen_slot_domains", f"WITH {O.OBS} SELECT 'subject' AS slot, CAST(count(*) AS BIGINT) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'property', count(DISTINCT property) FROM obs UNION ALL SELECT 'year', 20 UNION ALL SELECT 'n', 4 UNION ALL SELECT 'operator', 2 UNION ALL SELECT 'aggregation', 3")
def gen_slot_domains(spark, sf_dir):
    cube = _cube(spark, sf_dir)
    parts = [Q.domain(cube, s).agg(F.lit(s).alias("slot"), F.count("*").alias("n")) for s in ("subject", "region", "property", "year", "n", "operator", "aggregation")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _each_template(build: Callable[[str], DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, map(build, TEMPLATES))


_N_VALID = {
    "PropertyOfSubject": "p * s * y", "SubjectPropertyChange": "p * s * y * (y - 1) // 2", "AverageChange": "p * s * y3", "CountryPropertyComparison": "p * s * (s - 1) * y * (y - 1) * 2",
    "PropertyRatioComparison": "p * s * (s - 1) * y", "AverageProperty": "p * r * y", "TotalProperty": "p * r * y", "RegionPropertyRatio": "p * r * y", "RegionComparison": "p * r * y * 2",
    "RegionComparisonResult": "p * r * 2 * y * (y - 1)", "RegionPropertyChange": "p * r * 2 * y * (y - 1)", "TopNTotal": "p * r * y * 8", "SubjectPropertyRank": "p * s * y",
    "RankChange": "p * s * y * (y - 1)", "RegionProportion": "p * s * y", "RegionProportionChange": "p * s * 2 * y * (y - 1)", "AveragePropertyComparison": "p * s * r * 2 * y",
    "RegionAverageComparison": "p * r * (r - 1) * 2 * y", "RegionRangeComparison": "p * r * (r - 1) * 2 * y", "CountryThresholdCount": "p * s * (r - 1) * 2 * y",
}


@query(
    "gen_valid_combinations",
    f"WITH {O.OBS}, n AS (SELECT (SELECT count(DISTINCT property) FROM obs) AS p, (SELECT count(DISTINCT year) FROM obs) AS y, (SELECT count(*) FROM region) AS r, (SELECT count(*) FROM nation) AS s, (SELECT count(*) FROM (SELECT DISTINCT year FROM obs) a JOIN (SELECT DISTINCT year FROM obs) b ON b.year - a.year >= 3) AS y3) "
    + " UNION ALL ".join(f"SELECT '{t}' AS template, CAST({n} AS BIGINT) AS n FROM n" for t, n in _N_VALID.items()),
)
def gen_valid_combinations(spark, sf_dir):
    cube = _cube(spark, sf_dir)
    return _each_template(lambda t: _questions(cube, t).agg(F.lit(t).alias("template"), F.count("*").alias("n")))


def _rendered_sql(name: str) -> str:
    """Every question's text: the wording and the paraphrase chosen by digests of its slots."""
    t = TEMPLATES[name]
    slots = ", ".join(t.slots)
    key = "sha256(concat_ws('|', '" + name + "', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in t.slots) + "))"
    draw = lambda salt, n: f"CAST('0x' || substr(md5(concat_ws('|', id, '{salt}0')), 1, 15) AS BIGINT) % {n}"
    text = f"[{', '.join(_literal(w) for w in t.wording)}][{draw('w', len(t.wording))} + 1]"
    for c in t.slots:
        shown = f"(SELECT n_name FROM nation WHERE CAST(n_nationkey AS VARCHAR) = {c})" if c.startswith("subject") else f"CASE {draw('p', 2)} WHEN 0 THEN lower(property) ELSE 'the ' || property END" if c == "property" else f"CAST({c} AS VARCHAR)"
        text = f"replace({text}, '{{{c}}}', {shown})"
    return f"SELECT '{name}' AS template, {text} AS question FROM (SELECT {slots}, {key} AS id FROM ({O.TEMPLATE_SQL[name]}))"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The low 32 bits of a text's digest, to be summed.
_DIGEST = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"


def _digest(text: str) -> Column:
    return F.conv(F.substring(F.md5(C(text)), 1, 8), 16, 10).cast("long")


@query("gen_rendered_questions", "SELECT template, CAST(count(*) AS BIGINT) AS n, CAST(sum(" + _DIGEST.format("question") + ") AS BIGINT) AS digest FROM (" + " UNION ALL ".join(map(_rendered_sql, TEMPLATES)) + ") GROUP BY 1")
def gen_rendered_questions(spark, sf_dir):
    """The texts of all questions of every template, told by the sum of their digests."""
    cube = _cube(spark, sf_dir)
    names = cube.observations.select(C("indicator_code").alias("id"), C("indicator_code").alias("name")).distinct().withColumn("paraphrase", F.array(F.lower("id"), F.concat(F.lit("the "), "id")))
    one = lambda t: Q.render(_questions(cube, t), t, cube.geo, names).agg(F.lit(t).alias("template"), F.count("*").alias("n"), F.sum(_digest("question")).alias("digest"))
    return _each_template(one)


_SPLIT_OF = "CASE WHEN answerable AND data_availability = 'full' THEN 'answerable-full' WHEN answerable AND data_availability = 'partial' THEN 'answerable-partial' WHEN NOT answerable AND data_availability = 'partial' THEN 'unanswerable-partial' WHEN NOT answerable AND data_availability = 'missing' THEN 'unanswerable-missing' END"


@query("gen_split_counts", " UNION ALL ".join(f"SELECT '{t}' AS template, {_SPLIT_OF} AS split, CAST(count(*) AS BIGINT) AS n FROM ({O.TEMPLATE_SQL[t]}) x GROUP BY 1, 2" for t in TEMPLATES))
def gen_split_counts(spark, sf_dir):
    cube = _cube(spark, sf_dir)
    return _each_template(lambda t: answer(_questions(cube, t), cube, t).groupBy(F.lit(t).alias("template"), Q.split_of().alias("split")).agg(F.count("*").alias("n")))


def _drawn_sql(name: str) -> str:
    key = "sha256(concat_ws('|', '" + name + "', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in TEMPLATES[name].slots) + "))"
    skipped = ", ".join(f"'{s}'" for t, s in SKIPPED if t == name) or "''"
    return f"SELECT '{name}' AS question_template, id AS question_id, split, answerable, data_availability FROM (SELECT {key} AS id, {_SPLIT_OF} AS split, answerable, data_availability FROM ({O.TEMPLATE_SQL[name]})) WHERE split IS NOT NULL AND split NOT IN ({skipped}) QUALIFY row_number() OVER (PARTITION BY split ORDER BY sha256(concat_ws('|', id, '0')), id) <= 2"


@query("gen_examples", " UNION ALL ".join(map(_drawn_sql, TEMPLATES)))
def gen_examples(spark, sf_dir):
    """Two examples for each template and split (a sampling operator)."""
    cube = _cube(spark, sf_dir)
    return Q.examples(cube, list(TEMPLATES), 2, _years(cube)).select("question_template", "question_id", "split", "answerable", "data_availability")


@query("gen_suffix_filter", "SELECT event_id, 'EV.' || upper(event_type) || '.' || ['KD', 'PC', 'ZS.X', 'TOTL'][event_id % 4 + 1] AS code FROM events WHERE event_id % 4 IN (0, 3)")
def gen_suffix_filter(spark, sf_dir):
    ends = F.array(*map(F.lit, ["KD", "PC", "ZS.X", "TOTL"]))
    coded = star.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("EV."), F.upper("event_type"), F.lit("."), F.get(ends, (C("event_id") % 4).cast("int"))).alias("code"))
    return coded.where(~X.suffix_coded(C("code"), X.DERIVED))


@query("gen_region_backoff", "SELECT s_suppkey, coalesce(nullif(s_nationkey % 3, 0), nullif(s_nationkey % 2, 0), 7) AS region FROM supplier")
def gen_region_backoff(spark, sf_dir):
    s = star.table(spark, sf_dir, "supplier").select("s_suppkey", F.nullif(C("s_nationkey") % 3, F.lit(0)).alias("a"), F.nullif(C("s_nationkey") % 2, F.lit(0)).alias("b"), F.lit(7).alias("c"))
    return files.region_backoff(s, "a", "b", "c").select("s_suppkey", "region")


@query("gen_gold_actions", O.GOLD_ACTIONS)
def gen_gold_actions(spark, sf_dir):
    """How many questions of every template have traces of each length and last call (the tests compare whole traces)."""
    cube = _cube(spark, sf_dir)
    names = cube.observations.select(C("indicator_code").alias("property"), C("indicator_code").alias("property_original")).distinct()

    def traced(t: str) -> DataFrame:
        got = gold_actions(_questions(cube, t), cube, t, names).select(F.size("actions").alias("n_actions"), F.element_at("actions", -1)["name"].alias("last_action"))
        return got.groupBy(F.lit(t).alias("template"), "n_actions", "last_action").agg(F.count("*").alias("n"))

    return _each_template(traced)


# ------------------------------------------------------------------ shapes


@query("shape_pivot_wide", f"WITH {O.OBS} SELECT property AS indicator_code, code AS country_code, " + ", ".join(f'max(value) FILTER (WHERE year = {y}) AS "{y}"' for y in range(1992, 2025)) + " FROM obs GROUP BY 1, 2")
def shape_pivot_wide(spark, sf_dir):
    """A column for each year that the format knows, 1992 to 2024."""
    return files.pivot_wide(star.observations(spark, sf_dir), list(range(1992, 2025)))


@query("shape_unpivot_long", f"WITH {O.OBS} SELECT property AS indicator_code, code AS country_code, year, value FROM obs")
def shape_unpivot_long(spark, sf_dir):
    return files.unpivot_long(shape_pivot_wide(spark, sf_dir), ["indicator_code", "country_code"])


@query("shape_upsert_merge", "WITH n AS (SELECT c_custkey + 100 AS k, c_acctbal * 2 AS v FROM customer WHERE c_custkey % 2 = 0), o AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer) SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.v ELSE o.v END AS v FROM o FULL JOIN n ON o.k = n.k")
def shape_upsert_merge(spark, sf_dir):
    old = star.table(spark, sf_dir, "customer").select(C("c_custkey").alias("k"), C("c_acctbal").alias("v"))
    new = old.where("k % 2 = 0").select((C("k") + 100).alias("k"), (C("v") * 2).alias("v"))
    return files.upsert(old, new, "k")


@query("shape_resume_antijoin", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def shape_resume_antijoin(spark, sf_dir):
    done = star.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(C("o_custkey").alias("c_custkey"))
    return files.pending(star.table(spark, sf_dir, "customer"), done, "c_custkey").select("c_custkey", "c_name")


_LINKED = "SELECT page_id, replace(html, 'href=\"/', 'href=\"/indicator/') AS html FROM pages"


@query("scrape_links", f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=["\'\']([^"\'\']+)["\'\']', 1)) AS h FROM ({_LINKED})) SELECT page_id, string_split(h, '?')[1] AS link FROM l WHERE h LIKE '/indicator/%' AND len(string_split(string_split(h, '?')[1], '/')) = 3""")
def scrape_links(spark, sf_dir):
    pages = star.table(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit('href="/'), F.lit('href="/indicator/')))
    return files.links(pages, "/indicator/")


# ------------------------------------------------------------------ scoring


def _event_calls(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = star.table(spark, sf_dir, "events")
    k = (F.regexp_extract("props", r"(\d+)", 1).cast("long") % 7).cast("string")
    calls = e.select(C("user_id").cast("string").alias("row_id"), C("event_id").alias("pos"), C("event_type").alias("name"), F.create_map(F.lit("k"), k).alias("arguments"), F.dayofmonth("ts").alias("d"))
    return calls.where("d % 2 = 1").drop("d"), calls.where("d % 2 = 0").drop("d")


def _counts(column: str, spark, sf_dir) -> DataFrame:
    return scoring.compare(*_event_calls(spark, sf_dir)).where(C(column) > 0).select("row_id", "call", C(column).alias("n"))


for _n, _s in [("true_positives", "least(p, g)"), ("false_positives", "greatest(p - g, 0)"), ("false_negatives", "greatest(g - p, 0)")]:
    query(f"score_{_n}", f"{O.EVENT_CALLS} SELECT row_id, call, CAST({_s} AS BIGINT) AS n FROM n WHERE {_s} > 0")(partial(_counts, _n))


@query("score_precision_recall", f'{O.EVENT_CALLS} SELECT row_id, CAST(sum(least(p, g)) AS BIGINT) AS true_positives, CAST(sum(greatest(p - g, 0)) AS BIGINT) AS false_positives, CAST(sum(greatest(g - p, 0)) AS BIGINT) AS false_negatives, coalesce(sum(least(p, g)) / nullif(sum(p), 0), 0) AS precision, coalesce(sum(least(p, g)) / nullif(sum(g), 0), 1) AS coverage FROM n GROUP BY 1')
def score_precision_recall(spark, sf_dir):
    return scoring.precision_recall(scoring.compare(*_event_calls(spark, sf_dir)))


@query("score_set_jaccard", f"{O.EVENT_CALLS}, s AS (SELECT row_id, count(*) FILTER (WHERE p > 0 AND g > 0) AS b, count(*) FILTER (WHERE p > 0) AS p, count(*) FILTER (WHERE g > 0) AS g, count(*) AS e FROM n GROUP BY 1) SELECT row_id, coalesce(b / nullif(p, 0), 0) AS set_precision, coalesce(b / nullif(g, 0), 0) AS set_recall, coalesce(b / nullif(e, 0), 0) AS set_jaccard FROM s")
def score_set_jaccard(spark, sf_dir):
    return scoring.set_scores(*_event_calls(spark, sf_dir))


@query("score_process_check", f"""{O.EVENT_CALLS} SELECT row_id, bool_and(p > 0) AS correct_process FROM n WHERE g > 0 AND call LIKE 'view(%' GROUP BY 1""")
def score_process_check(spark, sf_dir):
    rename = lambda df: df.withColumn("name", F.when(C("name") == "view", "get_country_code_from_name").otherwise(C("name")))
    pred, gold = _event_calls(spark, sf_dir)
    return scoring.right_process(rename(pred), rename(gold))


def _runs(spark, sf_dir) -> DataFrame:
    """A run a user: every event is an assistant's message with one call and the tool's message that answers it."""
    k, user = F.regexp_extract("props", r"(\d+)", 1).cast("long"), C("user_id")
    e = star.table(spark, sf_dir, "events").withColumns({"k": k, "id": C("event_id").cast("string")})
    pair = lambda a, x, b, y: F.create_map(F.lit(a), x.cast("string"), F.lit(b), y.cast("string"))
    one = lambda a, x: F.create_map(F.lit(a), x)
    kind = C("event_type")
    name = F.when(kind == "view", "less_than").when(kind == "click", "search_for_indicator_names").when(kind == "purchase", "final_answer").when(kind == "signup", "retrieve_value").otherwise("add")
    arguments = (
        F.when(kind == "view", pair("value_a", C("k") % 7, "value_b", user % 7)).when(kind == "click", one("keywords", F.concat(F.lit("K"), (C("k") % 10).cast("string"))))
        .when(kind == "purchase", one("answer", C("k").cast("string"))).when(kind == "signup", one("indicator_code", F.concat(F.lit("I"), (C("k") % 3).cast("string")))).otherwise(one("values", F.concat(F.lit("["), C("k").cast("string"), F.lit(", 1]"))))
    )
    found = F.concat(F.lit('[{"indicator_name": "P'), (C("k") % 10).cast("string"), F.lit('"}]'))
    result = F.when(kind == "click", found).when(kind == "error", "Error: failed").otherwise(C("k").cast("string"))
    no, none = F.lit(None).cast("string"), F.lit(None)
    call = F.struct("id", F.lit("function").alias("type"), F.struct(name.alias("name"), arguments.alias("arguments")).alias("function"))
    asks = F.struct(F.lit("assistant").alias("role"), no.alias("content"), no.alias("tool_call_id"), no.alias("name"), F.array(call).alias("tool_calls"))
    says = F.struct(F.lit("tool").alias("role"), result.alias("content"), C("id").alias("tool_call_id"), name.alias("name"), none.alias("tool_calls"))
    by_id = lambda a, b: (a["event_id"] - b["event_id"]).cast("int")
    listed = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.array(asks, says).alias("m"))), by_id).alias("l"))
    slots = pair("property_original", F.concat(F.lit("P"), (user % 10).cast("string")), "property", F.concat(F.lit("I"), (user % 3).cast("string")))
    return listed.select(user.cast("string").alias("id"), slots.alias("slot_values"), F.flatten(F.transform("l", lambda x: x["m"])).alias("messages"))


_RUNS = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS row_id, user_id, event_id, event_type, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
r AS (SELECT *, CASE event_type WHEN 'view' THEN 'less_than' WHEN 'click' THEN 'search_for_indicator_names' WHEN 'purchase' THEN 'final_answer' WHEN 'signup' THEN 'retrieve_value' ELSE 'add' END AS name,
  CASE event_type WHEN 'click' THEN '[{"indicator_name": "P' || CAST(k % 10 AS VARCHAR) || '"}]' WHEN 'error' THEN 'Error: failed' ELSE CAST(k AS VARCHAR) END AS result FROM e),
p AS (SELECT row_id, user_id, event_id, k, CAST(i * 2000 AS BIGINT) AS pos, CASE WHEN name = 'less_than' THEN 'greater_than' ELSE name END AS name, result,
  CASE name WHEN 'less_than' THEN '{"value_a":"' || CAST(user_id % 7 AS VARCHAR) || '","value_b":"' || CAST(k % 7 AS VARCHAR) || '"}'
    WHEN 'search_for_indicator_names' THEN '{"keywords":"' || CASE WHEN k % 10 = user_id % 10 THEN 'P' ELSE 'K' END || CAST(k % 10 AS VARCHAR) || '"}'
    WHEN 'retrieve_value' THEN '{"indicator_code":"I' || CAST(k % 3 AS VARCHAR) || '"}' ELSE '{"values":"[' || CAST(k AS VARCHAR) || ', 1]"}' END AS arguments FROM r WHERE name <> 'final_answer')"""


@query("score_predicted_calls", f"{_RUNS} SELECT row_id, pos, name, arguments, result FROM p")
def score_predicted_calls(spark, sf_dir):
    return scoring.predicted_calls(_runs(spark, sf_dir)).withColumn("arguments", F.to_json("arguments"))


#: Arguments of many types: which each event's call gives, and which it should give.
_TYPED = """WITH e AS (SELECT event_id, user_id, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) % 3 AS k, event_id % 6 AS t, (event_id // 6) % 4 AS u FROM events),
j AS (SELECT user_id, k, t AS kind, CASE t WHEN 0 THEN 'int:' || k WHEN 1 THEN 'text:"' || k || '"' WHEN 2 THEN 'float:' || k || '.0' WHEN 3 THEN 'bool:true' WHEN 4 THEN 'null' ELSE '[int:' || k || ',text:"x",float:0.5]' END AS p,
  CASE WHEN u = 0 THEN 'int:' || k WHEN u = 1 THEN CASE t WHEN 0 THEN 'int:' || k WHEN 1 THEN 'text:"' || k || '"' WHEN 2 THEN 'float:' || k || '.0' WHEN 3 THEN 'bool:true' WHEN 4 THEN 'null' ELSE '[int:' || k || ',text:"x",float:0.5]' END WHEN u = 2 THEN 'float:' || k || '.0' ELSE 'bool:true' END AS g FROM e),
p AS (SELECT user_id AS row_id, p AS v, count(*) AS p FROM j GROUP BY 1, 2), g AS (SELECT user_id AS row_id, g AS v, count(*) AS g FROM j GROUP BY 1, 2)"""


def _typed_calls(spark, sf_dir) -> DataFrame:
    e = star.table(spark, sf_dir, "events").select("user_id", (F.regexp_extract("props", r"(\d+)", 1).cast("long") % 3).cast("string").alias("k"), (C("event_id") % 6).alias("t"), (F.floor(C("event_id") / 6) % 4).alias("u"))
    own = F.when(C("t") == 0, C("k")).when(C("t") == 1, F.concat(F.lit('"'), "k", F.lit('"'))).when(C("t") == 2, F.concat("k", F.lit(".00"))).when(C("t") == 3, "true").when(C("t") == 4, "null").otherwise(F.concat(F.lit("["), "k", F.lit(', "x", 5e-1]')))
    gold = F.when(C("u") == 0, C("k")).when(C("u") == 1, own).when(C("u") == 2, F.concat("k", F.lit(".0"))).otherwise("true")
    side = lambda v: typed.parse(F.concat(F.lit('{"y": 1, "x": '), v, F.lit("}")))
    return e.select(C("user_id").alias("row_id"), F.lit("tool").alias("name"), side(own).alias("pred"), side(gold).alias("gold"))


@query("score_typed_calls", f"{_TYPED} SELECT row_id, 'tool({{\"x\":' || v || ',\"y\":int:1}})' AS call, least(coalesce(p, 0), coalesce(g, 0)) AS true_positives, greatest(coalesce(p, 0) - coalesce(g, 0), 0) AS false_positives, greatest(coalesce(g, 0) - coalesce(p, 0), 0) AS false_negatives FROM p FULL JOIN g USING (row_id, v)")
def score_typed_calls(spark, sf_dir):
    """Calls whose arguments keep their types, written as variants, read back and compared as multisets."""
    folder = new_folder(spark, "typed")
    _typed_calls(spark, sf_dir).write.parquet(folder)
    calls = spark.read.schema("row_id long, name string, pred variant, gold variant").parquet(folder)
    return scoring.compare(calls.select("row_id", "name", C("pred").alias("arguments")), calls.select("row_id", "name", C("gold").alias("arguments")))


@query("score_gold_calls", f"{_RUNS} SELECT row_id, i AS pos, name, CASE name WHEN 'retrieve_value' THEN 'I' || CAST(k % 3 AS VARCHAR) WHEN 'add' THEN '[' || CAST(k AS VARCHAR) || ', 1]' END AS argument FROM (SELECT *, CAST(i AS INTEGER) AS i2 FROM r) WHERE name IN ('retrieve_value', 'add')")
def score_gold_calls(spark, sf_dir):
    flat = F.transform(F.filter("messages", lambda m: m["tool_calls"].isNotNull()), lambda m: F.get(m["tool_calls"], F.lit(0))["function"])
    gold = scoring.gold_calls(_runs(spark, sf_dir).select("id", flat.alias("actions")), ["retrieve_value", "add"])
    return gold.select("row_id", C("pos").cast("long").alias("pos"), "name", F.coalesce(F.try_element_at("arguments", F.lit("indicator_code")), F.try_element_at("arguments", F.lit("values"))).alias("argument"))


@query("score_error_made", f"{_RUNS} SELECT row_id AS id, bool_or(result LIKE 'Error:%') AS error_made, bool_or(name = 'final_answer') AS has_final_answer FROM r GROUP BY 1")
def score_error_made(spark, sf_dir):
    return _runs(spark, sf_dir).select("id", scoring.error_made(C("messages")).alias("error_made"), rows.has_final_answer(C("messages")).alias("has_final_answer"))


@query("score_wrong_indicator", f"{_RUNS} SELECT row_id, bool_or(k % 3 <> user_id % 3) AS wrong_indicator FROM r WHERE name = 'retrieve_value' GROUP BY 1")
def score_wrong_indicator(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    slots = runs.select(C("id").alias("row_id"), F.element_at("slot_values", "property").alias("property"))
    return scoring.wrong_indicator(scoring.predicted_calls(runs), slots)


@query("score_legacy", f"{_RUNS}, a AS (SELECT row_id, arg_min(result, event_id) FILTER (WHERE name = 'final_answer') AS answer, string_agg(name, ',' ORDER BY event_id) AS calls, any_value(user_id) AS u FROM r GROUP BY 1) SELECT row_id AS id, answer, calls, coalesce(CASE WHEN u % 2 = 0 THEN contains(answer, CAST(u % 10 AS VARCHAR)) ELSE answer = CAST(u % 10 AS VARCHAR) END, FALSE) AS correct FROM a")
def score_legacy(spark, sf_dir):
    answer, gold = scoring.legacy_answer(C("messages")), (C("id").cast("long") % 10).cast("string")
    kind = F.when(C("id").cast("long") % 2 == 0, "float").otherwise("str")
    calls = F.array_join(F.transform(scoring.legacy_calls(C("messages"), clean=True), lambda c: c["name"]), ",")
    return _runs(spark, sf_dir).select("id", answer.alias("answer"), calls.alias("calls"), scoring.legacy_correct(answer, gold, kind).alias("correct"))


def _scored(spark, sf_dir) -> DataFrame:
    e = star.table(spark, sf_dir, "events")
    per = e.groupBy(C("user_id").alias("id")).agg(F.count_if(C("event_type") == "error").alias("errors"), F.count_if(C("event_type") == "purchase").alias("bought"), F.count("*").alias("n"))
    return per.select("id", (C("id") % 4).cast("long").alias("run"), (C("errors") > 12).alias("error_made"), (C("bought") > 13).alias("correct"), (C("bought") / C("n")).alias("precision"), (C("errors") / C("n")).alias("coverage"))


_SCORED = "WITH s AS (SELECT user_id AS id, CAST(user_id % 4 AS BIGINT) AS run, count(*) FILTER (WHERE event_type = 'error') > 12 AS error_made, count(*) FILTER (WHERE event_type = 'purchase') > 13 AS correct, count(*) FILTER (WHERE event_type = 'purchase') / count(*) AS precision, count(*) FILTER (WHERE event_type = 'error') / count(*) AS coverage FROM events GROUP BY 1)"


@query("score_error_rate", f"{_SCORED} SELECT run, avg(CAST(error_made AS DOUBLE)) AS error_rate FROM s GROUP BY 1")
def score_error_rate(spark, sf_dir):
    return scoring.summary(_scored(spark, sf_dir)).select("run", "error_rate")


@query("score_summary_by_run", f"{_SCORED} SELECT run, CAST(count(*) AS BIGINT) AS n, avg(CAST(correct AS DOUBLE)) AS accuracy, round(avg(precision), 5) AS precision_mean, round(stddev_samp(precision), 5) AS precision_std, round(avg(coverage), 5) AS coverage_mean, round(stddev_samp(coverage), 5) AS coverage_std, avg(CAST(error_made AS DOUBLE)) AS error_rate FROM s GROUP BY 1")
def score_summary_by_run(spark, sf_dir):
    s = scoring.summary(_scored(spark, sf_dir))
    return s.select("run", "n", "accuracy", *(F.round(c, 5).alias(c) for c in ("precision_mean", "precision_std", "coverage_mean", "coverage_std")), "error_rate")


@query("score_conditional_prob", f"{_SCORED} SELECT run, count(*) FILTER (WHERE correct AND error_made) / greatest(count(*) FILTER (WHERE error_made), 1) AS p FROM s GROUP BY 1")
def score_conditional_prob(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("run").agg(scoring.conditional(C("correct"), C("error_made")).alias("p"))


@query("score_crosstab", "SELECT CAST(quality AS INTEGER) AS quality, CAST(count(*) FILTER (WHERE toxic = 0) AS BIGINT) AS \"0\", CAST(count(*) FILTER (WHERE toxic = 1) AS BIGINT) AS \"1\" FROM labels GROUP BY 1")
def score_crosstab(spark, sf_dir):
    return scoring.crosstab(star.table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1])


@query("score_value_counts", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type")
def score_value_counts(spark, sf_dir):
    return rows.value_counts(star.table(spark, sf_dir, "events"), "event_type")


@query(
    "agent_stop_rules",
    """WITH c AS (SELECT user_id AS conv, event_id AS pos, event_type || CAST(CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) % 7 AS VARCHAR) AS key, CASE WHEN event_type = 'purchase' AND event_id % 40 = 0 THEN 'final_answer' ELSE event_type END AS name FROM events),
s AS (SELECT *, count(*) OVER (PARTITION BY conv ORDER BY pos ROWS UNBOUNDED PRECEDING) AS total, count(*) OVER (PARTITION BY conv, key ORDER BY pos ROWS UNBOUNDED PRECEDING) AS alike FROM c),
r AS (SELECT conv, pos, CASE WHEN total >= 60 THEN 'budget' WHEN name = 'final_answer' THEN 'final_answer' WHEN alike >= 6 THEN 'repeated' END AS rule FROM s)
SELECT conv, min(pos) AS stopped_at, arg_min(rule, pos) AS rule FROM r WHERE rule IS NOT NULL GROUP BY 1""",
)
def agent_stop_rules(spark, sf_dir):
    return scoring.stop_rules(_timed_calls(spark, sf_dir), most=60, same=6)


def _timed_calls(spark, sf_dir) -> DataFrame:
    e = star.table(spark, sf_dir, "events")
    k = (F.regexp_extract("props", r"(\d+)", 1).cast("long") % 7).cast("string")
    name = F.when((C("event_type") == "purchase") & (C("event_id") % 40 == 0), "final_answer").otherwise(C("event_type"))
    return e.select(C("user_id").alias("conv"), C("event_id").alias("pos"), F.concat("event_type", k).alias("key"), name.alias("name"), C("ts").cast("timestamp").alias("ts"))


@query("stream_stop_rules", ORACLE["agent_stop_rules"])
def stream_stop_rules(spark, sf_dir):
    """The same rules over the calls as they arrive, week by week; the query is started anew for each week on one checkpoint."""
    calls, folder = _timed_calls(spark, sf_dir).withColumn("week", F.weekofyear("ts")), new_folder(spark, "stops")
    for week in range(1, 6):
        calls.where(C("week") == week).drop("week").write.parquet(f"{folder}/in/{week}")
        stream = spark.readStream.schema(calls.drop("week").schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        ended = stops.stops(stream, most=60, same=6, late="1 day", idle_seconds=40 * 86_400)
        q = ended.writeStream.option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(ended.schema).parquet(f"{folder}/out")


# ------------------------------------------------------------------ matching


def _matched(kind: str, args: Callable[[SparkSession, str], DataFrame], spark, sf_dir) -> DataFrame:
    rows = args(spark, sf_dir).withColumn("answer_format", F.lit(kind))
    return matcher.match(rows, star.geo(spark, sf_dir)).select("id", "pred", "gold", "correct", "error")


def _float_rows(spark, sf_dir) -> DataFrame:
    o, p = star.table(spark, sf_dir, "orders"), C("o_totalprice")
    k = C("o_orderkey") % 5
    pred = F.when(k == 0, p.cast("string")).when(k == 1, F.concat(F.lit("about "), p.cast("string"), F.lit(" units"))).when(k == 2, (F.round(p) * 1.0).cast("string")).when(k == 3, (p + 50).cast("string")).otherwise("no idea 17")
    return o.select(C("o_orderkey").alias("id"), pred.alias("pred"), p.cast("string").alias("gold"))


_FLOAT_ROWS = "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_totalprice AS VARCHAR) WHEN 1 THEN 'about ' || CAST(o_totalprice AS VARCHAR) || ' units' WHEN 2 THEN CAST(round(o_totalprice) AS VARCHAR) WHEN 3 THEN CAST(o_totalprice + 50 AS VARCHAR) ELSE 'no idea 17' END AS pred, CAST(o_totalprice AS VARCHAR) AS gold FROM orders"
query(
    "match_float",
    f"""WITH r AS ({_FLOAT_ROWS}), p AS (SELECT *, TRY_CAST(pred AS DOUBLE) AS x, CAST(gold AS DOUBLE) AS g FROM r),
e AS (SELECT *, CASE WHEN g = 0 THEN abs(x - g) * 100 ELSE abs(x - g) / abs(g) * 100 END AS err,
  contains(pred, gold) OR len(list_filter(regexp_extract_all(replace(pred, ',', ''), '[-+]?\\d*\\.\\d+|\\d+'), lambda f: abs(CAST(f AS DOUBLE) - g) / abs(g) * 100 <= 0.01)) > 0 AS loose FROM p)
SELECT id, pred, gold, CASE WHEN x IS NOT NULL THEN err <= 0.01 ELSE loose END AS correct, CASE WHEN x IS NOT NULL THEN err WHEN loose THEN 0.0 ELSE 100.0 END AS error FROM e""",
)(partial(_matched, "float", _float_rows))

_BOOLS = ["yes", "No", "True", "false", "maybe", "0"]


def _bool_rows(spark, sf_dir) -> DataFrame:
    c = star.table(spark, sf_dir, "customer")
    return c.select(C("c_custkey").alias("id"), F.get(F.array(*map(F.lit, _BOOLS)), (C("c_custkey") % 6).cast("int")).alias("pred"), F.when(C("c_acctbal") > 4000, "true").otherwise("false").alias("gold"))


query(
    "match_bool",
    "WITH r AS (SELECT c_custkey AS id, ['yes', 'No', 'True', 'false', 'maybe', '0'][c_custkey % 6 + 1] AS pred, c_custkey % 6 IN (0, 2, 4) AS t, CASE WHEN c_acctbal > 4000 THEN 'true' ELSE 'false' END AS gold FROM customer) SELECT id, pred, gold, t = (gold = 'true') AS correct, CAST(CASE WHEN t = (gold = 'true') THEN 0 ELSE 100 END AS DOUBLE) AS error FROM r",
)(partial(_matched, "bool", _bool_rows))


def _int_rows(spark, sf_dir) -> DataFrame:
    p, k = star.table(spark, sf_dir, "part"), C("p_partkey") % 4
    pred = F.when(k == 0, C("p_size").cast("string")).when(k == 1, F.concat((C("p_size") + 1).cast("string"), F.lit(".7"))).when(k == 2, F.concat(F.lit("it is "), C("p_size").cast("string"))).otherwise("none")
    return p.select(C("p_partkey").alias("id"), pred.alias("pred"), C("p_size").cast("string").alias("gold"))


query(
    "match_int",
    "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(p_size + 1 AS VARCHAR) || '.7' WHEN 2 THEN 'it is ' || CAST(p_size AS VARCHAR) ELSE 'none' END AS pred, CAST(p_size AS VARCHAR) AS gold, p_partkey % 4 IN (0, 2) AS correct, CAST(CASE p_partkey % 4 WHEN 1 THEN 1 WHEN 3 THEN 100 ELSE 0 END AS DOUBLE) AS error FROM part",
)(partial(_matched, "int", _int_rows))


def _str_rows(spark, sf_dir) -> DataFrame:
    c, k = star.table(spark, sf_dir, "customer"), C("c_custkey") % 3
    pred = F.when(k == 0, F.concat(F.lit(" "), F.lower("c_mktsegment"))).when(k == 1, F.concat(F.lit("the "), "c_mktsegment", F.lit(" one"))).otherwise("FURNITURE")
    return c.select(C("c_custkey").alias("id"), pred.alias("pred"), C("c_mktsegment").alias("gold"))


query(
    "match_str",
    "WITH r AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN ' ' || lower(c_mktsegment) WHEN 1 THEN 'the ' || c_mktsegment || ' one' ELSE 'FURNITURE' END AS pred, c_mktsegment AS gold FROM customer) SELECT *, contains(lower(trim(pred)), lower(gold)) AS correct, CAST(CASE WHEN contains(lower(trim(pred)), lower(gold)) THEN 0 ELSE 100 END AS DOUBLE) AS error FROM r",
)(partial(_matched, "str", _str_rows))


def _list_rows(spark, sf_dir) -> DataFrame:
    a, b = C("s_nationkey").cast("string"), (C("s_nationkey") + C("s_suppkey") % 2).cast("string")
    k = C("s_suppkey") % 3
    pred = F.when(k == 0, F.concat(F.lit("['N"), b, F.lit("', 'n0']"))).when(k == 1, F.concat(F.lit("n0, N"), b, F.lit(", N"), b)).otherwise("17")
    return star.table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("id"), pred.alias("pred"), F.concat(F.lit("['N"), a, F.lit("', 'N0']")).alias("gold"))


query(
    "match_list",
    """WITH r AS (SELECT s_suppkey AS id, s_suppkey % 3 AS k, CAST(s_nationkey AS VARCHAR) AS a, CAST(s_nationkey + s_suppkey % 2 AS VARCHAR) AS b FROM supplier),
t AS (SELECT *, CASE k WHEN 0 THEN '[''N' || b || ''', ''n0'']' WHEN 1 THEN 'n0, N' || b || ', N' || b ELSE '17' END AS pred, '[''N' || a || ''', ''N0'']' AS gold, k < 2 AND a = b AS correct FROM r)
SELECT id, pred, gold, correct, CAST(CASE WHEN correct THEN 0 WHEN k = 2 THEN 100 WHEN k = 0 THEN 0 ELSE 1 END AS DOUBLE) AS error FROM t""",
)(partial(_matched, "list[str]", _list_rows))
query(
    "match_fallback",
    "WITH r AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(p_size + 1 AS VARCHAR) || '.7' WHEN 2 THEN 'it is ' || CAST(p_size AS VARCHAR) ELSE 'none' END AS pred, CAST(p_size AS VARCHAR) AS gold FROM part) SELECT *, id % 4 <> 3 AS correct, CAST(CASE WHEN id % 4 = 3 THEN 100 ELSE 0 END AS DOUBLE) AS error FROM r",
)(partial(_matched, "unknown", _int_rows))


@query("final_answer_extract", "SELECT user_id AS id, arg_min(CAST(regexp_extract(props, '(\\d+)', 1) AS VARCHAR), event_id) FILTER (WHERE event_type = 'purchase') AS answer FROM events GROUP BY 1")
def final_answer_extract(spark, sf_dir):
    e = star.table(spark, sf_dir, "events")
    name = F.when(C("event_type") == "purchase", "final_answer").otherwise(C("event_type"))
    seen = e.groupBy(C("user_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("event_id", name.alias("name"), F.regexp_extract("props", r"(\d+)", 1).alias("k")))).alias("s"))
    call = lambda x: F.struct(F.struct(x["name"].alias("name"), F.create_map(F.lit("answer"), x["k"]).alias("arguments")).alias("function"))
    messages = F.transform("s", lambda x: F.struct(F.lit("assistant").alias("role"), F.array(call(x)).alias("tool_calls")))
    return seen.withColumn("m", messages).select("id", matcher.final_answer(C("m")).alias("answer"))


# ------------------------------------------------------------------ provenance


def _trace(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = star.table(spark, sf_dir, "events")
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    name = F.when(C("event_type") == "purchase", "final_answer").otherwise(C("event_type"))
    result = F.when(C("event_type") == "error", "Error: failed").when(C("event_type") == "signup", C("value").cast("string")).otherwise(F.floor("value").cast("string"))
    calls = e.select(C("user_id").cast("string").alias("graph_id"), C("event_id").cast("string").alias("call_id"), order.cast("long").alias("call_order"), name.alias("name"), F.create_map(F.lit("x"), F.regexp_extract("props", r"(\d+)", 1)).alias("arguments"), result.alias("result"))
    users = e.select("user_id").distinct()
    questions = users.select(C("user_id").cast("string").alias("graph_id"), F.concat(F.lit("user "), C("user_id").cast("string")).alias("question"))
    slots = users.select(C("user_id").cast("string").alias("graph_id"), F.lit("x").alias("slot"), (C("user_id") % 100).cast("string").alias("value"))
    return calls, questions, slots


def _edge_set(kind: str, spark, sf_dir) -> DataFrame:
    calls, questions, slots = _trace(spark, sf_dir)
    args, made = provenance.arguments(calls), provenance.producers(calls)
    return {"producer": lambda: provenance.producer_edges(args, made), "origin": lambda: provenance.origin_edges(args, slots), "error": lambda: provenance._sinks(calls), "result": lambda: provenance.result_edges(made)}[kind]()


for _n, _s in [("producer", "pe"), ("origin", "oe"), ("error", "se")]:
    query(f"graph_{_n}_edges", f"{O.TRACE} SELECT graph_id, src, dst, label FROM {_s}")(partial(_edge_set, _n))


@query(
    "stream_producer_edges",
    f"""{O.TRACE}, earlier AS (SELECT *, row_number() OVER (PARTITION BY graph_id, call_id ORDER BY made DESC) AS r FROM j WHERE made < call_order)
SELECT graph_id, src, call_id AS dst, 'x=' || value AS label FROM earlier WHERE r = 1""",
)
def stream_producer_edges(spark, sf_dir):
    """Edges from the most recent earlier producer, over calls that come in three parts; the query is started anew for each on one checkpoint."""
    calls, folder = _trace(spark, sf_dir)[0], new_folder(spark, "producers")
    ends = calls.agg(F.max(C("call_id").cast("long"))).first()[0] or 0
    for k in range(3):
        calls.where((C("call_id").cast("long") * 3 / (ends + 1)).cast("int") == k).write.parquet(f"{folder}/in/{k}")
        edges = producers.producer_edges(spark.readStream.schema(calls.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in"))
        q = edges.writeStream.option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(edges.schema).parquet(f"{folder}/out")


_NEAR = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS graph_id, CAST(event_id AS VARCHAR) AS call_id, event_id % 50 AS k, event_type FROM events),
a AS (SELECT graph_id, call_id, CAST(k AS VARCHAR) || '.500000004' AS value FROM e), m AS (SELECT graph_id, call_id AS src, CAST(k AS VARCHAR) || '.5' AS value FROM e WHERE event_type <> 'error')"""


@query("graph_fuzzy_edges", f"{_NEAR} SELECT DISTINCT a.graph_id, m.src, a.call_id AS dst, 'x≈' || a.value AS label FROM a JOIN m ON a.graph_id = m.graph_id AND m.src <> a.call_id AND abs(CAST(a.value AS DOUBLE) - CAST(m.value AS DOUBLE)) > 0 AND abs(CAST(a.value AS DOUBLE) - CAST(m.value AS DOUBLE)) < 1e-8")
def graph_fuzzy_edges(spark, sf_dir):
    e = star.table(spark, sf_dir, "events").select(C("user_id").cast("string").alias("graph_id"), C("event_id").cast("string").alias("call_id"), (C("event_id") % 50).cast("string").alias("k"), "event_type")
    args = e.select("graph_id", "call_id", F.lit("x").alias("arg"), F.concat("k", F.lit(".500000004")).alias("value"))
    made = e.where("event_type <> 'error'").select("graph_id", C("call_id").alias("src"), F.concat("k", F.lit(".5")).alias("value"))
    return provenance.fuzzy_edges(args, made)


query("graph_result_edges", f"{O.TRACE} SELECT DISTINCT x.graph_id, x.src, y.src AS dst, 'result≈result' AS label FROM m x JOIN m y ON x.graph_id = y.graph_id AND x.src <> y.src AND CAST(x.value AS DOUBLE) <> 0 AND CAST(y.value AS DOUBLE) <> 0 AND abs(CAST(x.value AS DOUBLE) - CAST(y.value AS DOUBLE)) > 0 AND abs(CAST(x.value AS DOUBLE) - CAST(y.value AS DOUBLE)) < 1e-4 * greatest(abs(CAST(x.value AS DOUBLE)), abs(CAST(y.value AS DOUBLE)))")(partial(_edge_set, "result"))


@query("graph_nodes", f"{O.TRACE}, b AS (SELECT *, CAST(graph_id AS BIGINT) % 100 AS slot FROM t) SELECT graph_id, call_id AS node_id, name AS label, 'call' AS type, CAST(call_order AS BIGINT) AS call_order, result, '{{\"x\":\"' || CAST(k AS VARCHAR) || '\"}}' AS args FROM t UNION ALL SELECT DISTINCT graph_id, '__question__', 'user ' || graph_id, 'question', 0, CAST(NULL AS VARCHAR), '{{\"slot_x\":\"' || CAST(slot AS VARCHAR) || '\"}}' FROM b UNION ALL SELECT DISTINCT graph_id, '__error__', '__error__', 'sink', CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM t WHERE name = 'error'")
def graph_nodes(spark, sf_dir):
    return provenance.nodes(*_trace(spark, sf_dir)).withColumn("args", F.to_json("args"))


@query("graph_search_edges", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS graph_id, CAST(event_id AS VARCHAR) AS call_id, event_type, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) % 20 AS k FROM events)
SELECT DISTINCT u.graph_id, s.call_id AS src, u.call_id AS dst, CASE u.event_type WHEN 'view' THEN 'indicator_name=NAME ' ELSE 'indicator_code=C' END || CAST(u.k AS VARCHAR) AS label FROM e s JOIN e u ON s.graph_id = u.graph_id AND s.k = u.k AND s.event_type = 'click' AND u.event_type IN ('view', 'signup')""")
def graph_search_edges(spark, sf_dir):
    e = star.table(spark, sf_dir, "events").withColumn("k", (F.regexp_extract("props", r"(\d+)", 1).cast("long") % 20).cast("string"))
    kind = C("event_type")
    name = F.when(kind == "click", "search_for_indicator_names").when(kind == "view", "get_indicator_code_from_name").when(kind == "signup", "retrieve_value").otherwise("add")
    given = F.when(kind == "view", F.create_map(F.lit("indicator_name"), F.concat(F.lit("NAME "), "k"))).when(kind == "signup", F.create_map(F.lit("indicator_code"), F.concat(F.lit("C"), "k"))).otherwise(F.create_map(F.lit("keywords"), F.lit("any")))
    found = F.concat(F.lit('[{"indicator_name": "Name '), "k", F.lit('", "indicator_code": "C'), "k", F.lit('"}]'))
    calls = e.select(C("user_id").cast("string").alias("graph_id"), C("event_id").cast("string").alias("call_id"), C("event_id").alias("call_order"), name.alias("name"), given.alias("arguments"), found.alias("result"))
    return provenance.search_edges(calls, provenance.arguments(calls))


@query("graph_keyword_edges", "SELECT CAST(user_id AS VARCHAR) AS graph_id, '__question__' AS src, CAST(event_id AS VARCHAR) AS dst, 'keywords' AS label FROM events WHERE event_type = 'view' AND user_id % 100 = CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) % 100")
def graph_keyword_edges(spark, sf_dir):
    e = star.table(spark, sf_dir, "events")
    args = e.where("event_type = 'view'").select(C("user_id").cast("string").alias("graph_id"), C("event_id").cast("string").alias("call_id"), F.lit("search_for_indicator_names").alias("name"), F.lit("keywords").alias("arg"), F.concat(F.lit("K"), (F.regexp_extract("props", r"(\d+)", 1).cast("long") % 100).cast("string"), F.lit("!")).alias("value"))
    questions = e.select("user_id").distinct().select(C("user_id").cast("string").alias("graph_id"), F.concat(F.lit("What of k"), (C("user_id") % 100).cast("string"), F.lit("?")).alias("question"))
    return provenance.keyword_edges(args, questions)


_KNOWN = "known AS (SELECT graph_id, dst FROM pe UNION SELECT graph_id, dst FROM oe)"


#: All edges: a pair's last layer wins (question, producer, sink, results).
_ALL_EDGES = "y AS (SELECT DISTINCT x.graph_id, x.src, y.src AS dst, 'result≈result' AS label FROM m x JOIN m y ON x.graph_id = y.graph_id AND x.src <> y.src AND CAST(x.value AS DOUBLE) <> 0 AND CAST(y.value AS DOUBLE) <> 0 AND abs(CAST(x.value AS DOUBLE) - CAST(y.value AS DOUBLE)) > 0 AND abs(CAST(x.value AS DOUBLE) - CAST(y.value AS DOUBLE)) < 1e-4 * greatest(abs(CAST(x.value AS DOUBLE)), abs(CAST(y.value AS DOUBLE)))), every AS (SELECT graph_id, src, dst, arg_max(label, k) AS label FROM (SELECT 0 AS k, * FROM oe UNION ALL SELECT 1, * FROM pe UNION ALL SELECT 2, * FROM se UNION ALL SELECT 3, * FROM y) GROUP BY 1, 2, 3)"


@query("graph_edges", f"{O.TRACE}, {_ALL_EDGES} SELECT graph_id, src, dst, label FROM every")
def graph_edges(spark, sf_dir):
    return provenance.edges(*_trace(spark, sf_dir))


@query("graph_argument_sources", f"{O.TRACE}, {_ALL_EDGES} SELECT a.graph_id, a.call_id, a.name, 'x' AS arg, max(e.src) AS source FROM a LEFT JOIN every e ON e.graph_id = a.graph_id AND e.dst = a.call_id AND e.label LIKE 'x=%' GROUP BY 1, 2, 3, 4")
def graph_argument_sources(spark, sf_dir):
    calls, questions, slots = _trace(spark, sf_dir)
    return provenance.argument_sources(provenance.arguments(calls), provenance.edges(calls, questions, slots))


@query("graph_missing_arguments", "SELECT CAST(user_id AS VARCHAR) AS graph_id, CAST(event_id AS VARCHAR) AS call_id, CASE event_type WHEN 'view' THEN 'divide' ELSE 'rank' END AS name, arg FROM events, (SELECT unnest(['value_a', 'value_b', 'values', 'query_value']) AS arg) WHERE (event_type = 'view' AND (arg = 'value_b' OR (arg = 'value_a' AND event_id % 2 = 1))) OR (event_type = 'click' AND (arg = 'values' OR arg = 'query_value'))")
def graph_missing_arguments(spark, sf_dir):
    given = F.when((C("event_type") == "view") & (C("event_id") % 2 == 0), F.create_map(F.lit("value_a"), F.lit("1"))).otherwise(F.create_map(F.lit("other"), F.lit("1")))
    calls = star.table(spark, sf_dir, "events").where("event_type IN ('view', 'click')").select(C("user_id").cast("string").alias("graph_id"), C("event_id").cast("string").alias("call_id"), F.when(C("event_type") == "view", "divide").otherwise("rank").alias("name"), given.alias("arguments"))
    return provenance.missing_arguments(calls, provenance.required_arguments(catalogue(spark)))


@query("graph_unprovenanced_args", f"{O.TRACE}, {_KNOWN} SELECT a.graph_id, a.call_id, a.name, 'x' AS arg FROM a LEFT JOIN known k ON k.graph_id = a.graph_id AND k.dst = a.call_id WHERE k.dst IS NULL")
def graph_unprovenanced_args(spark, sf_dir):
    calls, _, slots = _trace(spark, sf_dir)
    args, made = provenance.arguments(calls), provenance.producers(calls)
    return provenance.unprovenanced(args, provenance.producer_edges(args, made).union(provenance.origin_edges(args, slots)))


_EARLIER = """ee AS (SELECT graph_id, src, call_id AS dst FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, call_id ORDER BY made DESC, src DESC) AS r FROM j WHERE made < call_order) WHERE r = 1)"""


def _causal(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    calls, questions, _ = _trace(spark, sf_dir)
    edge = provenance.producer_edges(provenance.arguments(calls), provenance.producers(calls), causal=True)
    return provenance.nodes(calls, questions).where("type = 'call'"), edge


@query("graph_unreachable_nodes", f"{O.TRACE.replace('WITH t AS', 'WITH RECURSIVE t AS')}, {_EARLIER}, reach AS (SELECT graph_id, call_id AS node_id FROM t WHERE name = 'final_answer' UNION SELECT e.graph_id, e.src FROM reach r JOIN ee e ON e.graph_id = r.graph_id AND e.dst = r.node_id) SELECT t.graph_id, t.call_id AS node_id, t.name AS label FROM t LEFT JOIN reach r ON r.graph_id = t.graph_id AND r.node_id = t.call_id WHERE r.node_id IS NULL")
def graph_unreachable_nodes(spark, sf_dir):
    return provenance.unreachable(*_causal(spark, sf_dir))


@query("graph_components", f"{O.TRACE.replace('WITH t AS', 'WITH RECURSIVE t AS')}, {_EARLIER}, b AS (SELECT graph_id, src AS x, dst AS y FROM ee UNION SELECT graph_id, dst, src FROM ee), reach AS (SELECT graph_id, call_id AS x, call_id AS y FROM t UNION SELECT r.graph_id, r.x, b.y FROM reach r JOIN b ON b.graph_id = r.graph_id AND b.x = r.y) SELECT graph_id, x AS node_id, min(y) AS component FROM reach GROUP BY 1, 2")
def graph_components(spark, sf_dir):
    node, edge = _causal(spark, sf_dir)
    return provenance.components(node, edge)


@query("graph_levels", f"{O.TRACE.replace('WITH t AS', 'WITH RECURSIVE t AS')}, {_EARLIER}, w AS (SELECT graph_id, call_id AS node_id, 0 AS d FROM t WHERE (graph_id, call_id) NOT IN (SELECT (graph_id, dst) FROM ee) UNION SELECT e.graph_id, e.dst, w.d + 1 FROM w JOIN ee e ON e.graph_id = w.graph_id AND e.src = w.node_id) SELECT graph_id, node_id, CAST(min(d) AS INTEGER) AS level FROM w GROUP BY 1, 2")
def graph_levels(spark, sf_dir):
    return provenance.levels(*_causal(spark, sf_dir))


@query("graph_report", f"""{O.TRACE}, {_ALL_EDGES},
n AS (SELECT graph_id, call_id AS node_id, name AS label, call_order FROM t UNION ALL SELECT DISTINCT graph_id, '__question__', 'user ' || graph_id, 0 FROM t UNION ALL SELECT DISTINCT graph_id, '__error__', '__error__', NULL FROM t WHERE name = 'error'),
i AS (SELECT a.graph_id, a.call_id, a.name FROM a LEFT JOIN every e ON e.graph_id = a.graph_id AND e.dst = a.call_id AND e.label LIKE 'x=%' WHERE e.src IS NULL)
SELECT graph_id, (SELECT string_agg(coalesce(CAST(call_order AS VARCHAR), '-') || ' ' || node_id || ' ' || label, ';' ORDER BY call_order NULLS FIRST, node_id) FROM n WHERE n.graph_id = g.graph_id) AS nodes,
  (SELECT string_agg(src || '>' || dst || ' ' || label, ';' ORDER BY src, dst) FROM every WHERE every.graph_id = g.graph_id) AS edges,
  (SELECT string_agg(call_id || ' ' || name || ' x', ';' ORDER BY call_id) FROM i WHERE i.graph_id = g.graph_id) AS issues FROM (SELECT DISTINCT graph_id FROM t) g""")
def graph_report(spark, sf_dir):
    """Nodes, edges and issues of every trace, one row each, as text."""
    calls, questions, slots = _trace(spark, sf_dir)
    made = provenance.report(provenance.nodes(calls, questions), provenance.edges(calls, questions, slots), provenance.arguments(calls))
    lines = lambda c, f: F.array_join(F.transform(c, f), ";").alias(c)
    return made.select(
        "graph_id", lines("nodes", lambda x: F.concat_ws(" ", F.coalesce(x["call_order"].cast("string"), F.lit("-")), x["node_id"], x["label"])),
        lines("edges", lambda x: F.concat(x["src"], F.lit(">"), x["dst"], F.lit(" "), x["label"])), lines("issues", lambda x: F.concat_ws(" ", x["call_id"], x["name"], x["arg"])),
    )


@query("dense_cells", f"{O.CUBE} SELECT property AS indicator_code, code AS country_code, region, year, value FROM cells")
def dense_cells(spark, sf_dir):
    return _cube(spark, sf_dir).dense().select("indicator_code", "country_code", "region", "year", "value")


# ------------------------------------------------------------------ rows


@query("rows_where_all", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def rows_where_all(spark, sf_dir):
    return rows.where_all(star.table(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT").select("o_orderkey", "o_totalprice")


@query("rows_mean_words", "SELECT avg(len(string_split(p_name, ' '))) AS mean_words FROM part")
def rows_mean_words(spark, sf_dir):
    return rows.mean_words(star.table(spark, sf_dir, "part").select(C("p_partkey").alias("id"), F.array("p_name").alias("paraphrase")))


@query("rows_count_exploded", "SELECT coalesce(w, 'unknown') AS tags, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT NULL FROM part WHERE p_partkey % 7 = 0) GROUP BY 1")
def rows_count_exploded(spark, sf_dir):
    tags = F.when(C("p_partkey") % 7 != 0, F.split("p_name", " "))
    return rows.count_exploded(star.table(spark, sf_dir, "part").select(tags.alias("tags")), "tags")


@query("rows_merge_paraphrases", "SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part")
def rows_merge_paraphrases(spark, sf_dir):
    old = star.table(spark, sf_dir, "part").select(C("p_partkey").cast("string").alias("id"), C("p_name").alias("name"))
    return rows.merge_paraphrases(old, old.where("cast(id as long) % 3 = 0").withColumn("name", F.upper("name")))


@query("rows_mean_and_deviation", f"{_SCORED}, t AS (SELECT run, avg(precision) AS m, stddev_samp(precision) AS d FROM s GROUP BY 1) SELECT run, printf('%.2f', m) || ' $\\pm$ ' || printf('%.2f', d) AS cell FROM t")
def rows_mean_and_deviation(spark, sf_dir):
    s = _scored(spark, sf_dir).groupBy("run").agg(F.avg("precision").alias("m"), F.stddev_samp("precision").alias("d"))
    return s.select("run", rows.mean_and_deviation(C("m"), C("d")).alias("cell"))


@query("rows_jaccard", "SELECT p_partkey, CASE WHEN len(list_distinct(list_concat(string_split(p_name, ' '), string_split(lower(p_type), ' ')))) = 0 THEN 0.0 ELSE len(list_intersect(string_split(p_name, ' '), string_split(lower(p_type), ' '))) / len(list_distinct(list_concat(string_split(p_name, ' '), string_split(lower(p_type), ' ')))) END AS similarity FROM part")
def rows_jaccard(spark, sf_dir):
    p = star.table(spark, sf_dir, "part")
    return p.select("p_partkey", rows.jaccard(F.split("p_name", " "), F.split(F.lower("p_type"), " ")).alias("similarity"))


@query("rows_sample", "SELECT p_partkey, p_name FROM part ORDER BY sha256(concat_ws('|', CAST(p_partkey AS VARCHAR), '7')) LIMIT 25")
def rows_sample(spark, sf_dir):
    """25 rows drawn by a digest (a sampling operator)."""
    return rows.sample(star.table(spark, sf_dir, "part").select("p_partkey", "p_name"), 25, "p_partkey", 7)


@query("rows_clean", "SELECT s_nationkey, s_suppkey, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier WHERE s_acctbal > 0) WHERE k = 1")
def rows_clean(spark, sf_dir):
    s = star.table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.when(C("s_acctbal") > 0, C("s_acctbal")).alias("s_acctbal"))
    return rows.clean(s, ["s_acctbal"], ["s_nationkey"], ["s_nationkey", "s_suppkey"])


@query("rows_first", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 40")
def rows_first(spark, sf_dir):
    """The batch limit: the first 40 rows in a given order (a limit by definition)."""
    return rows.first_rows(star.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), 40, F.desc("c_acctbal"), "c_custkey")


@query("rows_timing_summary", """WITH t AS (SELECT event_type AS template, round(sum(value), 3) AS total_time, round(avg(value), 5) AS time_per_attempt, CAST(2 AS BIGINT) - CASE WHEN count(*) FILTER (WHERE value > 30) = 0 THEN 1 ELSE 0 END AS filled FROM events GROUP BY 1)
SELECT template, total_time, time_per_attempt, filled FROM t UNION ALL SELECT 'Total', round(sum(total_time), 2), round(avg(time_per_attempt), 4), CAST(sum(filled) AS BIGINT) FROM t""")
def rows_timing_summary(spark, sf_dir):
    e = star.table(spark, sf_dir, "events").groupBy(C("event_type").alias("template"))
    some = F.nullif(F.count_if(C("value") > 30), F.lit(0))
    t = e.agg(F.round(F.sum("value"), 3).alias("total_time"), F.round(F.avg("value"), 5).alias("time_per_attempt"), F.count("*").alias("answerable-full"), some.alias("answerable-partial"))
    out = rows.timing_summary(t, ["answerable-full", "answerable-partial"])
    last = C("template") == "Total"
    return out.withColumns({"total_time": F.when(last, F.round("total_time", 2)).otherwise(C("total_time")), "time_per_attempt": F.when(last, F.round("time_per_attempt", 4)).otherwise(C("time_per_attempt"))})


# ------------------------------------------------------------------ texts and calls


@query("text_literals", """SELECT l_orderkey, l_linenumber, l_suppkey, CASE l_orderkey % 5 WHEN 0 THEN CAST(l_linenumber AS VARCHAR) || '.5,null,true' WHEN 1 THEN 'a''b,x "y"' WHEN 2 THEN CAST(l_linenumber AS VARCHAR) || ',2' WHEN 3 THEN 'null,s' END AS items FROM lineitem""")
def text_literals(spark, sf_dir):
    """List literals as JSON and as Python writes them: None, True, tuples, both quotes, a comma before the end; and a text that is none."""
    n, k = C("l_linenumber").cast("string"), C("l_orderkey") % 5
    text = F.when(k == 0, F.concat(F.lit("["), n, F.lit(".5, None, True]"))).when(k == 1, F.lit("""["a'b", 'x "y"',]""")).when(k == 2, F.concat(F.lit("("), n, F.lit(", 2)"))).when(k == 3, F.lit('[null, "s"]')).otherwise("None")
    shown = F.array_join(F.transform(X.list_literal(text), lambda x: F.coalesce(x, F.lit("null"))), ",")
    return star.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", shown.alias("items"))


@query("text_docstrings", "SELECT p_partkey, p_name AS says, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS more FROM part")
def text_docstrings(spark, sf_dir):
    doc = F.concat(F.lit("Do it.\n\nArgs:\n    first: "), "p_name", F.lit("\n"), F.when(C("p_partkey") % 2 == 0, F.concat(F.lit("    other: "), "p_type", F.lit("\n"))).otherwise(""), F.lit("\nReturns:\n    out: a thing\n"))
    args = X.docstring_arguments(doc)
    return star.table(spark, sf_dir, "part").select("p_partkey", F.try_element_at(args, F.lit("first")).alias("says"), F.try_element_at(args, F.lit("other")).alias("more"))


@query("text_labels", "SELECT p_partkey, 'arg' AS arg, p_name || '=' || p_type AS value, p_type AS attribute FROM part")
def text_labels(spark, sf_dir):
    part = X.split_label(F.concat(F.lit("arg="), "p_name", F.lit("="), "p_type"))
    own = X.without_prefix(F.create_map(F.lit("arg_k"), C("p_type"), F.lit("label"), C("p_name")), "arg_")
    return star.table(spark, sf_dir, "part").select("p_partkey", part["arg"].alias("arg"), part["value"].alias("value"), F.element_at(own, "k").alias("attribute"))


def _act(errors: str, spark, sf_dir) -> DataFrame:
    """Each order's calls to eight tools in turn, executed by name."""
    o, k = star.table(spark, sf_dir, "orders"), C("o_orderkey") % 9
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    one = lambda a, x: F.create_map(F.lit(a), x)
    key = C("o_custkey") % 30
    name = F.get(F.array(*map(F.lit, ["count", "rank", "greater_than", "get_country_code_from_name", "get_country_codes_in_region", "get_indicator_name_from_code", "retrieve_value", "final_answer", "no_such_tool"])), k.cast("int"))
    arguments = (
        F.when(k == 0, one("values", text("[", key, ", None, 'x']"))).when(k == 1, F.create_map(F.lit("values"), text("[", key, ", 3, 40]"), F.lit("query_value"), F.lit("3")))
        .when(k == 2, F.create_map(F.lit("value_a"), key.cast("string"), F.lit("value_b"), F.when(key > 3, "7"))).when(k == 3, one("country_name", text("NATION_", key))).when(k == 4, one("region", F.when(key > 9, "ASIA").otherwise("ATLANTIS")))
        .when(k == 5, one("indicator_code", text(C("o_custkey") * 2))).when(k == 6, F.create_map(F.lit("country_code"), key.cast("string"), F.lit("indicator_code"), F.lit("1-URGENT|BUILDING"), F.lit("year"), F.year("o_orderdate").cast("string")))
        .when(k == 7, one("answer", text(key))).otherwise(one("x", F.lit("1")))
    )
    calls = o.select(C("o_orderkey").alias("call_id"), name.alias("name"), arguments.alias("arguments"))
    return dispatch.execute(calls, _cube(spark, sf_dir), _indicators(spark, sf_dir), errors).select("call_id", "name", "result", "status")


_ACT = f"""WITH {O.OBS}, c AS (SELECT o_orderkey AS call_id, o_orderkey % 9 AS k, o_custkey % 30 AS v, o_custkey * 2 AS part, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders),
x AS (SELECT call_id, k, ['count', 'rank', 'greater_than', 'get_country_code_from_name', 'get_country_codes_in_region', 'get_indicator_name_from_code', 'retrieve_value', 'final_answer', 'no_such_tool'][k + 1] AS name,
  CASE k WHEN 0 THEN '2' WHEN 1 THEN CASE WHEN v > 3 THEN '3' ELSE '2' END WHEN 2 THEN CASE WHEN v > 7 THEN 'true' WHEN v > 3 THEN 'false' END WHEN 3 THEN CASE WHEN v < 25 THEN CAST(v AS VARCHAR) END
    WHEN 4 THEN CASE WHEN v > 9 THEN (SELECT '["' || string_agg(CAST(n_nationkey AS VARCHAR), '","' ORDER BY n_nationkey) || '"]' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') END
    WHEN 5 THEN (SELECT p_name FROM part WHERE p_partkey = c.part) WHEN 6 THEN (SELECT CAST(value AS VARCHAR) FROM obs WHERE property = '1-URGENT|BUILDING' AND code = CAST(c.v AS VARCHAR) AND year = c.y) WHEN 7 THEN CAST(v AS VARCHAR) END AS result,
  CASE k WHEN 2 THEN 'not_computed' WHEN 3 THEN 'invalid_country_name' WHEN 4 THEN 'invalid_region' WHEN 5 THEN 'invalid_indicator' WHEN 6 THEN CASE WHEN v >= 25 THEN 'invalid_country' ELSE 'no_data' END WHEN 8 THEN 'unknown_tool' END AS failed FROM c)"""
_SAID = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lookup.MESSAGES.items())
query("act_execute", f"{_ACT} SELECT call_id, name, result, CASE WHEN result IS NULL THEN failed ELSE 'ok' END AS status FROM x")(partial(_act, "ignore"))
query("act_execute_raise", f"{_ACT} SELECT call_id, name, coalesce(result, CASE failed {_SAID} END) AS result, CASE WHEN result IS NULL THEN failed ELSE 'ok' END AS status FROM x")(partial(_act, "raise"))


@query("few_shot_examples")
def few_shot_examples(spark, sf_dir):
    """Three executed calls of every tool as text, arguments drawn by hash (a sampling operator)."""
    from .fewshot import examples

    return examples(_cube(spark, sf_dir), _indicators(spark, sf_dir))


@query("registry_catalogue", "SELECT * FROM (VALUES " + ", ".join(f"('{t.name}', '{t.toolbox}', '{','.join(a for a, _, _ in t.arguments)}')" for t in TOOLS) + ") t(name, toolbox, arguments)")
def registry_catalogue(spark, sf_dir):
    """The tool catalogue: names, toolboxes and required arguments as read back from the exported schemas."""
    listed = catalogue(spark)
    required = provenance.required_arguments(listed).groupBy("name").agg(F.collect_set("arg").alias("r"))
    given = F.array_join(F.filter("arguments", lambda a: F.array_contains("r", a)), ",")
    return listed.join(required, "name").select("name", "toolbox", given.alias("arguments"))
