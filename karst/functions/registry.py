"""The tool catalogue: names, arguments, toolboxes, and exports as function schemas."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import numeric


@dataclass(frozen=True)
class Tool:
    name: str
    toolbox: str
    says: str
    arguments: tuple[tuple[str, str, str], ...]  # name, type, what it is
    build: object = None


_LIST = ("values", "array<number>", "The numbers.")
_PAIR = (("value_a", "number", "The first number."), ("value_b", "number", "The second number."))
_QUERY = ("query_value", "number", "The value looked for.")

# The tools' names and arguments.
TOOLS = [
    Tool("add", "arithmetic", "Sum of the numbers.", (_LIST,), numeric.add),
    Tool("count", "arithmetic", "How many elements are not null.", (("values", "array<string>", "The elements."),), numeric.count),
    Tool("divide", "arithmetic", "First number over the second.", _PAIR, numeric.divide),
    Tool("greater_than", "arithmetic", "Whether the first number is greater.", _PAIR, numeric.greater_than),
    Tool("index", "arithmetic", "0-based place of a value.", (_LIST, _QUERY), numeric.index),
    Tool("less_than", "arithmetic", "Whether the first number is less.", _PAIR, numeric.less_than),
    Tool("maximum", "arithmetic", "Largest of the numbers.", (_LIST,), numeric.maximum),
    Tool("mean", "arithmetic", "Mean of the numbers.", (_LIST,), numeric.mean),
    Tool("minimum", "arithmetic", "Smallest of the numbers.", (_LIST,), numeric.minimum),
    Tool("multiply", "arithmetic", "Product of the numbers.", (_LIST,), numeric.multiply),
    Tool("rank", "arithmetic", "1-based descending rank of a value.", (_LIST, _QUERY), numeric.rank),
    Tool("sort", "arithmetic", "The numbers in ascending order.", (_LIST,), numeric.sort),
    Tool("subtract", "arithmetic", "First number less the second.", _PAIR, numeric.subtract),
    Tool("get_country_code_from_name", "data", "Code of a country.", (("country_name", "string", "Its name."),)),
    Tool("get_country_codes_in_region", "data", "Codes of a region's countries.", (("region", "string", "The region."),)),
    Tool("get_country_name_from_code", "data", "Name of a country.", (("country_code", "string", "Its code."),)),
    Tool("get_indicator_code_from_name", "data", "Code of an indicator.", (("indicator_name", "string", "Its name."),)),
    Tool("get_indicator_name_from_code", "data", "Name of an indicator.", (("indicator_code", "string", "Its code."),)),
    Tool("retrieve_value", "data", "An indicator's value for a country and year.", (("country_code", "string", "The country."), ("indicator_code", "string", "The indicator."), ("year", "string", "The year."))),
    Tool("search_for_indicator_names", "data", "Indicators whose names hold any keyword.", (("keywords", "string", "A keyword or a list of them."),)),
    Tool("final_answer", "utils", "Submit the answer.", (("answer", "string", "The answer."),)),
    Tool("think", "utils", "Note a thought.", (("thought", "string", "The thought."),)),
]
BY_NAME = {t.name: t for t in TOOLS}


def toolbox(which: str = "all") -> list[Tool]:
    """The tools of a toolbox (all, arithmetic, data, utils); the control tools always belong to it."""
    return [t for t in TOOLS if which == "all" or t.toolbox in (which, "utils")]


def _parameters(tool: Tool) -> dict:
    kind = lambda t: {"type": "array", "items": {"type": t[6:-1]}} if t.startswith("array") else {"type": t}
    return {"type": "object", "properties": {n: kind(t) | {"description": d} for n, t, d in tool.arguments}, "required": [n for n, _, _ in tool.arguments]}


def schema(tool: Tool, style: str = "openai") -> dict:
    """A tool's signature: ``openai`` (wrapped function), ``claude`` (input_schema) or ``basic`` (name, says, arguments)."""
    if style == "openai":
        return {"type": "function", "function": {"name": tool.name, "description": tool.says, "parameters": _parameters(tool)}}
    if style == "claude":
        return {"name": tool.name, "description": tool.says, "input_schema": _parameters(tool)}
    return {"name": tool.name, "description": tool.says, "parameters": {n: t for n, t, _ in tool.arguments}}


def catalogue(spark: SparkSession, which: str = "all", style: str = "openai") -> DataFrame:
    """The toolbox as a table (name, toolbox, arguments, schema as JSON)."""
    rows = [(t.name, t.toolbox, [a for a, _, _ in t.arguments], json.dumps(schema(t, style))) for t in toolbox(which)]
    return spark.createDataFrame(rows, "name string, toolbox string, arguments array<string>, schema string")


#: The scalar and array tools as SQL functions.
_SQL = {
    "tool_add": "(v ARRAY<DOUBLE>) RETURNS DOUBLE RETURN round(aggregate(filter(v, x -> x IS NOT NULL AND NOT isnan(x)), 0D, (s, x) -> s + x), 5)",
    "tool_subtract": "(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN round(a - b, 5)",
    "tool_divide": "(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN round(try_divide(a, b), 5)",
    "tool_multiply": "(v ARRAY<DOUBLE>) RETURNS DOUBLE RETURN round(aggregate(v, 1D, (s, x) -> s * x), 5)",
    "tool_mean": "(v ARRAY<DOUBLE>) RETURNS DOUBLE RETURN round(try_divide(aggregate(filter(v, x -> x IS NOT NULL AND NOT isnan(x)), 0D, (s, x) -> s + x), size(filter(v, x -> x IS NOT NULL AND NOT isnan(x)))), 5)",
    "tool_maximum": "(v ARRAY<DOUBLE>) RETURNS DOUBLE RETURN round(array_max(filter(v, x -> x IS NOT NULL AND NOT isnan(x))), 5)",
    "tool_minimum": "(v ARRAY<DOUBLE>) RETURNS DOUBLE RETURN round(array_min(filter(v, x -> x IS NOT NULL AND NOT isnan(x))), 5)",
    "tool_greater_than": "(a DOUBLE, b DOUBLE) RETURNS BOOLEAN RETURN a > b",
    "tool_less_than": "(a DOUBLE, b DOUBLE) RETURNS BOOLEAN RETURN a < b",
    "tool_count": "(v ARRAY<STRING>) RETURNS BIGINT RETURN size(filter(v, x -> x IS NOT NULL))",
    "tool_sort": "(v ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN array_sort(filter(v, x -> x IS NOT NULL AND NOT isnan(x)))",
    "tool_index": "(v ARRAY<DOUBLE>, q DOUBLE) RETURNS BIGINT RETURN nullif(array_position(filter(v, x -> x IS NOT NULL AND NOT isnan(x)), q), 0) - 1",
    "tool_rank": "(v ARRAY<DOUBLE>, q DOUBLE) RETURNS BIGINT RETURN CASE WHEN array_contains(v, q) THEN 1 + size(filter(v, x -> x > q AND NOT isnan(x))) END",
}


def register_sql(spark: SparkSession) -> list[str]:
    """Make the tools callable from SQL in this session; returns their names."""
    for name, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(_SQL)


#: The tools that answer with rows, as SQL table functions over the views that ``register_tables`` makes.
_TABLE_SQL = {
    "tool_region_members": "(region_name STRING) RETURNS TABLE (pos INT, country_code STRING) RETURN SELECT g.pos, g.country_code FROM karst_geo g WHERE g.region = region_name",
    "tool_retrieve_value": """(country STRING, indicator STRING, of_year INT) RETURNS TABLE (value DOUBLE, status STRING) RETURN
        SELECT CASE WHEN c.country_code IS NOT NULL AND i.indicator_code IS NOT NULL THEN v.value END,
            CASE WHEN c.country_code IS NULL THEN 'invalid_country' WHEN i.indicator_code IS NULL THEN 'invalid_indicator' WHEN v.value IS NULL THEN 'no_data' ELSE 'ok' END
        FROM (SELECT country AS c, indicator AS i, of_year AS y) q LEFT JOIN karst_countries c ON c.country_code = q.c LEFT JOIN karst_indicators i ON i.indicator_code = q.i
            LEFT JOIN karst_cells v ON v.country_code = q.c AND v.indicator_code = q.i AND v.year = q.y""",
    "tool_search_names": """(keywords ARRAY<STRING>) RETURNS TABLE (keyword_no INT, keyword STRING, indicator_code STRING, indicator_name STRING, indicator_description STRING) RETURN
        SELECT k.pos, k.word, t.indicator_code, t.indicator_name, t.indicator_description FROM (SELECT posexplode(keywords) AS (pos, word)) k JOIN karst_tokens t ON t.token = lower(k.word)""",
}


def register_tables(spark: SparkSession, geo: DataFrame, indicators: DataFrame, observations: DataFrame) -> list[str]:
    """Make the tools that answer with rows callable in this session, as ``tool_x(...)`` after FROM, or LATERAL over a table of arguments; returns their names.

    Calls over a table become joins by equality.  Keywords are an array here, a word each.
    """
    from ..operators.lookup import cell_values
    from .text import words

    geo.createOrReplaceTempView("karst_geo")
    geo.select("country_code").distinct().createOrReplaceTempView("karst_countries")
    observations.select("indicator_code").distinct().createOrReplaceTempView("karst_indicators")
    cell_values(observations).createOrReplaceTempView("karst_cells")
    token = F.explode(F.array_distinct(words(F.col("name"), "(),"))).alias("token")
    indicators.select(F.col("id").alias("indicator_code"), F.col("name").alias("indicator_name"), F.col("description").alias("indicator_description"), token).createOrReplaceTempView("karst_tokens")
    for name, body in _TABLE_SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(_TABLE_SQL)
