"""Tool calls executed as a table: each call goes to its tool by name, all calls of a tool at once.

Numeric tools are one projection; each lookup tool is one join over its own calls.  Failed calls are rows like all others: ``ignore`` gives
them a null result, ``raise`` the text of the error, as an agent sees it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.registry import BY_NAME
from ..functions.text import list_literal, number_text
from . import lookup
from .cells import Cube

_LISTS = {"add": N.add, "multiply": N.multiply, "mean": N.mean, "maximum": N.maximum, "minimum": N.minimum, "sort": N.sort}
_PAIRS = {"subtract": N.subtract, "divide": N.divide, "greater_than": N.greater_than, "less_than": N.less_than}
_QUERIES = {"rank": N.rank, "index": N.index}


def _argument(name: str) -> Column:
    return F.try_element_at("arguments", F.lit(name))


def _numeric() -> tuple[Column, Column]:
    """(result, status) of a call of a numeric tool; what a call would throw on is no result."""
    listed = list_literal(_argument("values"))
    number = F.transform(listed, lambda x: x.try_cast("double"))
    # an element that is no number is an error, a null one is no value
    readable = listed.isNotNull() & ~F.exists(F.arrays_zip(listed.alias("a"), number.alias("b")), lambda z: z["a"].isNotNull() & z["b"].isNull())
    values = F.when(readable, number)
    a, b, q = (_argument(n).try_cast("double") for n in ("value_a", "value_b", "query_value"))
    name = F.col("name")
    result = F.when(name == "count", N.count(listed).cast("string")).when(name == "sort", F.to_json(_LISTS["sort"](values)))
    for tool in ("greater_than", "less_than"):
        result = result.when(name == tool, _PAIRS[tool](a, b).cast("string"))
    for tool, build in _QUERIES.items():
        result = result.when(name == tool, build(values, q).cast("string"))
    number = F.when(name == "add", _LISTS["add"](values))
    for tool in ("multiply", "mean", "maximum", "minimum"):
        number = number.when(name == tool, _LISTS[tool](values))
    for tool in ("subtract", "divide"):
        number = number.when(name == tool, _PAIRS[tool](a, b))
    result = F.coalesce(result, number_text(number))
    return result, F.when(result.isNull(), "not_computed").otherwise("ok")


def execute(calls: DataFrame, cube: Cube, indicators: DataFrame, errors: str = "ignore") -> DataFrame:
    """``calls(call_id, name, arguments)`` with result (text; lists and objects as JSON), status and, for ``errors="raise"``, the error as result.

    Arguments are a map of texts; those that a tool does not know are not passed on.  Calls of unknown tools and calls
    without arguments fail in either way.  call_id tells the calls apart; repeated ids give repeated rows.
    """
    if errors not in ("ignore", "raise"):
        raise ValueError(f"unknown way to handle errors: {errors}")
    known = calls.select("call_id", "name", "arguments")
    empty = F.coalesce(F.size("arguments"), F.lit(0)) < 1
    own = known.where(F.col("name").isin(list(BY_NAME)) & ~empty)
    bad = known.where(~F.coalesce(F.col("name").isin(list(BY_NAME)), F.lit(False)) | empty)
    status = F.when(F.coalesce(F.col("name").isin(list(BY_NAME)), F.lit(False)), "no_arguments").otherwise("unknown_tool")
    parts = [bad.select("*", F.lit(None).cast("string").alias("result"), status.alias("status"))]
    result, state = _numeric()
    parts.append(own.where(F.col("name").isin([*_LISTS, *_PAIRS, *_QUERIES, "count"])).withColumns({"result": result, "status": state}))
    for tool, argument in (("think", "thought"), ("final_answer", "answer")):
        parts.append(own.where(F.col("name") == tool).withColumns({"result": _argument(argument), "status": F.lit("ok")}))

    def found(tool: str, build, out: str | Column, **given: Column) -> None:
        asked = own.where(F.col("name") == tool).withColumns({f"_{k}": v for k, v in given.items()})
        got = build(asked)
        text = F.col(out).cast("string") if isinstance(out, str) else out
        parts.append(got.withColumn("result", F.when(F.col("status") == "ok", text)).select("call_id", "name", "arguments", "result", "status"))

    geo = cube.geo
    found("get_country_code_from_name", lambda t: lookup.country_code(t, geo, "_n"), "country_code", n=_argument("country_name"))
    found("get_country_name_from_code", lambda t: lookup.country_name(t, geo, "_n"), "country_name", n=_argument("country_code"))
    found("get_indicator_code_from_name", lambda t: lookup.indicator_code(t, indicators, "_n"), "indicator_code", n=_argument("indicator_name"))
    found("get_indicator_name_from_code", lambda t: lookup.indicator_name(t, indicators, "_n"), "indicator_name", n=_argument("indicator_code"))
    found("get_country_codes_in_region", lambda t: lookup.region_members(t, geo, "_n"), F.to_json("country_codes"), n=_argument("region"))
    year = _argument("year").try_cast("int")
    found("retrieve_value", lambda t: lookup.retrieve_value(t.withColumnsRenamed({"_c": "country_code", "_i": "indicator_code", "_y": "year"}), geo, cube.observations), number_text(F.col("value")), c=_argument("country_code"), i=_argument("indicator_code"), y=year)
    parts.append(_searches(own.where("name = 'search_for_indicator_names'"), indicators))
    out = reduce(DataFrame.unionByName, parts)
    if errors == "raise":
        out = out.withColumn("result", F.when(F.col("status") == "ok", F.col("result")).otherwise(lookup.message(F.col("status"))))
    return out


def _searches(calls: DataFrame, indicators: DataFrame) -> DataFrame:
    """A search's result is what it found, one object a match, in keyword and catalogue order; finding nothing is an empty list."""
    asked = calls.select("call_id", _argument("keywords").alias("keywords")).distinct()
    found = lookup.search_names(asked.where("keywords IS NOT NULL"), indicators, "call_id")
    place = F.struct("keyword_no", F.col("indicator_code").alias("code"), "indicator_name", "indicator_description")
    listed = found.groupBy("call_id").agg(F.sort_array(F.collect_list(place)).alias("f"))
    shown = F.to_json(F.transform("f", lambda o: F.struct(o["indicator_name"].alias("indicator_name"), o["indicator_description"].alias("indicator_description"))))
    got = calls.join(listed.select("call_id", shown.alias("_shown")), "call_id", "left")
    result = F.when(_argument("keywords").isNotNull(), F.coalesce("_shown", F.lit("[]")))
    return got.select("call_id", "name", "arguments", result.alias("result"), F.when(result.isNull(), "not_computed").otherwise("ok").alias("status"))
