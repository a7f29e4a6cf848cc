"""The lookup tools as set-based joins: a table of arguments in, the same rows with results and a status out.

Statuses stand for the errors of single calls; no row is lost and nothing is thrown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import list_literal, words

#: What a failed call says; the beginnings ``Error:`` and ``Warning:`` are told apart by scoring and graphs.
MESSAGES = {
    "invalid_indicator_name": "Error: indicator name not found",
    "invalid_indicator": "Error: indicator code not found",
    "invalid_country_name": "Error: country name not found",
    "invalid_region": "Error: region not found",
    "invalid_country": "Error: country code not found",
    "no_data": "Warning: no data available",
    "not_computed": "Error: the call could not be computed",
    "unknown_tool": "Error: no such tool",
    "no_arguments": "Error: no arguments given",
}


def message(status: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in MESSAGES.items() for x in kv)), status)


def small(dim: DataFrame, of: DataFrame | None = None, rows: int = 1_000_000) -> DataFrame:
    """A dimension, marked for broadcast if a count finds it (or ``of``, the rows it gathers) has at most ``rows`` rows."""
    return F.broadcast(dim) if (dim if of is None else of).limit(rows + 1).count() <= rows else dim


def cell_values(observations: DataFrame) -> DataFrame:
    """One row a cell (indicator_code, country_code, year) that has a value: the mean of repeated ones, to 5 decimals."""
    cells = observations.groupBy("indicator_code", "country_code", "year").agg(F.round(F.avg(F.nanvl("value", F.lit(None).cast("double"))), 5).alias("value"))
    return cells.where("value IS NOT NULL")


def _by(args: DataFrame, arg: str, dim: DataFrame, key: str, value: str, out: str, status: str) -> DataFrame:
    # unique keys: the first in the dimension's order (of values, where it has none) counts
    side = dim.groupBy(F.col(key).alias("_key")).agg(F.min_by(value, F.struct("pos", value) if "pos" in dim.columns else value).alias(out))
    got = args.join(small(side), F.col(arg) == F.col("_key"), "left").drop("_key")
    return got.withColumn("status", F.when(F.col(out).isNull(), F.lit(status)).otherwise(F.lit("ok")))


def country_code(args: DataFrame, geo: DataFrame, arg: str = "country_name") -> DataFrame:
    """L2: exact, case-sensitive."""
    return _by(args, arg, geo.withColumnRenamed("country_name", "_n"), "_n", "country_code", "country_code", "invalid_country_name")


def country_name(args: DataFrame, geo: DataFrame, arg: str = "country_code") -> DataFrame:
    """L3."""
    return _by(args, arg, geo.withColumnRenamed("country_code", "_c"), "_c", "country_name", "country_name", "invalid_country")


def indicator_code(args: DataFrame, indicators: DataFrame, arg: str = "indicator_name") -> DataFrame:
    """L4: the argument's ends are trimmed first."""
    got = _by(args.withColumn("_arg", F.trim(arg)), "_arg", indicators, "name", "id", "indicator_code", "invalid_indicator_name")
    return got.drop("_arg")


def indicator_name(args: DataFrame, indicators: DataFrame, arg: str = "indicator_code") -> DataFrame:
    """L5."""
    return _by(args, arg, indicators, "id", "name", "indicator_name", "invalid_indicator")


def region_members(args: DataFrame, geo: DataFrame, arg: str = "region") -> DataFrame:
    """The region's country codes in the dimension's order."""
    side = geo.where("region IS NOT NULL").groupBy(F.col("region").alias("_r")).agg(F.sort_array(F.collect_list(F.struct("pos", "country_code"))).alias("_m"))
    got = args.join(small(side, geo), F.col(arg) == F.col("_r"), "left").withColumn("country_codes", F.transform("_m", lambda m: m["country_code"]))
    return got.withColumn("status", F.when(F.col("_r").isNull(), "invalid_region").otherwise("ok")).drop("_r", "_m")


def retrieve_value(args: DataFrame, geo: DataFrame, observations: DataFrame) -> DataFrame:
    """L7 for args(country_code, indicator_code, year): value and status, checked in the order country, indicator, data."""
    countries = small(geo.select("country_code").distinct().withColumn("_country", F.lit(True)))
    indicators = small(observations.select("indicator_code").distinct().withColumn("_indicator", F.lit(True)))
    got = args.join(countries, "country_code", "left").join(indicators, "indicator_code", "left").join(cell_values(observations), ["country_code", "indicator_code", "year"], "left")
    status = F.when(F.col("_country").isNull(), "invalid_country").when(F.col("_indicator").isNull(), "invalid_indicator").when(F.col("value").isNull(), "no_data").otherwise("ok")
    return got.withColumn("status", status).withColumn("value", F.when(status == "ok", F.col("value"))).drop("_country", "_indicator")


def asked_words(args: DataFrame, key: str, arg: str) -> DataFrame:
    """(key, keyword_no, keyword): the words of a list literal of keywords or of one text."""
    given = F.coalesce(list_literal(F.col(arg)), F.array(arg))
    split = F.flatten(F.transform(given, lambda g: F.transform(F.split(g, r"\s+"), lambda w: F.trim(w, F.lit(",")))))
    return args.select(key, F.posexplode(split).alias("keyword_no", "keyword")).where("keyword <> ''")


def search_names(args: DataFrame, indicators: DataFrame, key: str = "query_id", arg: str = "keywords") -> DataFrame:
    """L1: a row for each (indicator, matching keyword), in catalogue and keyword order; a name given whole in lower case is itself the answer.

    Keywords are a list literal or one text; each is split at white space, commas taken off its words' ends.  A keyword matches
    a name that has it among its words, brackets and commas taken off.
    """
    names = indicators.select(F.col("id").alias("indicator_code"), F.col("name").alias("indicator_name"), F.col("description").alias("indicator_description"), F.lower("name").alias("_low"))
    whole = args.join(small(names), F.col(arg) == F.col("_low"))
    whole = whole.select(key, F.lit(0).alias("keyword_no"), F.col(arg).alias("keyword"), "indicator_code", "indicator_name", "indicator_description")
    rest = args.join(whole.select(key).distinct(), key, "left_anti")
    asked = asked_words(rest, key, arg)
    tokens = names.select("indicator_code", "indicator_name", "indicator_description", F.explode(F.array_distinct(words(F.col("indicator_name"), "(),"))).alias("_token"))
    found = asked.join(small(tokens), F.lower("keyword") == F.col("_token")).drop("_token")
    return whole.unionByName(found.select(*whole.columns))
