"""Answer matching: a table of (pred, gold, answer_format) texts in, (correct, error) out, by native expressions.

A text counts as parsed where it is a number, a boolean word or a list literal; what a call would throw on takes the fallback.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FLOATS, INTS, list_literal, percent_error

TOLERANCE = 0.01  # percent
_TRUE, _FALSE = ["true", "yes"], ["false", "no"]


def _number(text: Column) -> Column:
    """A Python number literal, or True / False as 1 / 0."""
    t = F.trim(text)
    return F.when(t == "True", 1.0).when(t == "False", 0.0).when(t.rlike(r"^[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?$"), t.try_cast("double"))


def _pair(correct: Column, error: Column) -> Column:
    return F.struct(F.coalesce(correct, F.lit(False)).alias("correct"), error.cast("double").alias("error"))


def match_float(pred: Column, gold: Column) -> Column:
    """M3: within TOLERANCE percent; else the gold text within the text, else any number in it."""
    p, g = _number(pred), gold.try_cast("double")
    error = percent_error(p, g)
    found = F.transform(F.regexp_extract_all(F.replace(pred, F.lit(","), F.lit("")), F.lit(FLOATS), F.lit(0)), lambda x: x.try_cast("double"))
    near = F.exists(found, lambda x: F.coalesce(percent_error(x, g) <= TOLERANCE, F.lit(False)))
    loose = F.contains(pred, F.trim(gold)) | near
    return F.when(p.isNotNull() & g.isNotNull(), _pair(error <= TOLERANCE, error)).otherwise(_pair(loose, F.when(loose, 0.0).otherwise(100.0)))


def match_bool(pred: Column, gold: Column) -> Column:
    """M4: words for true and false; any other text that is not empty or zero is true."""
    t, g = F.lower(F.trim(pred)), F.lower(F.trim(gold))
    truth = lambda x: F.when(x.isin(_TRUE), True).when(x.isin(_FALSE) | (x == "") | (x == "none") | (x == "[]"), False).otherwise(F.coalesce(x.try_cast("double") != 0, F.lit(True)))
    right = truth(t) == truth(g)
    return _pair(right, F.when(right, 0.0).otherwise(100.0))


def _items(text: Column) -> Column:
    bare = F.trim(F.trim(text), F.lit("[](){}"))
    split = F.filter(F.transform(F.split(bare, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(list_literal(F.trim(text)), split)


def match_list(pred: Column, gold: Column, names: Column) -> Column:
    """M5: equal as sets of lower-cased items, codes replaced by ``names`` (a map code -> name)."""
    same = lambda x: F.lower(F.when(F.trim(x).rlike("^[A-Z]{3}$"), F.coalesce(F.try_element_at(names, F.trim(x)), x)).otherwise(F.trim(x)))
    p, g = F.transform(_items(pred), same), F.transform(_items(gold), same)
    right = F.array_sort(F.array_distinct(p)) == F.array_sort(F.array_distinct(g))
    none = gold.isNull() | (F.trim(gold) == "")
    scalar = _number(pred).isNotNull()
    return F.when(none | scalar, _pair(F.lit(False), F.lit(100.0))).otherwise(_pair(right, F.when(right, 0.0).otherwise(F.abs(F.size(p) - F.size(g)))))


def match_int(pred: Column, gold: Column) -> Column:
    """M6: equal after truncation, error is the difference; else any whole number in the text.  What is too large for a long equals nothing."""
    x, y = _number(pred), gold.try_cast("double")
    p, g = x.try_cast("long"), y.try_cast("long")
    found = F.transform(F.regexp_extract_all(pred, F.lit(INTS), F.lit(0)), lambda x: x.try_cast("long"))
    loose = F.array_contains(found, g)
    whole = lambda n, d: F.coalesce(n.cast("double"), d)
    return F.when(x.isNotNull() & y.isNotNull(), _pair(p == g, F.when(p == g, 0.0).otherwise(whole(p, x) - whole(g, y)))).otherwise(_pair(loose, F.when(loose, 0.0).otherwise(100.0)))


def match_str(pred: Column, gold: Column, names: Column) -> Column:
    """M7: equal without case and ends, or the gold text within it, or a code of the gold name."""
    p, g = F.lower(F.trim(pred)), F.lower(F.trim(gold))
    named = F.lower(F.trim(F.try_element_at(names, F.trim(pred)))) == g
    right = (p == g) | ((g != "") & F.contains(p, g)) | F.coalesce(F.trim(pred).rlike("^[A-Z]{3}$") & named, F.lit(False))
    return _pair(right, F.when(right, 0.0).otherwise(100.0))


def match_fallback(pred: Column, gold: Column, names: Column) -> Column:
    """M8: the first kind that matches, in the order float, bool, list, int, str."""
    tries = [match_float(pred, gold), match_bool(pred, gold), match_list(pred, gold, names), match_int(pred, gold), match_str(pred, gold, names)]
    out = F.when(tries[0]["correct"], tries[0])
    for t in tries[1:]:
        out = out.when(t["correct"], t)
    return out.otherwise(_pair(F.lit(False), F.lit(100.0)))


def name_map(geo: DataFrame) -> DataFrame:
    """One row with ``names``, the map of codes to names (as small as the dimension)."""
    return geo.agg(F.map_from_entries(F.collect_list(F.struct("country_code", "country_name"))).alias("names"))


def match(rows: DataFrame, geo: DataFrame, pred: str = "pred", gold: str = "gold", kind: str = "answer_format") -> DataFrame:
    """M2 and M9: ``rows`` with correct and error; the format is the row's own column, null or unknown means the fallback."""
    joined = rows.crossJoin(name_map(geo))  # one row
    p, g, names = F.coalesce(F.col(pred), F.lit("None")), F.col(gold), F.col("names")
    result = (
        F.when(F.col(kind) == "float", match_float(p, g))
        .when(F.col(kind) == "bool", match_bool(p, g))
        .when(F.col(kind).startswith("list"), match_list(p, g, names))
        .when(F.col(kind) == "int", match_int(p, g))
        .when(F.col(kind) == "str", match_str(p, g, names))
        .otherwise(match_fallback(p, g, names))
    )
    return joined.withColumn("_m", result).select(*rows.columns, F.col("_m.correct").alias("correct"), F.col("_m.error").alias("error"))


def final_answer(messages: Column) -> Column:
    """M1: the answer of the first final_answer call of an assistant's message."""
    calls = F.flatten(F.transform(F.filter(messages, lambda m: (m["role"] == "assistant") & m["tool_calls"].isNotNull()), lambda m: m["tool_calls"]))
    final = F.filter(calls, lambda c: c["function"]["name"] == "final_answer")
    return F.try_element_at(F.get(final, F.lit(0))["function"]["arguments"], F.lit("answer"))
