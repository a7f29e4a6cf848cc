"""Gold action traces: the calls that answer a question, in order, as an array of structs.

A trace is a sequence of steps per template.  A step is one call, a call per member of a region, or a call per selected member; traces
end where an answer becomes impossible, and calls that find no value stay, with a null result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators.cells import Cube
from . import templates as T


def _text(x: Column) -> Column:
    return x.cast("string")


def _list(v: Column) -> Column:
    return F.to_json(N.known(v))


def call(name: str, result: Column, **arguments: Column) -> Column:
    args = F.create_map(*(x for k, v in arguments.items() for x in (F.lit(k), _text(v))))
    return F.struct(F.lit(name).alias("name"), args.alias("arguments"), _text(result).alias("result"), F.lit(None).cast("string").alias("id"))


def _one(c: Column) -> Column:
    return F.array(c)


def _codes(slot: str) -> Column:
    """C: a subject's code from its name."""
    return _one(call("get_country_code_from_name", F.col(slot), country_name=F.col(f"{slot}_name")))


def _property() -> Column:
    """S and I: search for the property's name, then its code."""
    name = F.col("property_original")
    return F.concat(_one(call("search_for_indicator_names", name, keywords=name)), _one(call("get_indicator_code_from_name", F.col("property"), indicator_name=name)))


def _region(slot: str) -> Column:
    """R: a region's members."""
    return _one(call("get_country_codes_in_region", F.to_json(F.transform(f"m_{slot}", lambda m: m["code"])), region=F.col(slot)))


def _value(code: Column, year: Column, value: Column) -> Column:
    return call("retrieve_value", value, country_code=code, indicator_code=F.col("property"), year=year)


def _point(slot: str, year: str) -> Column:
    return _one(_value(F.col(slot), F.col(year), T._at(slot, year)))


def _members(slot: str, year: str) -> Column:
    """V*: a region's values in order."""
    return F.transform(T._cells(slot, year), lambda m: _value(m["code"], F.col(year), m["value"]))


def _compare(a: Column, b: Column) -> Column:
    higher = F.col("operator") == "higher"
    return _one(call("greater_than", T._higher(a, b), value_a=F.when(higher, a).otherwise(b), value_b=F.when(higher, b).otherwise(a)))


def _pair(name: str, result: Column, a: Column, b: Column) -> Column:
    return _one(call(name, result, value_a=a, value_b=b))


def _tool(name: str, v: Column) -> Column:
    build = {"mean": N.mean, "add": N.add, "maximum": N.maximum, "minimum": N.minimum, "sort": N.sort}[name]
    result = F.to_json(N.sort(v)) if name == "sort" else build(v)
    return _one(call(name, result, values=_list(v)))


def _best(v: Column) -> Column:
    return F.when(F.col("operator") == "highest", _tool("maximum", v)).otherwise(_tool("minimum", v))


def _names(cells: Column) -> Column:
    return F.transform(cells, lambda m: call("get_country_name_from_code", m["name"], country_code=m["code"]))


def _if(condition: Column, steps: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), steps).otherwise(F.filter(steps, lambda x: F.lit(False)))


def _final(answer: Column) -> Column:
    return _one(call("final_answer", answer, answer=answer))


def _steps(name: str) -> Column:
    able, answer = F.col("answerable"), F.col("answer")
    own = lambda y: T._at("subject", y)
    cells, v = (lambda s, y: T._cells(s, y)), (lambda s, y: T._values(T._cells(s, y)))
    has = lambda s, y: F.size(N.known(v(s, y))) > 0
    if name == "PropertyOfSubject":
        return F.concat(_codes("subject"), _property(), _point("subject", "year"))
    if name == "SubjectPropertyChange":
        a, b = own("year_a"), own("year_b")
        some = a.isNotNull() | b.isNotNull()
        return F.concat(_codes("subject"), _property(), _point("subject", "year_a"), _point("subject", "year_b"), _if(some, _pair("subtract", N.subtract(b, a), b, a)), _if(some, _final(N.subtract(b, a))))
    if name == "AverageChange":
        years = F.sequence(F.col("year_a").cast("int"), F.col("year_b").cast("int"))
        at = lambda y: F.try_element_at(F.col("s_subject"), y)
        later = F.slice(years, 2, F.size(years) - 1)
        steps = F.transform(later, lambda y: N.subtract(at(y), at(y - 1)))
        return F.concat(
            _codes("subject"), _property(), F.transform(years, lambda y: _value(F.col("subject"), y, at(y))),
            _if(able, F.concat(F.transform(F.filter(later, lambda y: at(y).isNotNull() & at(y - 1).isNotNull()), lambda y: call("subtract", N.subtract(at(y), at(y - 1)), value_a=at(y), value_b=at(y - 1))), _tool("mean", steps))),
        )
    if name == "CountryPropertyComparison":
        a, b = T._at("subject_a", "year_a"), T._at("subject_b", "year_b")
        return F.concat(_codes("subject_a"), _codes("subject_b"), _property(), _point("subject_a", "year_a"), _point("subject_b", "year_b"), _if(able, _compare(a, b)))
    if name == "PropertyRatioComparison":
        a, b = T._at("subject_a", "year"), T._at("subject_b", "year")
        return F.concat(_property(), _codes("subject_a"), _codes("subject_b"), _point("subject_a", "year"), _point("subject_b", "year"), _if(able, _pair("divide", N.divide(a, b), a, b)))
    if name in ("AverageProperty", "TotalProperty"):
        return F.concat(_region("region"), _property(), _members("region", "year"), _if(able, _tool("mean" if name == "AverageProperty" else "add", v("region", "year"))))
    if name == "RegionPropertyRatio":
        x = v("region", "year")
        return F.concat(_region("region"), _property(), _members("region", "year"), _if(able, F.concat(_tool("maximum", x), _tool("minimum", x))), _if(able & (N.minimum(x) != 0), _pair("divide", answer, N.maximum(x), N.minimum(x))))
    if name == "RegionComparison":
        first = T._first_at(cells("region", "year"), T._extreme(v("region", "year")))
        return F.concat(_region("region"), _property(), _members("region", "year"), _if(able, F.concat(_best(v("region", "year")), _names(F.array(first)))))
    if name == "RegionComparisonResult":
        code = T._first_at(cells("region", "year_2"), T._extreme(v("region", "year_2")))["code"]
        then = T._pick(cells("region", "year_1"), code)
        return F.concat(_region("region"), _property(), _members("region", "year_2"), _if(has("region", "year_2"), F.concat(_best(v("region", "year_2")), _one(_value(code, F.col("year_1"), then)))))
    if name == "RegionPropertyChange":
        pairs = F.zip_with(cells("region", "year_a"), cells("region", "year_b"), lambda a, b: F.struct(a["code"].alias("code"), a["name"].alias("name"), a["value"].alias("a"), b["value"].alias("b"), N.subtract(b["value"], a["value"]).alias("value")))
        each = lambda m: F.concat(F.array(_value(m["code"], F.col("year_a"), m["a"]), _value(m["code"], F.col("year_b"), m["b"])), _if(m["value"].isNotNull(), _pair("subtract", m["value"], m["b"], m["a"])))
        top = F.filter(pairs, lambda m: m["value"] == T._extreme(T._values(pairs)))
        return F.concat(_region("region"), _property(), F.flatten(F.transform(pairs, each)), _if(able, F.concat(_best(T._values(pairs)), _names(top))))
    if name == "TopNTotal":
        chosen = F.filter(cells("region", "year"), lambda m: F.array_contains(answer, m["name"]))
        return F.concat(_region("region"), _property(), _members("region", "year"), _if(able, _tool("sort", v("region", "year"))), _if(answer.isNotNull(), _names(chosen)))
    if name == "SubjectPropertyRank":
        own_value = T._pick(cells("region", "year"), F.col("subject"))
        return F.concat(_codes("subject"), _property(), _region("region"), _members("region", "year"), _if(able, F.concat(_one(call("rank", answer, values=_list(v("region", "year")), query_value=own_value)), _final(answer))))
    if name == "RankChange":
        ranks = [N.rank(v("region", y), T._pick(cells("region", y), F.col("subject"))) for y in ("year_a", "year_b")]
        step = lambda y, r: _one(call("rank", r, values=_list(v("region", y)), query_value=T._pick(cells("region", y), F.col("subject"))))
        return F.concat(_property(), _region("region"), _members("region", "year_a"), _members("region", "year_b"), _if(able, F.concat(step("year_a", ranks[0]), step("year_b", ranks[1]), _pair("subtract", answer, ranks[1], ranks[0]))))
    if name == "RegionProportion":
        own_value, share, x = T._share("year")
        head = F.concat(_property(), _region("region"), _one(_value(F.col("subject"), F.col("year"), own_value)))
        return F.concat(head, _if(own_value.isNotNull(), F.concat(_members("region", "year"), _tool("add", x), _pair("divide", share, own_value, N.add(x)))))
    if name == "RegionProportionChange":
        (a, sa, va), (b, sb, vb) = T._share("year_a"), T._share("year_b")
        head = F.concat(_property(), _region("region"), _one(_value(F.col("subject"), F.col("year_a"), a)), _if(a.isNotNull(), _one(_value(F.col("subject"), F.col("year_b"), b))))
        rest = F.concat(_members("region", "year_a"), _members("region", "year_b"), _tool("add", va), _tool("add", vb), _pair("divide", sa, a, N.add(va)), _pair("divide", sb, b, N.add(vb)), _compare(sa, sb))
        return F.concat(head, _if(a.isNotNull() & b.isNotNull(), rest))
    if name == "AveragePropertyComparison":
        x = v("region", "year")
        rest = F.concat(_region("region"), _members("region", "year"), _if(able, F.concat(_tool("mean", x), _compare(own("year"), N.mean(x)))))
        return F.concat(_codes("subject"), _property(), _point("subject", "year"), _if(own("year").isNotNull(), rest))
    if name in ("RegionAverageComparison", "RegionRangeComparison"):
        x, y = v("region_a", "year"), v("region_b", "year")
        width = lambda z: N.subtract(N.maximum(z), N.minimum(z))
        if name == "RegionAverageComparison":
            part = lambda s, z: F.concat(_region(s), _members(s, "year"), _if(F.size(N.known(z)) > 0, _tool("mean", z)))
            last = _compare(N.mean(x), N.mean(y))
        else:
            part = lambda s, z: F.concat(_region(s), _members(s, "year"), _if(F.size(N.known(z)) > 0, F.concat(_tool("maximum", z), _tool("minimum", z), _pair("subtract", width(z), N.maximum(z), N.minimum(z)))))
            last = _compare(width(x), width(y))
        return F.concat(_property(), part("region_a", x), _if(has("region_a", "year"), part("region_b", y)), _if(able, last))
    if name == "CountryThresholdCount":
        x, limit = v("region", "year"), own("year")
        higher = F.col("operator") == "higher"
        each = F.transform(x, lambda z: call("greater_than", F.when(higher, z > limit).otherwise(limit > z), value_a=F.when(higher, z).otherwise(limit), value_b=F.when(higher, limit).otherwise(z)))
        true = F.filter(F.transform(x, lambda z: F.when(higher, z > limit).otherwise(z < limit)), lambda t: t)
        return F.concat(_region("region"), _codes("subject"), _property(), _members("region", "year"), _if(has("region", "year"), _point("subject", "year")), _if(able, F.concat(each, _one(call("count", answer, values=F.to_json(true))))))
    raise ValueError(f"unknown template {name}")


def gold_actions(questions: DataFrame, cube: Cube, name: str, names: DataFrame) -> DataFrame:
    """Answered ``questions`` with ``actions``; ``names(property, property_original)`` gives the properties' own names."""
    template = T.TEMPLATES[name]
    q = questions.join(names, "property", "left")
    for s in [s for s in template.slots if s.startswith("subject")]:
        q = q.join(cube.geo.select(F.col("country_code").alias(s), F.col("country_name").alias(f"{s}_name")), s, "left")
    return T.solved(T.bind(q, cube, template), template).select(*q.columns, *T.RESULT, _steps(name).alias("actions"))
