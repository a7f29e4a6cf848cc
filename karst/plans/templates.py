"""The twenty question templates: wording, slots, constraint, and the answer as column expressions.

A template answers a whole table of questions (question_id, property and its slots).  Its data is bound by equality joins (see
``operators.cells``); everything after that is arithmetic on bounded arrays, so a plan has one join per slot and no shuffle of
its own.  ``answer`` is typed by the template; answerable and data_availability are full / partial / missing as data are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators.cells import Cube, with_series, with_vectors

#: (answer, answerable, availability)
Result = tuple[Column, Column, Column]


@dataclass(frozen=True)
class Template:
    name: str
    answer_format: str
    wording: tuple[str, ...]
    slots: tuple[str, ...]
    subjects: tuple[str, ...]
    regions: tuple[tuple[str, str], ...]
    solve: Callable[[], Result]
    valid: Callable[[], Column]


def _c(name: str) -> Column:
    return F.col(name)


def _at(slot: str, year: str) -> Column:
    return F.try_element_at(_c(f"s_{slot}"), _c(year).cast("int"))


def _cells(region: str, year: str) -> Column:
    return _c(f"v_{region}_{year}")


def _values(cells: Column) -> Column:
    return F.transform(cells, lambda m: m["value"])


def _state(*groups: Column) -> tuple[Column, Column]:
    """(all of some group missing, availability) of arrays of values."""
    have = [F.coalesce(F.size(N.known(g)), F.lit(0)) for g in groups]
    none = [h == 0 for h in have]
    gap = [h < F.size(g) for h, g in zip(have, groups, strict=True)]
    missing = none[0]
    partial = gap[0]
    for n, p in zip(none[1:], gap[1:], strict=True):
        missing, partial = missing | n, partial | p
    return missing, F.when(missing, "missing").when(partial, "partial").otherwise("full")


def _result(answer: Column, missing: Column, state: Column) -> Result:
    return F.when(~missing, answer), ~missing, F.when(missing, "missing").otherwise(state)


def _higher(a: Column, b: Column) -> Column:
    """lower is greater_than with its arguments changed over."""
    return F.when(_c("operator") == "higher", N.greater_than(a, b)).otherwise(N.greater_than(b, a))


def _extreme(values: Column) -> Column:
    return F.when(_c("operator") == "highest", N.maximum(values)).otherwise(N.minimum(values))


def _pick(cells: Column, code: Column) -> Column:
    return F.get(F.filter(cells, lambda m: m["code"] == code), F.lit(0))["value"]


def _both(a: Column, b: Column, answer: Column) -> Result:
    """Two single values: one missing is partial, and neither way answerable."""
    nulls = a.isNull().cast("int") + b.isNull().cast("int")
    return F.when(nulls == 0, answer), nulls == 0, F.when(nulls == 2, "missing").when(nulls == 1, "partial").otherwise("full")


def _point() -> Result:
    v = _at("subject", "year")
    return _result(v, v.isNull(), F.lit("full"))


def _change() -> Result:
    a, b = _at("subject", "year_a"), _at("subject", "year_b")
    return _both(a, b, N.subtract(b, a))


def _average_change() -> Result:
    years = F.sequence(_c("year_a").cast("int"), _c("year_b").cast("int"))
    values = F.transform(years, lambda y: F.try_element_at(_c("s_subject"), y))
    steps = F.transform(years, lambda y: N.subtract(F.try_element_at(_c("s_subject"), y), F.try_element_at(_c("s_subject"), y - 1)))
    steps = F.slice(steps, 2, F.greatest(F.size(years) - 1, F.lit(0)))
    _, state = _state(values)
    return _result(N.mean(steps), F.coalesce(F.size(N.known(steps)) == 0, F.lit(True)), state)


def _country_comparison() -> Result:
    a, b = _at("subject_a", "year_a"), _at("subject_b", "year_b")
    return _both(a, b, _higher(a, b))


def _ratio() -> Result:
    a, b = _at("subject_a", "year"), _at("subject_b", "year")
    return _result(N.divide(a, b), a.isNull() | b.isNull() | F.coalesce(b == 0, F.lit(False)), F.lit("full"))


def _over_region(tool: Callable[[Column], Column]) -> Callable[[], Result]:
    def solve() -> Result:
        v = _values(_cells("region", "year"))
        missing, state = _state(v)
        return _result(tool(v), missing, state)

    return solve


def _region_ratio() -> Result:
    v = _values(_cells("region", "year"))
    missing, state = _state(v)
    low = N.minimum(v)
    return _result(N.divide(N.maximum(v), low), missing, F.when(low == 0, "partial").otherwise(state))


def _first_at(cells: Column, value: Column) -> Column:
    return F.get(F.filter(cells, lambda m: m["value"] == value), F.lit(0))


def _region_best() -> Result:
    cells = _cells("region", "year")
    missing, state = _state(_values(cells))
    return _result(_first_at(cells, _extreme(_values(cells)))["name"], missing, state)


def _region_best_then() -> Result:
    cells = _cells("region", "year_2")
    missing, state = _state(_values(cells))
    then = _pick(_cells("region", "year_1"), _first_at(cells, _extreme(_values(cells)))["code"])
    return _result(then, missing | then.isNull(), state)


def _region_change() -> Result:
    pairs = F.zip_with(_cells("region", "year_a"), _cells("region", "year_b"), lambda a, b: F.struct(a["name"].alias("name"), N.subtract(b["value"], a["value"]).alias("value")))
    missing, state = _state(_values(pairs))
    best = _extreme(_values(pairs))
    return _result(F.transform(F.filter(pairs, lambda m: m["value"] == best), lambda m: m["name"]), missing, state)


def _top_n() -> Result:
    cells = _cells("region", "year")
    v = _values(cells)
    missing, state = _state(v)
    s, n = N.sort(v), _c("n").cast("int")
    edge = F.when(_c("operator") == "highest", F.get(s, F.size(s) - n)).otherwise(F.get(s, n - 1))
    top = F.filter(cells, lambda m: F.when(_c("operator") == "highest", m["value"] >= edge).otherwise(m["value"] <= edge))
    few = F.size(s) < n
    return _result(F.when(~few, F.transform(top, lambda m: m["name"])), missing, F.when(few, "partial").otherwise(state))


def _subject_rank() -> Result:
    cells = _cells("region", "year")
    own = _pick(cells, _c("subject"))
    missing, state = _state(_values(cells))
    return _result(N.rank(_values(cells), own), missing | own.isNull(), state)


def _rank_change() -> Result:
    a, b = _cells("region", "year_a"), _cells("region", "year_b")
    own_a, own_b = _pick(a, _c("subject")), _pick(b, _c("subject"))
    missing, state = _state(_values(a), _values(b))
    gone = own_a.isNull() | own_b.isNull()
    change = N.subtract(N.rank(_values(b), own_b).cast("double"), N.rank(_values(a), own_a).cast("double"))
    return F.when(~missing & ~gone, change), ~missing & ~gone, F.when(missing, "missing").when(gone, "partial").otherwise(state)


def _share(year: str) -> tuple[Column, Column, Column]:
    cells = _cells("region", year)
    own = _pick(cells, _c("subject"))
    return own, N.divide(own, N.add(_values(cells))), _values(cells)


def _proportion() -> Result:
    own, share, v = _share("year")
    return _result(share, own.isNull(), _state(v)[1])


def _proportion_change() -> Result:
    own_a, share_a, va = _share("year_a")
    own_b, share_b, vb = _share("year_b")
    return _result(_higher(share_a, share_b), own_a.isNull() | own_b.isNull(), _state(va, vb)[1])


def _average_comparison() -> Result:
    own, v = _at("subject", "year"), _values(_cells("region", "year"))
    missing, state = _state(v)
    return _result(_higher(own, N.mean(v)), own.isNull() | missing, state)


def _two_regions(tool: Callable[[Column], Column]) -> Callable[[], Result]:
    def solve() -> Result:
        a, b = _values(_cells("region_a", "year")), _values(_cells("region_b", "year"))
        missing, state = _state(a, b)
        return _result(_higher(tool(a), tool(b)), missing, state)

    return solve


def _threshold_count() -> Result:
    own, v = _at("subject", "year"), _values(_cells("region", "year"))
    missing, state = _state(v)
    higher = F.size(F.filter(v, lambda x: x > own))
    lower = F.size(F.filter(v, lambda x: x < own))
    return _result(F.when(_c("operator") == "higher", higher).otherwise(lower).cast("long"), missing | own.isNull(), state)


def _any() -> Column:
    return F.lit(True)


def _differ(a: str, b: str) -> Callable[[], Column]:
    return lambda: _c(a) != _c(b)


def _member() -> Column:
    return _c("subject_region") == _c("region")


# The wording of the questions.
TEMPLATES = {
    t.name: t
    for t in [
        Template("PropertyOfSubject", "float", (
            "What was the {property} of {subject} in {year}?",
            "In {year}, what was the {property} of {subject}?",
        ), ("property", "subject", "year"), ("subject",), (), _point, _any),
        Template("SubjectPropertyChange", "float", (
            "What was the change in the {property} of {subject} between {year_a} and {year_b}?",
            "By how much did the {property} of {subject} change between {year_a} and {year_b}?",
            "What was the difference in the {property} of {subject} between {year_a} and {year_b}?",
            "Between {year_a} and {year_b}, what was the change in the {property} of {subject}?",
        ), ("property", "subject", "year_a", "year_b"), ("subject",), (), _change, lambda: _c("year_a") < _c("year_b")),
        Template("AverageChange", "float", (
            "What was the average yearly change in the {property} in {subject} for each year between {year_a} and {year_b}?",
            "For each year between {year_a} and {year_b}, what was the average yearly change in the {property} in {subject}?",
            "What was the average yearly change in {subject}'s {property} for each year between {year_a} and {year_b}?",
            "For each year between {year_a} and {year_b}, what was the average yearly change in {subject}'s {property}?",
        ), ("property", "subject", "year_a", "year_b"), ("subject",), (), _average_change, lambda: _c("year_b") - _c("year_a") >= 3),
        Template("CountryPropertyComparison", "bool", (
            "Did {subject_a} have a {operator} {property} in {year_a} than {subject_b} had in {year_b}?",
            "Was the {property} of {subject_a} in {year_a} {operator} than that of {subject_b} in {year_b}?",
            "In {year_a}, was the {property} of {subject_a} {operator} than that of {subject_b} in {year_b}?",
            "In {year_a}, was {subject_a}'s {property} {operator} than {subject_b}'s in {year_b}?",
        ), ("property", "subject_a", "subject_b", "operator", "year_a", "year_b"), ("subject_a", "subject_b"), (), _country_comparison,
            lambda: (_c("subject_a") != _c("subject_b")) & (_c("year_a") != _c("year_b"))),
        Template("PropertyRatioComparison", "float", (
            "What was the ratio of the {property} of {subject_a} to {subject_b} in {year}?",
            "In {year}, what was the ratio of {subject_a}'s {property} to {subject_b}'s?",
            "What was the value of {subject_a}'s {property} divided by {subject_b}'s in {year}?",
        ), ("property", "subject_a", "subject_b", "year"), ("subject_a", "subject_b"), (), _ratio, _differ("subject_a", "subject_b")),
        Template("AverageProperty", "float", (
            "What was the average {property} of the countries in {region} in {year}?",
            "For the countries in {region}, what was the average {property} in {year}?",
            "In {year}, what was the average {property} of the countries in {region}?",
        ), ("property", "region", "year"), (), (("region", "year"),), _over_region(N.mean), _any),
        Template("TotalProperty", "float", (
            "What was the total {property} of the countries in the region of {region} in {year}?",
            "In {year}, what was the total {property} of the countries in the region of {region}?",
            "For the countries in the region of {region}, what was the total {property} in {year}?",
        ), ("property", "region", "year"), (), (("region", "year"),), _over_region(N.add), _any),
        Template("RegionPropertyRatio", "float", (
            "What was the ratio of the highest value to the lowest for the {property} of {region} in {year}?",
            "In {region}, what was the ratio of the highest value of {property} to the lowest in {year}?",
            "In {year}, what was the ratio of the highest value of {property} to the lowest for {region}?",
        ), ("property", "region", "year"), (), (("region", "year"),), _region_ratio, _any),
        Template("RegionComparison", "str", (
            "Which country in the region of {region} had the {operator} {property} in {year}?",
            "In {region}, which country had the {operator} {property} in {year}?",
            "For the countries in {region}, which had the {operator} {property} in {year}?",
        ), ("property", "region", "operator", "year"), (), (("region", "year"),), _region_best, _any),
        Template("RegionComparisonResult", "float", (
            "For the country in {region} that had the {operator} {property} in {year_2}, what was its value in {year_1}?",
            "In {year_1}, what was the {property} for the country in {region} that had the {operator} value for that indicator in {year_2}?",
            "What was the {property} in {year_1} for the country in {region} that had the {operator} value for that indicator in {year_2}?",
        ), ("property", "region", "operator", "year_1", "year_2"), (), (("region", "year_1"), ("region", "year_2")), _region_best_then, _differ("year_1", "year_2")),
        Template("RegionPropertyChange", "list[str]", (
            "Which country in {region} had the {operator} change in {property} between {year_a} and {year_b}?",
            "Between {year_a} and {year_b}, which country in {region} had the {operator} change in {property}?",
            "For the countries in {region}, which had the {operator} change in {property} between {year_a} and {year_b}?",
        ), ("property", "region", "operator", "year_a", "year_b"), (), (("region", "year_a"), ("region", "year_b")), _region_change, _differ("year_a", "year_b")),
        Template("TopNTotal", "list[str]", (
            "Which {n} countries in {region} had the {operator} {property} in {year}?",
            "In {region}, which {n} countries had the {operator} {property} in {year}?",
            "In {year}, which {n} countries in {region} had the {operator} {property}?",
        ), ("property", "region", "operator", "n", "year"), (), (("region", "year"),), _top_n, _any),
        Template("SubjectPropertyRank", "int", (
            "What rank did {subject} have for {property} among countries in {region} in {year}?",
            "In {year}, what was the rank of {subject} for {property} among countries in {region}?",
            "Among countries in {region}, what was the rank of {subject} for {property} in {year}?",
        ), ("property", "subject", "region", "year"), (), (("region", "year"),), _subject_rank, _member),
        Template("RankChange", "int", (
            "Among the countries in {region}, what was the change in rank of {subject} for {property} between {year_a} and {year_b}?",
            "What was the change in rank of {subject} for {property} in {region} between {year_a} and {year_b}?",
            "Between {year_a} and {year_b}, how did the rank of {subject} for {property} change among countries in {region}?",
        ), ("property", "subject", "region", "year_a", "year_b"), (), (("region", "year_a"), ("region", "year_b")), _rank_change, lambda: _member() & (_c("year_a") != _c("year_b"))),
        Template("RegionProportion", "float", (
            "In {year}, what proportion of the total {property} of {region} was contributed by {subject}?",
            "What proportion of the total {property} of {region} in {year} was contributed by {subject}?",
            "For the countries in {region}, what proportion of the total {property} was contributed by {subject} in {year}?",
            "What proportion of the total {property} was contributed by {subject} for the countries in {region} in {year}?",
        ), ("property", "subject", "region", "year"), (), (("region", "year"),), _proportion, _member),
        Template("RegionProportionChange", "bool", (
            "Was {subject}'s share of the total {property} in {region} {operator} in {year_a} than it was in {year_b}?",
            "In {year_a}, was {subject}'s share of the total {property} in {region} {operator} than it was in {year_b}?",
            "Compared to {region} as a whole, was {subject}'s share of the total {property} {operator} in {year_a} than it was in {year_b}?",
        ), ("property", "subject", "region", "operator", "year_a", "year_b"), (), (("region", "year_a"), ("region", "year_b")), _proportion_change,
            lambda: _member() & (_c("year_a") != _c("year_b"))),
        Template("AveragePropertyComparison", "bool", (
            "Was the {property} of {subject} {operator} than the average value for {region} in {year}?",
            "In {year}, was the {property} of {subject} {operator} than the average value for {region}?",
            "Was {subject}'s {property} {operator} than the average value for {region} in {year}?",
            "In {year}, was {subject}'s {property} {operator} than the average value for {region}?",
        ), ("property", "subject", "region", "operator", "year"), ("subject",), (("region", "year"),), _average_comparison, _any),
        Template("RegionAverageComparison", "bool", (
            "Did {region_a} have a {operator} average {property} than {region_b} in {year}?",
            "In {year}, did {region_a} have a {operator} average {property} than {region_b}?",
            "Was the average {property} in {region_a} {operator} than in {region_b} in {year}?",
        ), ("property", "region_a", "region_b", "operator", "year"), (), (("region_a", "year"), ("region_b", "year")), _two_regions(N.mean), _differ("region_a", "region_b")),
        Template("RegionRangeComparison", "bool", (
            "Did {region_a} have a {operator} range of values for {property} than {region_b} in {year}?",
            "In {year}, did {region_a} have a {operator} range of values for {property} than {region_b}?",
            "In {region_a}, was the range of values for {property} {operator} than that of {region_b} in {year}?",
        ), ("property", "region_a", "region_b", "operator", "year"), (), (("region_a", "year"), ("region_b", "year")),
            _two_regions(lambda v: N.subtract(N.maximum(v), N.minimum(v))), _differ("region_a", "region_b")),
        Template("CountryThresholdCount", "int", (
            "How many countries in the region of {region} had a {operator} {property} than {subject} in {year}?",
            "In {year}, how many countries in the region of {region} had a {operator} {property} than {subject}?",
            "In {region}, how many countries had a {operator} {property} than {subject} in {year}?",
        ), ("property", "subject", "region", "operator", "year"), ("subject",), (("region", "year"),), _threshold_count, lambda: _c("subject_region") != _c("region")),
    ]
}

# Splits that a template does not fill, by its real name.
_NO_UNANSWERABLE_PARTIAL = ["AverageChange", "AverageProperty", "TotalProperty", "RegionPropertyRatio", "RegionComparisonResult", "RegionPropertyChange", "TopNTotal", "SubjectPropertyRank", "AveragePropertyComparison", "RegionAverageComparison", "RegionRangeComparison", "CountryThresholdCount"]
_NO_ANSWERABLE_PARTIAL = ["SubjectPropertyChange", "CountryPropertyComparison", "RankChange"]
_NEITHER = ["PropertyOfSubject", "PropertyRatioComparison", "RegionComparison", "RegionProportion", "RegionProportionChange"]
SKIPPED = sorted(
    [(t, "unanswerable-partial") for t in _NO_UNANSWERABLE_PARTIAL + _NEITHER] + [(t, "answerable-partial") for t in _NO_ANSWERABLE_PARTIAL + _NEITHER]
)


def bind(questions: DataFrame, cube: Cube, template: Template) -> DataFrame:
    """``questions`` with the template's series and vectors."""
    return with_vectors(with_series(questions, cube, list(template.subjects)), cube, list(template.regions))


RESULT = ["answer", "answerable", "data_availability"]


def solved(bound: DataFrame, template: Template) -> DataFrame:
    """Bound questions with the columns of ``RESULT``."""
    value, able, state = template.solve()
    return bound.withColumns(dict(zip(RESULT, (value, F.coalesce(able, F.lit(False)), F.coalesce(state, F.lit("missing"))), strict=True)))


def answer(questions: DataFrame, cube: Cube, name: str) -> DataFrame:
    """``questions`` with answer, answerable and data_availability.

    Years are ints; a question whose slots name no known country, region, indicator or year is answered as one without data.
    """
    template = TEMPLATES[name]
    return solved(bind(questions, cube, template), template).select(*questions.columns, *RESULT)
