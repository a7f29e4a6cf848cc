"""The question templates against a plain per-question loop over a small sparse cube with ties, zeros and gaps."""

from __future__ import annotations

import random

import pytest

from karst.operators.cells import Cube
from karst.plans import questions as Q
from karst.plans.actions import gold_actions
from karst.plans.templates import SKIPPED, TEMPLATES, answer

REGIONS = {"N": ["AA", "AB", "AC"], "S": ["BA", "BB"], "E": ["CA"]}
YEARS = [2003, 2004, 2005, 2006]
CODES = [c for r in REGIONS.values() for c in r]
HOME = {c: r for r, cs in REGIONS.items() for c in cs}


def values():
    rng = random.Random(5)
    out = {}
    for p in ("I1", "I2"):
        for c in CODES:
            for y in YEARS:
                if rng.random() < 0.6:
                    out[p, c, y] = float(rng.choice([0, 1, 2, 2, 3.5]))
    for c in REGIONS["S"]:
        out.pop(("I1", c, 2004), None)  # a region without any value
    return out


V = values()


@pytest.fixture(scope="module")
def cube(spark):
    geo = spark.createDataFrame([(c, f"Land {c}", HOME[c], i) for i, c in enumerate(CODES)] + [("ZZ", "Nowhere", None, 99)], "country_code string, country_name string, region string, pos int")
    rows = [(p, c, y, v) for (p, c, y), v in V.items()] + [("I1", "AA", 2099, float("nan"))]
    return Cube(geo, spark.createDataFrame(rows, "indicator_code string, country_code string, year int, value double").cache())


def rnd(x):
    return None if x is None else round(x + 1e-12, 5)


def state(*groups):
    if any(all(v is None for v in g) for g in groups):
        return "missing"
    return "partial" if any(v is None for g in groups for v in g) else "full"


def known(vs):
    return [v for v in vs if v is not None]


def expected(name, q):
    at = lambda c, y: V.get((q["property"], c, y))
    region = lambda r, y: [at(c, y) for c in REGIONS[r]]
    mean = lambda vs: rnd(sum(known(vs)) / len(known(vs)))
    best = lambda vs: max(known(vs)) if q["operator"] == "highest" else min(known(vs))
    cmp = lambda a, b: None if a is None or b is None else (a > b if q["operator"] == "higher" else b > a)
    share = lambda y: (lambda t: None if t == 0 else rnd(at(q["subject"], y) / t))(sum(known(region(q["region"], y))))
    none = (None, False, "missing")
    if name == "AverageChange":
        ys = list(range(q["year_a"], q["year_b"] + 1))
        vs = [at(q["subject"], y) for y in ys]
        steps = [rnd(b - a) for a, b in zip(vs, vs[1:]) if a is not None and b is not None]
        return (mean(steps), True, state(vs)) if steps else none
    if name == "RegionPropertyRatio":
        vs = region(q["region"], q["year"])
        if not known(vs):
            return none
        low = min(known(vs))
        return (None, True, "partial") if low == 0 else (rnd(max(known(vs)) / low), True, state(vs))
    if name == "RegionComparison":
        vs = region(q["region"], q["year"])
        return (f"Land {REGIONS[q['region']][vs.index(best(vs))]}", True, state(vs)) if known(vs) else none
    if name == "RegionComparisonResult":
        vs = region(q["region"], q["year_2"])
        then = at(REGIONS[q["region"]][vs.index(best(vs))], q["year_1"]) if known(vs) else None
        return none if then is None else (then, True, state(vs))
    if name == "RegionPropertyChange":
        ch = [None if a is None or b is None else rnd(b - a) for a, b in zip(region(q["region"], q["year_a"]), region(q["region"], q["year_b"]))]
        return ([f"Land {c}" for c, v in zip(REGIONS[q["region"]], ch) if v == best(ch)], True, state(ch)) if known(ch) else none
    if name == "TopNTotal":
        vs, n = region(q["region"], q["year"]), q["n"]
        if not known(vs):
            return none
        if len(known(vs)) < n:
            return None, True, "partial"
        top = sorted(known(vs))[-n:] if q["operator"] == "highest" else sorted(known(vs))[:n]
        return [f"Land {c}" for c, v in zip(REGIONS[q["region"]], vs) if v in top], True, state(vs)
    if name == "SubjectPropertyRank":
        vs, own = region(q["region"], q["year"]), at(q["subject"], q["year"])
        return none if own is None else (sorted(known(vs), reverse=True).index(own) + 1, True, state(vs))
    if name == "RankChange":
        a, b = region(q["region"], q["year_a"]), region(q["region"], q["year_b"])
        x, y = at(q["subject"], q["year_a"]), at(q["subject"], q["year_b"])
        if state(a, b) == "missing":
            return none
        if x is None or y is None:
            return None, False, "partial"
        place = lambda vs, o: sorted(known(vs), reverse=True).index(o) + 1
        return float(place(b, y) - place(a, x)), True, state(a, b)
    if name == "RegionProportion":
        return none if at(q["subject"], q["year"]) is None else (share(q["year"]), True, state(region(q["region"], q["year"])))
    if name == "RegionProportionChange":
        if at(q["subject"], q["year_a"]) is None or at(q["subject"], q["year_b"]) is None:
            return none
        return cmp(share(q["year_a"]), share(q["year_b"])), True, state(region(q["region"], q["year_a"]), region(q["region"], q["year_b"]))
    if name == "AveragePropertyComparison":
        own, vs = at(q["subject"], q["year"]), region(q["region"], q["year"])
        return none if own is None or not known(vs) else (cmp(own, mean(vs)), True, state(vs))
    if name == "RegionRangeComparison":
        a, b = region(q["region_a"], q["year"]), region(q["region_b"], q["year"])
        width = lambda vs: max(known(vs)) - min(known(vs))
        return none if state(a, b) == "missing" else (cmp(width(a), width(b)), True, state(a, b))
    if name == "CountryThresholdCount":
        own, vs = at(q["subject"], q["year"]), region(q["region"], q["year"])
        return none if own is None or not known(vs) else (sum(cmp(v, own) for v in known(vs)), True, state(vs))
    if name == "CountryPropertyComparison":
        a, b = at(q["subject_a"], q["year_a"]), at(q["subject_b"], q["year_b"])
        return none if a is None and b is None else (None, False, "partial") if a is None or b is None else (cmp(a, b), True, "full")
    if name == "PropertyRatioComparison":
        a, b = at(q["subject_a"], q["year"]), at(q["subject_b"], q["year"])
        return none if a is None or not b else (rnd(a / b), True, "full")
    raise KeyError(name)


CHECKED = ["AverageChange", "RegionPropertyRatio", "RegionComparison", "RegionComparisonResult", "RegionPropertyChange", "TopNTotal", "SubjectPropertyRank", "RankChange", "RegionProportion", "RegionProportionChange", "AveragePropertyComparison", "RegionRangeComparison", "CountryThresholdCount", "CountryPropertyComparison", "PropertyRatioComparison"]


@pytest.mark.parametrize("name", CHECKED)
def test_against_a_loop(spark, cube, name):
    years = spark.createDataFrame([(y,) for y in YEARS], "year int")
    rows = answer(Q.combinations(cube, name, years), cube, name).collect()
    rows = [r for r in rows if all(r[s] != "ZZ" for s in TEMPLATES[name].slots if s.startswith("subject"))]
    assert rows
    for r in rows:
        want = expected(name, r.asDict())
        got = r.answer
        assert (got, r.answerable, r.data_availability) == want or (isinstance(got, float) and got == pytest.approx(want[0], abs=1.1e-5) and (r.answerable, r.data_availability) == want[1:]), (r, want)


def test_unknown_names_are_missing_data(spark, cube):
    q = spark.createDataFrame([("q", "none", "Atlantis", 2003), ("r", "I1", "N", 1900)], "question_id string, property string, region string, year int")
    assert {(r.answer, r.answerable, r.data_availability) for r in answer(q, cube, "AverageProperty").collect()} == {(None, False, "missing")}


def test_no_questions(spark, cube):
    q = spark.createDataFrame([], "question_id string, property string, region string, year int")
    assert answer(q, cube, "TotalProperty").collect() == []


def test_traces_follow_the_answer(spark, cube):
    years = spark.createDataFrame([(2003,), (2004,)], "year int")
    names = spark.createDataFrame([("I1", "First"), ("I2", "Second")], "property string, property_original string")
    rows = gold_actions(Q.combinations(cube, "RegionProportion", years), cube, "RegionProportion", names).collect()
    for r in rows:
        kinds = [a.name for a in r.actions]
        assert kinds[:4] == ["search_for_indicator_names", "get_indicator_code_from_name", "get_country_codes_in_region", "retrieve_value"]
        assert (kinds[-2:] == ["add", "divide"]) == (V.get((r.property, r.subject, r.year)) is not None)
        if r.answerable and r.answer is not None:
            assert float(r.actions[-1].result) == r.answer


def test_examples_fill_quotas(spark, cube):
    years = spark.createDataFrame([(y,) for y in YEARS], "year int")
    got = Q.examples(cube, ["AverageProperty", "RegionComparison"], 3, years).collect()
    sizes = {}
    for r in got:
        sizes[r.question_template, r.split] = sizes.get((r.question_template, r.split), 0) + 1
        assert (r.question_template, r.split) not in SKIPPED
    assert sizes and max(sizes.values()) <= 3
    assert len({r.question_id for r in got}) == len(got)


def test_rendering(spark, cube):
    q = spark.createDataFrame([("q", "I1", "AB", "N", 2003)], "question_id string, property string, subject string, region string, year int")
    par = spark.createDataFrame([("I1", "First", ["first thing"])], "id string, name string, paraphrase array<string>")
    r = Q.render(q, "SubjectPropertyRank", cube.geo, par, wording=0).first()
    assert r.question == "What rank did Land AB have for first thing among countries in N in 2003?"
    assert r.slot_values["property_original"] == "First" and r.slot_values["subject_name"] == "Land AB"


class Trace(list):
    """Calls as (name, arguments, result) texts, made one by one."""

    def __init__(self, q):
        super().__init__()
        self.q = q
        self.name_of = {"I1": "First", "I2": "Second"}[q["property"]]

    def text(self, x):
        return None if x is None else str(x).lower() if isinstance(x, bool) else "[" + ",".join(x) + "]" if isinstance(x, tuple) else str(x)

    def say(self, name, result, **arguments):
        self.append((name, {k: self.text(v) for k, v in arguments.items()}, self.text(result)))
        return result

    def code(self, slot):
        self.say("get_country_code_from_name", self.q[slot], country_name=f"Land {self.q[slot]}")

    def prop(self):
        self.say("search_for_indicator_names", self.name_of, keywords=self.name_of)
        self.say("get_indicator_code_from_name", self.q["property"], indicator_name=self.name_of)

    def region(self, slot="region"):
        self.say("get_country_codes_in_region", tuple(f'"{c}"' for c in REGIONS[self.q[slot]]), region=self.q[slot])

    def value(self, c, y):
        return self.say("retrieve_value", V.get((self.q["property"], c, y)), country_code=c, indicator_code=self.q["property"], year=y)

    def values(self, y, slot="region"):
        return [self.value(c, y) for c in REGIONS[self.q[slot]]]

    def over(self, tool, vs):
        listed = known(vs)
        out = {"mean": lambda: rnd(sum(listed) / len(listed)), "add": lambda: rnd(sum(listed)), "maximum": lambda: max(listed), "minimum": lambda: min(listed), "sort": lambda: tuple(map(str, sorted(listed)))}[tool]()
        return self.say(tool, out, values=tuple(map(str, listed)))

    def pair(self, tool, a, b):
        out = None if a is None or b is None else rnd(a - b) if tool == "subtract" else (None if b == 0 else rnd(a / b)) if tool == "divide" else a > b
        return self.say(tool, out, value_a=a, value_b=b)

    def compare(self, a, b):
        return self.pair("greater_than", *((a, b) if self.q["operator"] == "higher" else (b, a)))

    def best(self, vs):
        return self.over("maximum" if self.q["operator"] == "highest" else "minimum", vs)

    def land(self, c):
        return self.say("get_country_name_from_code", f"Land {c}", country_code=c)

    def rank(self, vs, own):
        return self.say("rank", sorted(known(vs), reverse=True).index(own) + 1, values=tuple(map(str, known(vs))), query_value=own)


def trace(name, q):
    t = Trace(q)
    members = REGIONS.get(q.get("region"))
    if name == "PropertyOfSubject":
        t.code("subject"), t.prop(), t.value(q["subject"], q["year"])
    elif name == "SubjectPropertyChange":
        t.code("subject"), t.prop()
        a, b = (t.value(q["subject"], q[y]) for y in ("year_a", "year_b"))
        if a is not None or b is not None:
            d = t.pair("subtract", b, a)
            t.say("final_answer", d, answer=d)
    elif name == "AverageChange":
        t.code("subject"), t.prop()
        vs = [t.value(q["subject"], y) for y in range(q["year_a"], q["year_b"] + 1)]
        steps = [(b, a) for a, b in zip(vs, vs[1:]) if a is not None and b is not None]
        if steps:
            t.over("mean", [t.pair("subtract", b, a) for b, a in steps])
    elif name == "CountryPropertyComparison":
        t.code("subject_a"), t.code("subject_b"), t.prop()
        a, b = (t.value(q[f"subject_{k}"], q[f"year_{k}"]) for k in "ab")
        if a is not None and b is not None:
            t.compare(a, b)
    elif name == "PropertyRatioComparison":
        t.prop(), t.code("subject_a"), t.code("subject_b")
        a, b = (t.value(q[f"subject_{k}"], q["year"]) for k in "ab")
        if a is not None and b:
            t.pair("divide", a, b)
    elif name in ("AverageProperty", "TotalProperty", "RegionPropertyRatio", "RegionComparison", "TopNTotal"):
        t.region(), t.prop()
        vs = t.values(q["year"])
        if not known(vs):
            return t
        if name == "AverageProperty":
            t.over("mean", vs)
        elif name == "TotalProperty":
            t.over("add", vs)
        elif name == "RegionPropertyRatio":
            high, low = t.over("maximum", vs), t.over("minimum", vs)
            if low:
                t.pair("divide", high, low)
        elif name == "RegionComparison":
            t.land(members[vs.index(t.best(vs))])
        else:
            t.over("sort", vs)
            if len(known(vs)) >= q["n"]:
                top = sorted(known(vs))[-q["n"] :] if q["operator"] == "highest" else sorted(known(vs))[: q["n"]]
                for c, v in zip(members, vs):
                    if v is not None and v in top:
                        t.land(c)
    elif name == "RegionComparisonResult":
        t.region(), t.prop()
        vs = t.values(q["year_2"])
        if known(vs):
            t.value(members[vs.index(t.best(vs))], q["year_1"])
    elif name == "RegionPropertyChange":
        t.region(), t.prop()
        changes = []
        for c in members:
            a, b = t.value(c, q["year_a"]), t.value(c, q["year_b"])
            changes.append(None if a is None or b is None else t.pair("subtract", b, a))
        if known(changes):
            best = t.best(changes)
            for c, v in zip(members, changes):
                if v == best:
                    t.land(c)
    elif name == "SubjectPropertyRank":
        t.code("subject"), t.prop(), t.region()
        vs, own = t.values(q["year"]), V.get((q["property"], q["subject"], q["year"]))
        if own is not None:
            r = t.rank(vs, own)
            t.say("final_answer", r, answer=r)
    elif name == "RankChange":
        t.prop(), t.region()
        va, vb = t.values(q["year_a"]), t.values(q["year_b"])
        a, b = (V.get((q["property"], q["subject"], q[y])) for y in ("year_a", "year_b"))
        if a is not None and b is not None:
            x, y = t.rank(va, a), t.rank(vb, b)
            t.say("subtract", float(y - x), value_a=y, value_b=x)
    elif name == "RegionProportion":
        t.prop(), t.region()
        own = t.value(q["subject"], q["year"])
        if own is not None:
            t.pair("divide", own, t.over("add", t.values(q["year"])))
    elif name == "RegionProportionChange":
        t.prop(), t.region()
        a = t.value(q["subject"], q["year_a"])
        b = t.value(q["subject"], q["year_b"]) if a is not None else None
        if b is not None:
            va, vb = t.values(q["year_a"]), t.values(q["year_b"])
            sa, sb = t.over("add", va), t.over("add", vb)
            t.compare(t.pair("divide", a, sa), t.pair("divide", b, sb))
    elif name == "AveragePropertyComparison":
        t.code("subject"), t.prop()
        own = t.value(q["subject"], q["year"])
        if own is not None:
            t.region()
            vs = t.values(q["year"])
            if known(vs):
                t.compare(own, t.over("mean", vs))
    elif name in ("RegionAverageComparison", "RegionRangeComparison"):
        t.prop()
        out = []
        for slot in ("region_a", "region_b"):
            t.region(slot)
            vs = t.values(q["year"], slot)
            if not known(vs):
                return t
            out.append(t.over("mean", vs) if name == "RegionAverageComparison" else t.pair("subtract", t.over("maximum", vs), t.over("minimum", vs)))
        t.compare(*out)
    else:
        t.region(), t.code("subject"), t.prop()
        vs = t.values(q["year"])
        if known(vs):
            own = t.value(q["subject"], q["year"])
            if own is not None:
                true = [x for x in (t.compare(v, own) for v in vs) if x]
                t.say("count", len(true), values=("true",) * len(true))
    return t


@pytest.mark.parametrize("name", list(TEMPLATES))
def test_whole_traces(spark, cube, name):
    years = spark.createDataFrame([(y,) for y in YEARS], "year int")
    names = spark.createDataFrame([("I1", "First"), ("I2", "Second")], "property string, property_original string")
    rows = gold_actions(Q.combinations(cube, name, years), cube, name, names).collect()
    checked = 0
    for r in rows:
        q = r.asDict()
        if "ZZ" in q.values():
            continue
        checked += 1
        got = [(a.name, {k: v for k, v in a.arguments.items()}, a.result) for a in r.actions]
        assert got == list(trace(name, q)), (name, q)
    assert checked


def test_repeated_cells_are_their_mean(spark):
    geo = spark.createDataFrame([("AA", "Land AA", "N", 0)], "country_code string, country_name string, region string, pos int")
    twice = Cube(geo, spark.createDataFrame([("I1", "AA", 2003, 1.0), ("I1", "AA", 2003, 2.0), ("I1", "AA", 2003, None)], "indicator_code string, country_code string, year int, value double"))
    q = spark.createDataFrame([("q", "I1", "N", 2003)], "question_id string, property string, region string, year int")
    assert answer(q, twice, "AverageProperty").first().answer == 1.5
    q = spark.createDataFrame([("q", "I1", "AA", 2003)], "question_id string, property string, subject string, year int")
    assert answer(q, twice, "PropertyOfSubject").first().answer == 1.5
