"""Graph walks to their end, tool calls by name, files of graphs and reports, and the stop rules over a stream."""

from __future__ import annotations

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from karst import model
from karst.functions import registry
from karst.functions import text as X
from karst.operators import dispatch, graphs, lookup, matcher, provenance, rows, scoring
from karst.operators.cells import Cube
from karst.plans import fewshot
from karst.sources import files, sinks
from karst.streaming import stops

NODE, EDGE = "graph_id string, node_id string, label string", "graph_id string, src string, dst string, label string"


@pytest.mark.parametrize("n", [40, 100, 2000])
def test_long_chains(spark, n):
    ids = [f"{i:05d}" for i in range(n)]
    random.Random(n).shuffle(ids)
    node = spark.createDataFrame([("g", i, "x") for i in ids] + [("h", "lone", "x")], NODE)
    edge = spark.createDataFrame([("g", a, b, "") for a, b in zip(ids, ids[1:], strict=False)], EDGE)
    assert {tuple(r) for r in provenance.components(node, edge).select("graph_id", "component").distinct().collect()} == {("g", "00000"), ("h", "lone")}
    level = {r.node_id: r.level for r in provenance.levels(node, edge).collect()}
    assert level == {i: k for k, i in enumerate(ids)} | {"lone": 0}


def test_many_paths(spark):
    """2**24 paths, 50 nodes: nodes are walked, not paths."""
    edge = [("g", f"{x}{i}", f"{y}{i + 1}", "") for i in range(24) for x in "ab" for y in "ab"] + [("g", "a24", "f", "")]
    node = [("g", f"{x}{i}", "x") for i in range(25) for x in "ab"] + [("g", "f", "final_answer"), ("h", "z", "x")]
    gone = provenance.unreachable(spark.createDataFrame(node, NODE), spark.createDataFrame(edge, EDGE)).collect()
    assert {(r.graph_id, r.node_id) for r in gone} == {("g", "b24"), ("h", "z")}
    starts = spark.createDataFrame([("g", "a0")], "graph_id string, node_id string")
    edges = spark.createDataFrame(edge, EDGE)
    whole, by_rounds = ({tuple(r) for r in graphs.distances(starts, edges, gather=k).collect()} for k in (1000, 5))
    assert whole == by_rounds and len(whole) == 50


def test_cycles_and_no_edges(spark):
    node = spark.createDataFrame([("g", c, "x") for c in "abc"], NODE)
    edge = spark.createDataFrame([("g", "a", "b", ""), ("g", "b", "a", ""), ("g", "c", "c", "")], EDGE)
    assert {r.node_id: r.level for r in provenance.levels(node, edge).collect()} == {"a": None, "b": None, "c": 0}
    none = spark.createDataFrame([], EDGE)
    assert {r.component for r in provenance.components(node, none).collect()} == {"a", "b", "c"}
    assert provenance.unreachable(node, none).count() == 3


def test_large_numbers(spark):
    args = spark.createDataFrame([("g", "c2", "x", "25462700000000.0"), ("g", "c2", "x", "1.000000004"), ("g", "c2", "x", "NaN"), ("g", "c2", "x", "1e400")], "graph_id string, call_id string, arg string, value string")
    made = spark.createDataFrame([("g", "c1", "25462700000000.5"), ("g", "c1", "1.0"), ("g", "c1", "Infinity")], "graph_id string, src string, value string")
    assert [r.label for r in provenance.fuzzy_edges(args, made).collect()] == ["x≈1.000000004"]
    both = spark.createDataFrame([("g", "c1", "25462700000000.5"), ("g", "c2", "25462700000000.9"), ("g", "c3", "NaN"), ("g", "c4", "Infinity")], "graph_id string, src string, value string")
    assert {(r.src, r.dst) for r in provenance.result_edges(both).collect()} == {("c1", "c2"), ("c2", "c1")}
    geo = spark.createDataFrame([("AAA", "Aland", "N", 0)], model.GEO)
    asked = spark.createDataFrame([(1, "int", "1e30", "5"), (2, None, "1e30", "5"), (3, "int", "5", "1e30"), (4, "int", "9e18", "-9e18")], "id int, answer_format string, pred string, gold string")
    got = {r.id: (r.correct, r.error) for r in matcher.match(asked, geo).collect()}
    assert got[1] == (False, 1e30 - 5) and not got[3][0] and got[4] == (False, 1.8e19)
    assert got[2][0]  # the fallback takes any text that is not false for true


def test_literals(spark):
    texts = {"[1.0, None, 2.0]": ["1.0", None, "2.0"], "(1, 'it\\'s', \"a'b\")": ["1", "it's", "a'b"], "[True, 'x \"y\"',]": ["true", 'x "y"'], "(1)": None, "17": None, "": None, "['None', \"True\"]": ["None", "True"]}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.v for r in df.select("t", X.list_literal(F.col("t")).alias("v")).collect()} == texts
    doc = "Add.\n\nArgs:\n    values: The numbers,\n        all of them.\n    other: More.\n\nReturns:\n    x: y"
    got = spark.createDataFrame([(doc,), ("none",), (None,)], "d string").select(X.docstring_arguments(F.col("d")).alias("a")).collect()
    assert got[0].a == {"values": "The numbers,         all of them.", "other": "More."} and got[1].a == {} and not got[2].a
    one = spark.createDataFrame([("a=b=c", {"arg_x": "1", "y": "2"}), ("keywords", {})], "l string, m map<string,string>")
    assert [tuple(r.p) for r in one.select(X.split_label(F.col("l")).alias("p")).collect()] == [("a", "b=c"), ("keywords", None)]
    assert [r.m for r in one.select(X.without_prefix(F.col("m"), "arg_").alias("m")).collect()] == [{"x": "1"}, {}]


@pytest.fixture(scope="module")
def world(spark):
    geo = spark.createDataFrame([("AAA", "Aland", "N", 0), ("BBB", "Boland", "N", 1), ("CCC", "Aland", "S", 2)], model.GEO)
    obs = spark.createDataFrame([("I1", "AAA", 2003, 1.0), ("I1", "AAA", 2003, 2.0), ("I1", "BBB", 2003, None)], model.OBSERVATIONS)
    return Cube(geo, obs), spark.createDataFrame([("I1", "Hot gear", "d1"), ("I2", "Cold gear", "d2")], model.INDICATORS)


CALLS = [
    ("add", {"values": "[1, None, 2.5]"}, "3.5", "ok"), ("add", {"values": "[1, 'x']"}, None, "not_computed"), ("multiply", {"values": "[2, None]"}, None, "not_computed"),
    ("mean", {"values": "[]"}, None, "not_computed"), ("sort", {"values": "(3, 1)"}, "[1.0,3.0]", "ok"), ("divide", {"value_a": "1", "value_b": "0"}, None, "not_computed"),
    ("greater_than", {"value_a": "2", "value_b": "1"}, "true", "ok"), ("rank", {"values": "[5, 7]", "query_value": "5"}, "2", "ok"), ("index", {"values": "[5, 7]", "query_value": "9"}, None, "not_computed"),
    ("count", {"values": "['a', None, False]"}, "2", "ok"), ("get_country_code_from_name", {"country_name": "Aland"}, "AAA", "ok"), ("get_country_name_from_code", {"country_code": "ZZZ"}, None, "invalid_country"),
    ("get_indicator_code_from_name", {"indicator_name": " Hot gear "}, "I1", "ok"), ("get_indicator_name_from_code", {"indicator_code": "I2"}, "Cold gear", "ok"), ("get_country_codes_in_region", {"region": "N"}, '["AAA","BBB"]', "ok"),
    ("retrieve_value", {"country_code": "AAA", "indicator_code": "I1", "year": "2003"}, "1.5", "ok"), ("retrieve_value", {"country_code": "BBB", "indicator_code": "I1", "year": "2003"}, None, "no_data"),
    ("search_for_indicator_names", {"keywords": "gear"}, '[{"indicator_name":"Hot gear","indicator_description":"d1"},{"indicator_name":"Cold gear","indicator_description":"d2"}]', "ok"),
    ("search_for_indicator_names", {"keywords": "none"}, "[]", "ok"), ("final_answer", {"answer": "7"}, "7", "ok"), ("think", {"thought": "hm"}, "hm", "ok"), ("nothing", {"a": "1"}, None, "unknown_tool"), ("add", {}, None, "no_arguments"), (None, {"a": "1"}, None, "unknown_tool"),
]


def test_calls(spark, world):
    calls = spark.createDataFrame([(i, n, a) for i, (n, a, _, _) in enumerate(CALLS)], "call_id int, name string, arguments map<string,string>")
    got = {r.call_id: (r.result, r.status) for r in dispatch.execute(calls, *world).collect()}
    assert got == {i: c[2:] for i, c in enumerate(CALLS)}
    said = {r.call_id: r.result for r in dispatch.execute(calls, *world, errors="raise").collect()}
    assert said == {i: r if s == "ok" else lookup.MESSAGES[s] for i, (_, _, r, s) in enumerate(CALLS)}
    with pytest.raises(ValueError):
        dispatch.execute(calls, *world, errors="other")


def test_worked_examples(spark, world):
    got = {r.name: r.examples for r in fewshot.examples(*world, n=2).collect()}
    assert set(got) == set(registry.BY_NAME)
    assert all(t.count("Example of `") == 2 and t.count("Returns: ") == 2 for t in got.values())


def test_required_arguments(spark, tmp_path):
    sinks.schemas_jsonl(spark, str(tmp_path / "schemas"))
    required = provenance.required_arguments(spark.read.text(str(tmp_path / "schemas")).withColumnRenamed("value", "schema"))
    assert {(r.arg, r.type) for r in required.where("name = 'rank'").collect()} == {("values", "array"), ("query_value", "number")}
    calls = spark.createDataFrame([("g", "c", "rank", {"values": "[]"}), ("g", "d", "rank", None), ("g", "e", "unknown", {})], "graph_id string, call_id string, name string, arguments map<string,string>")
    assert {(r.call_id, r.arg) for r in provenance.missing_arguments(calls, required).collect()} == {("c", "query_value"), ("d", "query_value"), ("d", "values")}


def test_graph_files(spark, tmp_path):
    schema = "graph_id string, call_id string, call_order long, name string, arguments map<string,string>, result string"
    calls = spark.createDataFrame([("g/1", "c1", 1, "add", {"values": '["<a> & \'b\'"]', "q": "x: y"}, "7\n8"), ("g/1", "c2", 2, "final_answer", {"answer": "5"}, "Error: no")], schema)
    questions = spark.createDataFrame([("g/1", "What of x?")], "graph_id string, question string")
    slots = spark.createDataFrame([("g/1", "answer", "5")], "graph_id string, slot string, value string")
    node, edge, args = provenance.nodes(calls, questions, slots), provenance.edges(calls, questions, slots), provenance.arguments(calls)
    sinks.gexf(node, edge, str(tmp_path / "gexf"))
    nodes, edges = files.gexf(spark, str(tmp_path / "gexf"))
    back = {r.node_id: r for r in nodes.collect()}
    assert back["c1"].graph_id == "g/1" and json.loads(back["c1"].attributes["args"]) == {"values": '["<a> & \'b\'"]', "q": "x: y"} and back["c1"].attributes["result"] == "7\n8"
    assert json.loads(back["__question__"].attributes["args"]) == {"slot_answer": "5"}
    assert {(r.src, r.dst) for r in edges.collect()} == {(r.src, r.dst) for r in edge.collect()}
    yaml = pytest.importorskip("yaml")
    sinks.reports_yaml(node, edge, provenance.argument_sources(args, edge), str(tmp_path / "yaml"))
    (folder,) = [p for p in Path(tmp_path / "yaml").iterdir() if p.is_dir()]
    report = yaml.safe_load("".join(p.read_text() for p in sorted(folder.glob("part-*"))))
    calls_ = {n["id"]: n for n in report["nodes"]}
    assert calls_["__question__"]["original_question"] == "What of x?" and calls_["c1"]["result"] == "7\n8"
    assert {(a["name"], a["value"], a["source_node"]) for a in calls_["c2"]["arguments"]} == {("answer", "5", "__question__")}
    assert len(report["issues"]) == 2 and {"from": "__question__", "to": "c2", "arg": {"answer": "5.0"}} in report["edges"]


def test_json_array_and_pruned_files(spark, tmp_path):
    sinks.json_array(spark.createDataFrame([("b", [1]), ("a", None)], "id string, v array<int>"), str(tmp_path / "a"))
    text = "".join(p.read_text() for p in Path(tmp_path / "a").glob("part-*"))
    assert json.loads(text) == [{"id": "a"}, {"id": "b", "v": [1]}]
    assert files.paraphrases_json(spark, str(tmp_path / "a")).count() == 2
    sinks.json_array(spark.createDataFrame([], "id string"), str(tmp_path / "e"))
    assert json.loads("".join(p.read_text() for p in Path(tmp_path / "e").glob("part-*"))) == []
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "A.csv").write_text("country_code,2003\nAAA,1\n")
    (tmp_path / "w" / "B.csv").write_text("country_code,2004\nAAA,2\n")
    assert [r.indicator_code for r in files.wide_csv(spark, str(tmp_path / "w"), ["B"]).collect()] == ["B"]


def test_clean_and_timing(spark):
    raw = spark.createDataFrame([("b", 2, "x"), ("b", 1, "y"), ("a", 3, "z"), ("c", None, "w"), (None, 1, "v")], "k string, n int, v string")
    assert [tuple(r) for r in rows.clean(raw, ["k", "n"], ["k"], ["k", "n"]).collect()] == [("a", 3, "z"), ("b", 1, "y")]
    assert rows.first_rows(raw, None).count() == 5 and [r.v for r in rows.first_rows(raw, 2, "v").collect()] == ["v", "w"]
    t = spark.createDataFrame([("A", 1.0, 0.5, 3, None), ("B", 3.0, 1.5, 1, 2)], "template string, total_time double, time_per_attempt double, full int, part int")
    assert {r.template: (r.total_time, r.time_per_attempt, r.filled) for r in rows.timing_summary(t, ["full", "part"]).collect()} == {"A": (1.0, 0.5, 1), "B": (3.0, 1.5, 2), "Total": (4.0, 1.0, 3)}


def test_sql_functions(spark):
    assert len(registry.register_sql(spark)) == 13
    r = spark.sql("SELECT tool_sort(array(2D, NULL, 1D)) AS s, tool_index(array(NULL, 5D, 7D), 7D) AS i, tool_count(array('a', NULL)) AS c, tool_greater_than(2, 1) AS g, tool_less_than(2, 1) AS l").first()
    assert (r.s, r.i, r.c, r.g, r.l) == ([1.0, 2.0], 1, 1, True, False)


def test_message_budget(spark):
    calls = spark.createDataFrame([("a", i, "k%d" % i, "add", 3 * i) for i in range(40)], "conv string, pos int, key string, name string, messages int")
    assert [(r.stopped_at, r.rule) for r in scoring.stop_rules(calls).collect()] == [(34, "messages")]


def test_stops_of_a_stream(spark, tmp_path):
    rng = random.Random(3)
    calls = [(f"c{c}", p, f"k{rng.randrange(3 + 4 * c)}", "final_answer" if rng.random() < 0.02 else "add") for c in range(8) for p in range(60)]
    whole = spark.createDataFrame(calls, "conv string, pos long, key string, name string").withColumn("ts", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,pos)"))
    for k in range(3):  # three micro-batches
        whole.where(F.col("pos").between(20 * k, 20 * k + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stops.stops(stream, most=50, same=6).writeStream.outputMode("append").format("memory").queryName("stopped").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in scoring.stop_rules(whole, most=50, same=6).collect()}
    assert {tuple(r) for r in spark.table("stopped").collect()} == want


def test_numbers_of_any_size_as_python_writes_them(spark):
    numbers = [0.0, -0.0, 1e7, 12345678.9, -21457602.48, 123456789012345.6, 9999999999999998.0, 1e16, 1.3436424411240123e18, 0.001, 0.00012345, 1.5e-5, 1e300, float("nan"), float("-inf")]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", X.number_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == [repr(x) for x in numbers]
    geo = spark.createDataFrame([("A", "Aland", "R", 0)], "country_code string, country_name string, region string, pos int")
    cube = Cube(geo, spark.createDataFrame([("I", "A", 2003, 21457602.48)], "indicator_code string, country_code string, year int, value double"))
    asked = [("1", "retrieve_value", {"country_code": "A", "indicator_code": "I", "year": "2003"}), ("2", "add", {"values": "[10000000, 0.5]"}), ("3", "subtract", {"value_a": "-30000000", "value_b": "1"})]
    calls = spark.createDataFrame(asked, "call_id string, name string, arguments map<string,string>")
    none = spark.createDataFrame([], "id string, name string, description string")
    assert {r.call_id: r.result for r in dispatch.execute(calls, cube, none).collect()} == {"1": "21457602.48", "2": "10000000.5", "3": "-30000001.0"}
