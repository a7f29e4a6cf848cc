"""Lookups, files, matching, scoring, provenance and the stream, on small tables with the odd cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from karst import model
from karst.operators import lookup, matcher, provenance, scoring
from karst.session import ensure_checkpoint_dir
from karst.sources import files, sinks
from karst.streaming import stops


@pytest.fixture(scope="module")
def geo(spark):
    return spark.createDataFrame([("AAA", "Aland", "N", 0), ("BBB", "Boland", "N", 1), ("ATA", "Ice", None, 2)], model.GEO)


def test_lookups(spark, geo):
    ind = spark.createDataFrame([("I1", "Cold (dry) widget", "d1"), ("I2", "hot gear", "d2")], model.INDICATORS)
    names = spark.createDataFrame([(1, "Aland"), (2, "aland"), (3, None)], "k int, country_name string")
    assert [(r.k, r.country_code, r.status) for r in lookup.country_code(names, geo).orderBy("k").collect()] == [(1, "AAA", "ok"), (2, None, "invalid_country_name"), (3, None, "invalid_country_name")]
    members = spark.createDataFrame([("N",), ("X",)], "region string")
    assert {r.region: r.country_codes for r in lookup.region_members(members, geo).collect()} == {"N": ["AAA", "BBB"], "X": None}
    code = lookup.indicator_code(spark.createDataFrame([(" hot gear ",)], "indicator_name string"), ind).first()
    assert (code.indicator_code, code.status) == ("I2", "ok")
    asks = spark.createDataFrame([(1, "dry, widget"), (2, "hot gear"), (3, "['GEAR', 'none']"), (4, "cold")], "query_id int, keywords string")
    got = [(r.query_id, r.keyword, r.indicator_code) for r in lookup.search_names(asks, ind).orderBy("query_id", "keyword_no").collect()]
    assert got == [(1, "dry", "I1"), (1, "widget", "I1"), (2, "hot gear", "I2"), (3, "GEAR", "I2"), (4, "cold", "I1")]
    obs = spark.createDataFrame([("I1", "AAA", 2003, 1.234567), ("I1", "BBB", 2003, float("nan"))], model.OBSERVATIONS)
    asked = spark.createDataFrame([("AAA", "I1", 2003), ("BBB", "I1", 2003), ("ZZZ", "I1", 2003), ("AAA", "I9", 2003)], "country_code string, indicator_code string, year int")
    assert {(r.country_code, r.indicator_code): (r.value, r.status) for r in lookup.retrieve_value(asked, geo, obs).collect()} == {("AAA", "I1"): (1.23457, "ok"), ("BBB", "I1"): (None, "no_data"), ("ZZZ", "I1"): (None, "invalid_country"), ("AAA", "I9"): (None, "invalid_indicator")}


def test_files(spark, tmp_path):
    (tmp_path / "indicators").mkdir()
    (tmp_path / "indicators" / "A.B.csv").write_text("country_code,2003,2004\nAAA,1.5,\nBBB,,2\n")
    (tmp_path / "indicators" / "C.csv").write_text("country_code,2018\nAAA,-7.25\n")
    long = files.wide_csv(spark, str(tmp_path / "indicators"))
    assert {(r.indicator_code, r.country_code, r.year): r.value for r in long.collect()} == {("A.B", "AAA", 2003): 1.5, ("A.B", "AAA", 2004): None, ("A.B", "BBB", 2003): None, ("A.B", "BBB", 2004): 2.0, ("C", "AAA", 2018): -7.25}
    wide = files.pivot_wide(long, [2003, 2004, 2018])
    assert files.unpivot_long(wide, ["indicator_code", "country_code"]).count() == 3
    (tmp_path / "geo.csv").write_text('country_name,country_code,region\n"Åland, Isle",ALA,N\nIce,ATA,\n')
    assert [(r.country_name, r.region, r.pos) for r in files.geo_csv(spark, str(tmp_path / "geo.csv")).orderBy("pos").collect()] == [("Åland, Isle", "N", 0), ("Ice", None, 1)]
    (tmp_path / "p.json").write_text(json.dumps([{"id": "I", "name": "n", "description": "d", "paraphrase": ["a", "b"]}]))
    assert files.paraphrases_json(spark, str(tmp_path / "p.json")).first().paraphrase == ["a", "b"]
    (tmp_path / "g.xml").write_text('<gexf><edges><edge source="a" target="b" label="x"/></edges></gexf>')
    assert files.graph_xml(spark, str(tmp_path / "g.xml")).first()._source == "a"
    sinks.observations_parquet(long, str(tmp_path / "obs"))
    assert spark.read.parquet(str(tmp_path / "obs")).where("indicator_code = 'C'").count() == 1
    rows = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, split string")
    assert sinks.append_new(rows.limit(1), str(tmp_path / "runs")) == 1
    assert sinks.append_new(rows, str(tmp_path / "runs")) == 1
    assert sinks.append_new(rows, str(tmp_path / "runs")) == 0
    sinks.splits_jsonl(rows, str(tmp_path / "splits"))
    assert (tmp_path / "splits" / "split=x").is_dir()
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {r.k: r.v for r in files.upsert(old, spark.createDataFrame([(2, None), (3, "c")], "k int, v string"), "k").collect()} == {1: "a", 2: None, 3: "c"}
    pages = spark.createDataFrame([(1, '<a href="/indicator/X?view=1">x</a><a href="/a/b/c">y</a>')], "page_id int, html string")
    assert [r.link for r in files.links(pages, "/indicator/").collect()] == ["/indicator/X"]


MATCHES = [
    ("float", "3.14", "3.14", True), ("float", "the value is 3.14.", "3.14", True), ("float", "3.1403", "3.14", True), ("float", "3.15", "3.14", False), ("float", "1,234.5 units", "1234.5", True), ("float", "0", "0", True), ("float", "x", "5", False),
    ("bool", "Yes", "true", True), ("bool", "no", "true", False), ("bool", "whatever", "true", True), ("int", "4.9", "4", True), ("int", "rank 7", "7", True), ("int", "x", "7", False),
    ("str", " ALAND ", "Aland", True), ("str", "It is Aland", "Aland", True), ("str", "AAA", "Aland", True), ("str", "Boland", "Aland", False),
    ("list[str]", "['AAA', 'Boland']", "['Boland', 'Aland']", True), ("list[str]", "aland, boland", "['Aland', 'Boland']", True), ("list[str]", "aland", "['Aland', 'Boland']", False), ("list[str]", "aland", None, False),
    (None, "5.0", "5", True), (None, None, "zzz", False),
]


def test_matching(spark, geo):
    rows = spark.createDataFrame([(i, *m) for i, m in enumerate(MATCHES)], "id int, answer_format string, pred string, gold string, want boolean")
    for r in matcher.match(rows, geo).collect():
        assert r.correct == r.want, r
        assert (r.error == 0.0) or not r.correct or r.answer_format in ("float", "int", None)


def test_scoring(spark):
    call = lambda i, n, **a: (i, n, {k: str(v) for k, v in a.items()})
    schema = "row_id int, name string, arguments map<string,string>"
    gold = spark.createDataFrame([call(1, "add", values="[1, 2]"), call(1, "add", values="[1, 2]"), call(2, "retrieve_value", indicator_code="I1")], schema)
    pred = spark.createDataFrame([call(1, "add", values="['2', 1.0]"), call(1, "rank", query_value=3), call(3, "add", values="[]")], schema)
    scores = {r.row_id: r for r in scoring.precision_recall(scoring.compare(pred, gold)).collect()}
    assert (scores[1].precision, scores[1].coverage) == (0.5, 0.5)
    assert (scores[2].precision, scores[2].coverage) == (0.0, 0.0)
    assert (scores[3].precision, scores[3].coverage) == (0.0, 1.0)
    for r in scoring.compare(pred, gold).collect():
        assert min(r.true_positives, r.false_positives, r.false_negatives) == 0
    slots = spark.createDataFrame([(2, "I2")], "row_id int, property string")
    assert scoring.wrong_indicator(gold, slots).first().wrong_indicator


def test_predicted_calls(spark):
    def message(role, content=None, call_id=None, calls=None):
        return role, content, call_id, calls

    calls = [("c1", "function", ("less_than", {"value_a": "1", "value_b": "2"})), ("c2", "function", ("think", {"thought": "x"})), ("c3", "function", ("final_answer", {"answer": "9"}))]
    messages = [message("user", "q"), message("assistant", None, None, calls), message("tool", "Error: no", "c1"), message("assistant", None, None, [("c4", "function", ("final_answer", {"answer": "10"}))])]
    runs = spark.createDataFrame([("r", {"property_original": "P"}, messages)], f"id string, slot_values map<string,string>, messages array<{model.MESSAGE}>")
    got = scoring.predicted_calls(runs).collect()
    assert [(r.name, r.arguments, r.result) for r in got] == [("greater_than", {"value_a": "2", "value_b": "1"}, "Error: no")]
    assert runs.select(matcher.final_answer(F.col("messages")).alias("a")).first().a == "9"
    assert runs.select(scoring.error_made(F.col("messages")).alias("e")).first().e


def test_stop_rules(spark):
    rows = [("a", i, "k", "add") for i in range(12)] + [("b", 0, "x", "add"), ("b", 1, "y", "final_answer"), ("c", 0, "z", "add")]
    got = {r.conv: (r.stopped_at, r.rule) for r in scoring.stop_rules(spark.createDataFrame(rows, "conv string, pos int, key string, name string")).collect()}
    assert got == {"a": (9, "repeated"), "b": (1, "final_answer")}


def test_provenance(spark):
    schema = "graph_id string, call_id string, call_order long, name string, arguments map<string,string>, result string"
    calls = spark.createDataFrame([
        ("g", "c1", 1, "get_country_code_from_name", {"country_name": "Aland"}, "AAA"),
        ("g", "c2", 2, "retrieve_value", {"country_code": "AAA", "year": "2003", "indicator_code": "I9"}, "2.0"),
        ("g", "c3", 3, "add", {"values": "[2, 5]"}, "7.0"),
        ("g", "c4", 4, "subtract", {"value_a": "7", "value_b": "1"}, "Error: no"),
        ("g", "c5", 5, "final_answer", {"answer": "7"}, "7"),
    ], schema)
    questions = spark.createDataFrame([("g", "What of Aland in 2003?")], "graph_id string, question string")
    slots = spark.createDataFrame([("g", "subject_name", "Aland"), ("g", "year", "2003"), ("g", "subject", "AAA")], "graph_id string, slot string, value string")
    edge = provenance.edges(calls, questions, slots)
    pairs = {(r.src, r.dst) for r in edge.collect()}
    assert {("__question__", "c1"), ("c1", "c2"), ("__question__", "c2"), ("c2", "c3"), ("c3", "c4"), ("c3", "c5"), ("c4", "__error__")} <= pairs
    args = provenance.arguments(calls)
    lost = {(r.call_id, r.arg) for r in provenance.unprovenanced(args, edge).collect()}
    assert ("c2", "indicator_code") in lost and ("c4", "value_b") in lost and ("c5", "answer") not in lost
    node = provenance.nodes(calls, questions)
    assert {r.node_id for r in provenance.unreachable(node, edge).collect()} == {"c4", "__error__"}
    assert provenance.components(node, edge).select("component").distinct().count() == 1
    ensure_checkpoint_dir(spark)
    level = {r.node_id: r.level for r in provenance.levels(node, edge).collect()}
    assert (level["__question__"], level["c1"], level["c3"], level["__error__"]) == (0, 1, 2, 4)
    row = provenance.report(node, edge, args).first()
    assert "no origin for indicator_code" in provenance.markdown(row)


def test_stream_of_repeated_calls(spark, tmp_path):
    rows = spark.sql("SELECT 'a' AS conv, 'k' AS key, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) AS ts FROM range(12) UNION ALL SELECT 'b', 'k', timestamp'2024-01-01 00:00:00'")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stops.repeated_calls(stream).writeStream.outputMode("complete").format("memory").queryName("repeats").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.conv, r.n) for r in spark.table("repeats").collect()] == [("a", 12)]
