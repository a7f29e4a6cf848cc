"""Streams with keyed state: restarts from a checkpoint, late rows, timers, and the same rows as the batch operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from karst.operators import provenance, scoring
from karst.streaming import producers, stops

CALLS = "conv string, pos long, key string, name string, ts timestamp"


class Feed:
    """A folder that a stream reads; every ``run`` starts the query anew on one checkpoint."""

    def __init__(self, spark, path, schema, build, **trigger):
        self.spark, self.path, self.schema, self.build, self.n = spark, str(path), schema, build, 0
        self.trigger = trigger or {"availableNow": True}

    def run(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.path}/in/{self.n}")
        self.n += 1
        out = self.build(self.spark.readStream.schema(self.schema).option("recursiveFileLookup", True).parquet(f"{self.path}/in"))
        q = out.writeStream.option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/state").trigger(**self.trigger).start()
        q.awaitTermination()
        return sorted(tuple(r) for r in self.spark.read.schema(out.schema).parquet(f"{self.path}/out").collect())


def at(minute):
    from datetime import datetime, timedelta

    return datetime(2024, 1, 1) + timedelta(minutes=minute)


def test_stops_go_on_after_a_restart(spark, tmp_path):
    rng = random.Random(3)
    calls = [(f"c{c}", p, rng.choice([None, "", *(f"k{k}" for k in range(3 + 4 * c))]), "final_answer" if rng.random() < 0.02 else "add", at(p)) for c in range(6) for p in range(60)]
    feed = Feed(spark, tmp_path, CALLS, lambda s: stops.stops(s, most=50, same=6, late="1 day"))
    for k in range(3):
        got = feed.run([r for r in calls if 20 * k <= r[1] < 20 * k + 20])
    assert got == sorted(tuple(r) for r in scoring.stop_rules(spark.createDataFrame(calls, CALLS), most=50, same=6).select("conv", "stopped_at", "rule").collect())
    assert len(got) >= 4


def test_late_rows_and_idle_conversations(spark, tmp_path):
    feed = Feed(spark, tmp_path, CALLS, lambda s: stops.stops(s, most=100, same=3, late="10 minutes", idle_seconds=3600))
    feed.run([("a", 0, "k", "add", at(0)), ("a", 1, "k", "add", at(1)), ("b", 0, "k", "add", at(0))])
    feed.run([("b", 1, "k", "add", at(100))])  # the watermark goes to minute 90: a's state is due at 61, b's at 160
    feed.run([("c", 0, "k", "add", at(101))])
    # late rows are dropped, so they end nothing
    assert feed.run([("b", 2, "k", "add", at(30)), ("b", 3, "k", "add", at(31))]) == []
    # a begins anew, b goes on
    assert feed.run([("a", 2, "k", "add", at(102)), ("a", 3, "k", "add", at(103)), ("b", 4, "k", "add", at(104))]) == [("b", 4, "repeated")]


def test_state_with_time_to_live(spark, tmp_path):
    feed = Feed(spark, tmp_path, CALLS, lambda s: stops.stops(s, most=100, same=2, idle_seconds=3600, processing_time=True), once=True)
    feed.run([("a", 0, "k", "add", None)])
    assert feed.run([("a", 1, "k", "add", at(0)), ("a", 2, "k", "add", at(0))]) == [("a", 1, "repeated")]


TRACE = "graph_id string, call_id string, call_order long, name string, arguments map<string,string>, result string"


@pytest.mark.parametrize("parts", [1, 4])
def test_producers_of_a_stream_equal_the_batch(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = []
    for g in range(5):
        for k in range(40):
            result = rng.choice([str(rng.randrange(6)), f"{rng.randrange(6)}.0", f"[{rng.randrange(6)}, 'x{rng.randrange(3)}']", f'[{{"a": "{rng.randrange(6)}"}}]', "Error: no", None])
            arguments = rng.choice([None, {}, {"v": str(rng.randrange(6))}, {"v": f"[{rng.randrange(6)}, {rng.randrange(6)}.0]", "w": f"x{rng.randrange(3)}"}, {"v": None}])
            rows.append((f"g{g}", f"{g}-{k:02}", k, rng.choice(["add", "final_answer", "rank"]), arguments, result))
    feed = Feed(spark, tmp_path, TRACE, producers.producer_edges)
    for p in range(parts):
        got = feed.run([r for r in rows if r[2] * parts // 40 == p])
    calls = spark.createDataFrame(rows, TRACE)
    want = provenance.producer_edges(provenance.arguments(calls), provenance.producers(calls), causal=True).select("graph_id", "src", "dst", "label")
    assert got == sorted(tuple(r) for r in want.distinct().collect()) and len(got) > 50


def _state_rows(spark, tmp_path, schema, rows, build):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = build(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"])


def test_stops_keep_a_state_for_a_shard_not_for_every_conversation(spark, tmp_path):
    calls = [(f"c{c}", p, f"k{p}", "add", at(p)) for c in range(1000) for p in range(2)]
    assert _state_rows(spark, tmp_path, CALLS, calls, lambda s: stops.stops(s, most=50, same=6, late="1 day")) < 1000


def test_producers_keep_a_state_for_a_shard_not_for_every_trace(spark, tmp_path):
    calls = [(f"g{g}", f"{g}-{k}", k, "add", {"v": "1"}, str(k)) for g in range(1000) for k in range(2)]
    assert _state_rows(spark, tmp_path, TRACE, calls, producers.producer_edges) < 1000
