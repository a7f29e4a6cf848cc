"""The stop rules over a stream of calls: running totals of every conversation as keyed state (an extension: recorded runs are batches)."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def repeated_calls(calls: DataFrame, same: int = 10, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, conv, key, n): calls(conv, key, ts) that a conversation repeats ``same`` times or more within a window."""
    grouped = calls.withWatermark("ts", late).groupBy(F.window("ts", window), "conv", "key").agg(F.count("*").alias("n"))
    return grouped.where(F.col("n") >= same)


class Stops(StatefulProcessor):
    """State of a conversation: its number of calls and whether it has ended, and a map of how often each call was made.

    The map has at most ``most`` entries, as the budget ends a conversation then, and is emptied when it ends; the mark of the end stays, so that
    an end is reported once.  ``idle`` milliseconds after the last call all is dropped: by an event-time timer, or as the states' time to live where
    ``ttl`` is set, in processing time.
    """

    def __init__(self, most: int, same: int, idle: int, ttl: bool):
        self.most, self.same, self.idle, self.ttl = most, same, idle, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        live = self.idle if self.ttl else None
        self.handle = handle
        self.run = handle.getValueState("run", "total long, ended boolean", live)
        self.seen = handle.getMapState("seen", "key string", "n long", live)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N803
        total, ended = self.run.get() if self.run.exists() else (0, False)
        rows = sorted(rows, key=lambda r: r.pos)
        counts: dict[str, int] = {}
        found = None
        for r in rows:
            if ended:
                break
            name = "" if r.key is None else f"={r.key}"
            if name not in counts:
                counts[name] = self.seen.getValue((name,))[0] if self.seen.containsKey((name,)) else 0
            total += 1
            counts[name] += 1
            rule = "budget" if total >= self.most else "final_answer" if r.name == "final_answer" else "repeated" if counts[name] >= self.same else None
            if rule:
                ended, found = True, Row(conv=key[0], stopped_at=r.pos, rule=rule)
        if found:
            self.seen.clear()
        elif not ended:
            for name, n in counts.items():
                self.seen.updateValue((name,), (n,))
        self.run.update((total, ended))
        if not self.ttl:
            last = max((int(r.ts.timestamp() * 1000) for r in rows if r.ts is not None), default=0)
            due = max(last, timerValues.getCurrentWatermarkInMs()) + self.idle
            for old in list(self.handle.listTimers()):
                due = max(due, old)
                self.handle.deleteTimer(old)
            self.handle.registerTimer(due)
        if found:
            yield found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.run.clear()
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


class ShardStops(StatefulProcessor):
    """State of a shard of conversations: for each (calls, whether it has ended, how often each call was made, when it is due to be dropped).

    A call of the state store costs milliseconds in PySpark, so a shard's conversations are one value, read and written once a batch.  The rules are those
    of ``Stops``; one timer a shard stands at the earliest time that a conversation is due.
    """

    def __init__(self, most: int, same: int, idle: int):
        self.most, self.same, self.idle = most, same, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "data binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N803
        held = self._read()
        calls: dict = {}
        for _, conv, pos, call, name, ts in rows:
            calls.setdefault(conv, []).append((pos, call, name, ts))
        mark = timerValues.getCurrentWatermarkInMs()
        for conv, made in calls.items():
            total, ended, counts, due = held.get(conv, (0, False, {}, 0))
            for pos, call, name, _ in sorted(made, key=lambda c: c[0]) if not ended else ():
                text = "" if call is None else f"={call}"
                total += 1
                counts[text] = counts.get(text, 0) + 1
                rule = "budget" if total >= self.most else "final_answer" if name == "final_answer" else "repeated" if counts[text] >= self.same else None
                if rule:
                    ended, counts = True, {}
                    yield Row(conv=conv, stopped_at=pos, rule=rule)
                    break
            last = max((int(ts.timestamp() * 1000) for _, _, _, ts in made if ts is not None), default=0)
            held[conv] = (total, ended, counts, max(due, max(last, mark) + self.idle))
        self._keep(held, mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self._keep(self._read(), timerValues.getCurrentWatermarkInMs())
        yield from ()

    def close(self) -> None:
        pass

    def _read(self) -> dict:
        return pickle.loads(self.held.get()[0]) if self.held.exists() else {}

    def _keep(self, held: dict, mark: int) -> None:
        held = {conv: h for conv, h in held.items() if h[3] > mark}
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if held:
            self.held.update((pickle.dumps(held, pickle.HIGHEST_PROTOCOL),))
            self.handle.registerTimer(min(h[3] for h in held.values()))
        else:
            self.held.clear()


#: Named states need a store that can hold several.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stops(calls: DataFrame, most: int = 100, same: int = 10, late: str = "10 minutes", idle_seconds: int = 3600, processing_time: bool = False, shards: int = 192) -> DataFrame:
    """(conv, stopped_at, rule): the first rule that ends each conversation of a stream calls(conv, pos, key, name, ts).

    Within a micro-batch calls go by pos.  Rows ``late`` behind the newest event time are dropped.  A state is dropped ``idle_seconds`` after its
    last call, of event time or (``processing_time``) of the clock; a conversation that goes on after that begins anew.  By the clock a
    query never has nothing to do, so it is one without end, or is triggered once.  By event time the state is kept by ``shards`` of conversations, whose
    number must stay the same on one checkpoint; by the clock, by conversation.  The state store of the
    session is set to RocksDB, which must stay so when the query is started.
    """
    calls.sparkSession.conf.set(*_PROVIDER)
    module = sys.modules[__name__]
    # the worker that sets up the state runs beside the driver's JVM, without what was sent to the executors
    cloudpickle.register_pickle_by_value(module)
    try:
        rows = calls.select("conv", "pos", "key", "name", "ts")
        kind = {f.name: f.dataType.simpleString() for f in rows.schema}
        out = f"conv {kind['conv']}, stopped_at {kind['pos']}, rule string"
        if processing_time:
            return rows.groupBy("conv").transformWithState(Stops(most, same, idle_seconds * 1000, True), out, "Append", "ProcessingTime")
        dealt = rows.withWatermark("ts", late).select(F.pmod(F.xxhash64("conv"), F.lit(shards)).alias("shard"), "conv", "pos", "key", "name", "ts")
        return dealt.groupBy("shard").transformWithState(ShardStops(most, same, idle_seconds * 1000), out, "Append", "EventTime")
    finally:
        cloudpickle.unregister_pickle_by_value(module)
