"""Edges from the most recent producer of a value, found while the calls arrive: a stateful as-of join within each trace."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import provenance

_OUT = "graph_id string, src string, dst string, label string"
#: Values of one element of a state's list.
BLOCK = 50_000


class Latest(StatefulProcessor):
    """State of a shard of traces: for every trace and value the calls that produced it.  A trace has as many as its call budget allows.

    A call of the state store costs milliseconds in PySpark, so a shard's traces are one list, read once a batch; a batch appends what it produced.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.made = handle.getListState("made", "data binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N803
        known: dict[tuple[str, str], set[tuple[int, str]]] = {}
        for block in self.made.get():
            for graph, value, order, call in pickle.loads(block[0]):
                known.setdefault((graph, value), set()).add((order, call))
        new, uses = [], {}
        # all that this batch produces is known before its calls ask: a call asks for what was made before it, not for what came before it
        for _, graph, call, order, arg, value in rows:
            if arg is not None:
                uses[graph, call, order, arg, value] = None
            elif (order, call) not in known.setdefault((graph, value), set()):
                known[graph, value].add((order, call))
                new.append((graph, value, order, call))
        seen = set()
        for graph, call, order, arg, value in uses:
            latest = max((m for m in known.get((graph, value), ()) if m[0] < order and m[1] != call), default=None)
            if latest:
                edge = (graph, latest[1], call, f"{arg}={value}")
                if edge not in seen:
                    seen.add(edge)
                    yield Row(graph_id=graph, src=edge[1], dst=call, label=edge[3])
        if new:
            self.made.appendList([(pickle.dumps(new[i : i + BLOCK], pickle.HIGHEST_PROTOCOL),) for i in range(0, len(new), BLOCK)])

    def close(self) -> None:
        pass


def producer_edges(calls: DataFrame, shards: int = 192) -> DataFrame:
    """(graph_id, src, dst, label) for a stream of answered calls(graph_id, call_id, call_order, name, arguments, result).

    Each argument's value meets its most recent earlier producer, as in ``provenance.producer_edges`` with ``causal``, provided that a trace's
    calls come in order, in any cut into batches; of a call that comes late, what it produces is known to the calls after its coming only.
    The state is kept by ``shards`` of traces, whose number must stay the same on one checkpoint.
    The session's state store is set to RocksDB, which must stay so when the query is started.
    """
    calls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    uses = provenance.arguments(calls).select("graph_id", "call_id", "call_order", "arg", "value")
    made = provenance.made_values(calls).select("graph_id", F.col("src").alias("call_id"), F.col("made").alias("call_order"), F.lit(None).cast("string").alias("arg"), "value")
    rows = uses.unionByName(made).where("value IS NOT NULL AND graph_id IS NOT NULL").select(F.col("graph_id").cast("string").alias("graph_id"), F.col("call_id").cast("string").alias("call_id"), F.col("call_order").cast("long").alias("call_order"), "arg", "value")
    rows = rows.select(F.pmod(F.xxhash64("graph_id"), F.lit(shards)).alias("shard"), *rows.columns)
    module = sys.modules[__name__]
    cloudpickle.register_pickle_by_value(module)
    try:
        return rows.groupBy("shard").transformWithState(Latest(), _OUT, "Append", "None")
    finally:
        cloudpickle.unregister_pickle_by_value(module)
