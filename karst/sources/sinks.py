"""Writers: partitioned observations, split JSON lines, resumable appends, graphs and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.registry import catalogue
from ..functions.text import split_label
from . import stores
from .files import pending


def observations_parquet(observations: DataFrame, path: str) -> None:
    """One folder an indicator, so that readers prune by it; rows are gathered by indicator first, so it holds few files."""
    observations.repartition("indicator_code").write.mode("overwrite").partitionBy("indicator_code").parquet(path)


def wide_csv(wide: DataFrame, path: str) -> None:
    wide.write.mode("overwrite").option("header", True).csv(path)


def splits_jsonl(examples: DataFrame, path: str) -> None:
    """One folder a split."""
    examples.repartition("split").write.mode("overwrite").partitionBy("split").json(path)


def append_new(rows: DataFrame, path: str, key: str = "id", epoch: str | None = None) -> int:
    """Append the rows whose key the log at ``path`` lacks (a run that is taken up again) as one epoch; returns how many it has.

    Rows are computed once.  A run that names its ``epoch`` and is repeated after its commit writes nothing.
    """
    new = pending(rows, stores.read_log(rows.sparkSession, path, rows.schema), key)
    return stores.append_epoch(new, path, epoch or uuid.uuid4().hex)


def graph_tables(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges with maps and lists as JSON text."""
    flat = lambda df: df.select(*(F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in df.dtypes))
    flat(nodes).write.mode("overwrite").json(f"{path}/nodes")
    flat(edges).write.mode("overwrite").json(f"{path}/edges")


def reports_json(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)


def json_array(rows: DataFrame, path: str, key: str = "id") -> None:
    """K3: one file with one JSON array, an object a line, sorted by ``key`` (a catalogue: one task writes it, row by row)."""
    last = F.lead(F.lit(1)).over(Window.orderBy(key)).isNull()
    first = F.lag(F.lit(1)).over(Window.orderBy(key)).isNull()
    body = rows.select(F.concat(F.when(first, "[\n").otherwise(""), F.to_json(F.struct(*rows.columns)), F.when(last, "\n]").otherwise(",")).alias("value"))
    body = body.coalesce(1)
    if body.isEmpty():
        body = rows.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1)
    body.write.mode("overwrite").text(path)


def schemas_jsonl(spark: SparkSession, path: str, which: str = "all", style: str = "openai") -> None:
    """K8: the toolbox's schemas, a line each."""
    catalogue(spark, which, style).orderBy("name").select(F.col("schema").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def _escaped(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    # other control characters have no place in XML
    return F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def gexf(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """K6: a GEXF document for each graph, in a folder graph_id=...; maps and lists are written as JSON text.

    A graph is one row while it is written, as a trace is bounded by its call budget.
    """
    names = [c for c in nodes.columns if c not in ("graph_id", "node_id", "label")]
    kinds = dict(nodes.dtypes)
    shown = lambda c: F.to_json(c) if kinds[c].startswith(("map", "array", "struct")) else F.col(c)
    values = F.concat(*(F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<attvalue for="{i}" value="'), _escaped(shown(c)), F.lit('"/>'))).otherwise("") for i, c in enumerate(names)), F.lit(""))
    node = F.concat(F.lit('<node id="'), _escaped(F.col("node_id")), F.lit('" label="'), _escaped(F.col("label")), F.lit('"><attvalues>'), values, F.lit("</attvalues></node>"))
    edge = F.concat(F.lit('<edge id="'), _escaped(F.concat_ws(" > ", "src", "dst")), F.lit('" source="'), _escaped(F.col("src")), F.lit('" target="'), _escaped(F.col("dst")), F.lit('" label="'), _escaped(F.col("label")), F.lit('"/>'))
    gather = lambda df, line, out: df.select("graph_id", line.alias("v")).groupBy("graph_id").agg(F.array_join(F.sort_array(F.collect_list("v")), "\n").alias(out))
    whole = gather(nodes, node, "n").join(gather(edges, edge, "e"), "graph_id", "left")
    attributes = "".join(f'<attribute id="{i}" title="{c}" type="string"/>' for i, c in enumerate(names))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.2draft" version="1.2"><graph defaultedgetype="directed"><attributes class="node">{attributes}</attributes>\n<nodes>\n'
    document = F.concat(F.lit(head), "n", F.lit("\n</nodes>\n<edges>\n"), F.coalesce("e", F.lit("")), F.lit("\n</edges>\n</graph></gexf>"))
    whole.select("graph_id", document.alias("value")).write.mode("overwrite").partitionBy("graph_id").text(path)


def reports_yaml(nodes: DataFrame, edges: DataFrame, sources: DataFrame, path: str) -> None:
    """K7: a YAML report for each graph, in a folder graph_id=...: its calls with the origin of every argument, its edges, its issues.

    ``sources(graph_id, call_id, arg, source)`` says where arguments come from.  Texts are quoted as JSON, which YAML reads alike.
    """
    quoted = lambda c: F.when(c.isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", ""))
    given = nodes.where("type = 'call'").select("graph_id", F.col("node_id").alias("call_id"), F.explode("args").alias("arg", "value")).join(sources.select("graph_id", "call_id", "arg", "source"), ["graph_id", "call_id", "arg"], "left")
    line = F.concat(F.lit("  - {name: "), quoted(F.col("arg")), F.lit(", value: "), quoted(F.col("value")), F.lit(", source_node: "), quoted(F.col("source")), F.lit("}"))
    args = given.groupBy("graph_id", F.col("call_id").alias("node_id")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"))
    each = nodes.where("type <> 'sink'").join(args, ["graph_id", "node_id"], "left")
    title = F.when(F.col("type") == "question", F.concat(F.lit("\n  tool_name: null\n  original_question: "), quoted(F.col("label")))).otherwise(F.concat(F.lit("\n  tool_name: "), quoted(F.col("label"))))
    node = F.concat(F.lit("- id: "), quoted(F.col("node_id")), F.lit("\n  call_index: "), F.coalesce(F.col("call_order").cast("string"), F.lit("null")), title, F.when(F.col("lines").isNotNull(), F.concat(F.lit("\n  arguments:\n"), "lines")).otherwise(""), F.when(F.col("result").isNotNull(), F.concat(F.lit("\n  result: "), quoted(F.col("result")))).otherwise(""))
    gather = lambda df, order, text, out: df.groupBy("graph_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text.alias("v")))), lambda x: x["v"]), "\n").alias(out))
    part = split_label(F.col("label"))
    arg = F.when(F.col("label") == "", "null").when(part["value"].isNull(), quoted(part["arg"])).otherwise(F.concat(F.lit("{"), quoted(part["arg"]), F.lit(": "), quoted(part["value"]), F.lit("}")))
    edge = F.concat(F.lit("- {from: "), quoted(F.col("src")), F.lit(", to: "), quoted(F.col("dst")), F.lit(", arg: "), arg, F.lit("}"))
    issue = F.concat(F.lit("- "), quoted(F.concat(F.lit("Node `"), "call_id", F.lit("` arg `"), "arg", F.lit("` = `"), F.coalesce("value", F.lit("")), F.lit("` has no origin."))))
    whole = gather(each, ["call_order", "node_id"], node, "n").join(gather(edges, ["src", "dst"], edge, "e"), "graph_id", "left").join(gather(given.where("source IS NULL"), ["call_id", "arg"], issue, "i"), "graph_id", "left")
    block = lambda name, c: F.concat(F.lit(f"{name}:"), F.coalesce(F.concat(F.lit("\n"), c), F.lit(" []")), F.lit("\n"))
    document = F.concat(block("nodes", F.col("n")), block("edges", F.col("e")), block("issues", F.col("i")))
    whole.select("graph_id", document.alias("value")).write.mode("overwrite").partitionBy("graph_id").text(path)
