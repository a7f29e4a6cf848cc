"""Provenance graphs of tool traces as two tables, nodes and edges, for all traces at once.

``calls(graph_id, call_id, call_order, name, arguments, result)`` are answered calls; results are texts, lists and objects as JSON.
``slots(graph_id, slot, value)`` are a question's slot values.  All edges come from equality joins within a graph,
but for the near-equal numbers, which meet by rounded logarithm first.  An edge of a pair of nodes is kept once; the last written label wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical, list_literal, plain_words, split_label
from . import graphs

ROOT, ERROR, WARNING = "__question__", "__error__", "__warning__"
FINE, COARSE = 1e-8, 1e-4


def nodes(calls: DataFrame, questions: DataFrame, slots: DataFrame | None = None) -> DataFrame:
    """A root for each of ``questions(graph_id, question)``, a node for each call, and the sinks that calls reach.

    ``args`` are a call's arguments, and the root's the slot values as slot_<name>; ``result`` is a call's result.
    """
    no_map, no_text = F.lit(None).cast("map<string,string>"), F.lit(None).cast("string")
    if slots is not None:
        named = slots.groupBy("graph_id", F.concat(F.lit("slot_"), "slot").alias("k")).agg(F.min("value").alias("v"))
        questions = questions.join(named.groupBy("graph_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("_slots")), "graph_id", "left")
    root = questions.select("graph_id", F.lit(ROOT).alias("node_id"), F.col("question").alias("label"), F.lit("question").alias("type"), F.lit(0).cast("long").alias("call_order"), no_text.alias("result"), (no_map if slots is None else F.col("_slots")).alias("args"))
    call = calls.select("graph_id", F.col("call_id").alias("node_id"), F.col("name").alias("label"), F.lit("call").alias("type"), F.col("call_order").cast("long"), "result", F.col("arguments").alias("args"))
    sink = _sinks(calls).select("graph_id", "dst").distinct().select("graph_id", F.col("dst").alias("node_id"), F.col("dst").alias("label"), F.lit("sink").alias("type"), F.lit(None).cast("long").alias("call_order"), no_text.alias("result"), no_map.alias("args"))
    return root.unionByName(call).unionByName(sink)


def _sinks(calls: DataFrame) -> DataFrame:
    to = F.when(F.startswith("result", F.lit("Error:")), ERROR).when(F.startswith("result", F.lit("Warning:")), WARNING)
    return calls.select("graph_id", F.col("call_id").alias("src"), to.alias("dst"), F.lit("").alias("label")).where("dst IS NOT NULL")


def arguments(calls: DataFrame) -> DataFrame:
    """(graph_id, call_id, name, arg, item, value): every argument, lists taken apart, numbers in canonical form."""
    a = calls.select("graph_id", "call_id", "call_order", "name", F.explode("arguments").alias("arg", "raw"))
    items = F.coalesce(F.when(F.startswith("raw", F.lit("[")), list_literal(F.col("raw"))), F.array("raw"))
    return a.select("graph_id", "call_id", "call_order", "name", "arg", "raw", F.posexplode(items).alias("item", "v")).withColumn("value", canonical(F.col("v"))).drop("v")


def producers(calls: DataFrame) -> DataFrame:
    """(graph_id, src, made, value): the values that calls produce, lists and objects taken apart, each once."""
    return made_values(calls).distinct()


def made_values(calls: DataFrame) -> DataFrame:
    """The rows of ``producers``, where a call may make a value more than once; row by row, so it is for streams too."""
    ok = calls.where("name <> 'final_answer' AND result IS NOT NULL AND NOT startswith(result, 'Error:') AND NOT startswith(result, 'Warning:')")
    objects = F.from_json("result", "array<map<string,string>>")
    parts = F.coalesce(
        F.when(F.startswith("result", F.lit("[{")), F.flatten(F.transform(objects, lambda o: F.map_values(o)))),
        F.when(F.startswith("result", F.lit("[")), list_literal(F.col("result"))),
        F.array("result"),
    )
    return ok.select("graph_id", F.col("call_id").alias("src"), F.col("call_order").alias("made"), F.explode(parts).alias("v")).where("v IS NOT NULL").select("graph_id", "src", "made", canonical(F.col("v")).alias("value"))


def origin_edges(args: DataFrame, slots: DataFrame) -> DataFrame:
    """From the question, where an argument is a slot's value (its own slot, or the names and years that slots stand for)."""
    s = slots.select("graph_id", F.col("slot"), canonical(F.col("value")).alias("value"))
    got = args.join(s, ["graph_id", "value"])
    fits = (F.col("slot") == F.col("arg")) | F.col("slot").isin("property_original", "property") | F.startswith("slot", F.lit("subject")) | F.startswith("slot", F.lit("region")) | (F.startswith("slot", F.lit("year")) & (F.col("arg") == "year"))
    return got.where(fits).select("graph_id", F.lit(ROOT).alias("src"), F.col("call_id").alias("dst"), F.concat("arg", F.lit("="), "value").alias("label")).distinct()


def producer_edges(args: DataFrame, made: DataFrame, causal: bool = False) -> DataFrame:
    """From the most recent producer of an argument's value; ``causal`` looks at earlier calls only."""
    j = args.join(made, ["graph_id", "value"]).where("src <> call_id")
    j = j.where("made < call_order") if causal else j
    latest = Window.partitionBy("graph_id", "call_id", "arg", "item").orderBy(F.desc("made"), F.desc("src"))
    j = j.withColumn("k", F.row_number().over(latest)).where("k = 1")
    return j.select("graph_id", "src", F.col("call_id").alias("dst"), F.concat("arg", F.lit("="), "value").alias("label")).distinct()


def _band(x: Column, width: float) -> Column:
    """Buckets of near values: the rounded logarithm, and the next, so that near values share one."""
    b = F.floor(F.log(F.abs(x) + 1e-12) / F.lit(width)).cast("long")
    return F.array(b, b + 1)


def fuzzy_edges(args: DataFrame, made: DataFrame) -> DataFrame:
    """From producers of a number that is not equal but within 1e-8."""
    a = args.withColumn("x", F.col("value").try_cast("double")).where("x IS NOT NULL")
    m = made.withColumn("y", F.col("value").try_cast("double")).where("y IS NOT NULL").drop("value")
    # beyond this, doubles that differ do so by more
    a, m = a.where("abs(x) < 1e8"), m.where("abs(y) < 1e8")
    # numbers that close share a millionth of a unit or its neighbour
    near = lambda x: F.array(F.floor(x * 1e6).cast("long"), F.floor(x * 1e6).cast("long") + 1)
    j = a.withColumn("b", F.explode(near(F.col("x")))).join(m.withColumn("b", F.explode(near(F.col("y")))), ["graph_id", "b"])
    j = j.where((F.abs(F.col("x") - F.col("y")) > 0) & (F.abs(F.col("x") - F.col("y")) < FINE) & (F.col("src") != F.col("call_id")))
    return j.select("graph_id", "src", F.col("call_id").alias("dst"), F.concat("arg", F.lit("≈"), "value").alias("label")).distinct()


def result_edges(made: DataFrame) -> DataFrame:
    """Both ways between calls whose single number results differ by less than a ten-thousandth of the larger."""
    m = made.withColumn("x", F.col("value").try_cast("double")).where("x <> 0 AND abs(x) < double('Infinity')")
    a = m.select("graph_id", "src", "x", F.explode(_band(F.col("x"), 2e-4)).alias("b"))
    b = m.select("graph_id", F.col("src").alias("dst"), F.col("x").alias("y"), F.explode(_band(F.col("x"), 2e-4)).alias("b"))
    gap = F.abs(F.col("x") - F.col("y"))
    j = a.join(b, ["graph_id", "b"]).where((F.col("src") != F.col("dst")) & (gap > 0) & (gap < COARSE * F.greatest(F.abs("x"), F.abs("y"))))
    return j.select("graph_id", "src", "dst", F.lit("result≈result").alias("label")).distinct()


def keyword_edges(args: DataFrame, questions: DataFrame) -> DataFrame:
    """From the question to searches whose keywords share a word with it."""
    k = args.where("name = 'search_for_indicator_names' AND arg = 'keywords'").join(questions, "graph_id")
    k = k.where(F.size(F.array_intersect(plain_words(F.col("value")), plain_words(F.col("question")))) > 0)
    return k.select("graph_id", F.lit(ROOT).alias("src"), F.col("call_id").alias("dst"), F.lit("keywords").alias("label")).distinct()


def search_edges(calls: DataFrame, args: DataFrame) -> DataFrame:
    """From a search to calls that use a name it found, whatever its case, or retrieve a value of a code it found."""
    found = calls.where("name = 'search_for_indicator_names'").select("graph_id", F.col("call_id").alias("src"), F.explode(F.from_json("result", "array<map<string,string>>")).alias("o"))
    found = found.select("graph_id", "src", F.lower(F.trim(F.try_element_at("o", F.lit("indicator_name")))).alias("low"), F.trim(F.try_element_at("o", F.lit("indicator_code"))).alias("code"))
    label = lambda arg: F.concat(F.lit(f"{arg}="), "raw").alias("label")
    asked = args.where("name = 'get_indicator_code_from_name' AND arg = 'indicator_name'").withColumn("low", F.lower(F.trim("raw")))
    by_name = asked.join(found, ["graph_id", "low"]).select("graph_id", "src", F.col("call_id").alias("dst"), label("indicator_name"))
    used = args.where("name = 'retrieve_value' AND arg = 'indicator_code'").withColumn("code", F.trim("raw"))
    by_code = used.join(found, ["graph_id", "code"]).select("graph_id", "src", F.col("call_id").alias("dst"), label("indicator_code"))
    return by_name.union(by_code).where("src <> dst").distinct()


def edges(calls: DataFrame, questions: DataFrame, slots: DataFrame, causal: bool = False) -> DataFrame:
    """All edges, one for each (graph, src, dst): of several labels the last written wins."""
    args, made = arguments(calls), producers(calls)
    layers = [origin_edges(args, slots), producer_edges(args, made, causal), fuzzy_edges(args, made), keyword_edges(args, questions), search_edges(calls, args), _sinks(calls), result_edges(made)]
    every = reduce(DataFrame.unionByName, [x.withColumn("layer", F.lit(k)) for k, x in enumerate(layers)])
    last = every.groupBy("graph_id", "src", "dst").agg(F.max(F.struct("layer", "label")).alias("l"))
    return last.select("graph_id", "src", "dst", F.col("l.label").alias("label"))


def argument_sources(args: DataFrame, edge: DataFrame) -> DataFrame:
    """(graph_id, call_id, name, arg, source): where each argument of each call comes from; null where no edge says so."""
    known = edge.select("graph_id", F.col("dst").alias("call_id"), split_label(F.regexp_replace("label", "≈", "="))["arg"].alias("arg"), "src")
    known = known.groupBy("graph_id", "call_id", "arg").agg(F.max("src").alias("source"))
    return args.select("graph_id", "call_id", "name", "arg").distinct().join(known, ["graph_id", "call_id", "arg"], "left").select("graph_id", "call_id", "name", "arg", "source")


def unprovenanced(args: DataFrame, edge: DataFrame) -> DataFrame:
    """Arguments of calls that no edge accounts for (graph_id, call_id, name, arg)."""
    return argument_sources(args, edge).where("source IS NULL").drop("source")


def required_arguments(schemas: DataFrame) -> DataFrame:
    """(name, arg, type) of the required arguments of ``schemas(schema)``, function schemas as JSON text; the type is string where none is said."""
    kind = "struct<name: string, parameters: struct<required: array<string>, properties: map<string, struct<type: string>>>>"
    f = schemas.select(F.from_json("schema", f"function {kind}")["function"].alias("f"))
    each = f.select("f.name", F.explode("f.parameters.required").alias("arg"), F.col("f.parameters.properties").alias("p"))
    return each.select("name", "arg", F.coalesce(F.try_element_at("p", F.col("arg"))["type"], F.lit("string")).alias("type"))


def missing_arguments(calls: DataFrame, required: DataFrame) -> DataFrame:
    """(graph_id, call_id, name, arg): required arguments that a call does not give."""
    wanted = calls.select("graph_id", "call_id", "name", F.map_keys("arguments").alias("given")).join(required, "name")
    return wanted.where(~F.coalesce(F.array_contains("given", F.col("arg")), F.lit(False))).select("graph_id", "call_id", "name", "arg")


def unreachable(node: DataFrame, edge: DataFrame, target: str = "final_answer") -> DataFrame:
    """Nodes (graph_id, node_id, label) from which no path leads to a node labelled ``target``."""
    back = edge.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    reached = graphs.distances(node.where(F.col("label") == target).select("graph_id", "node_id"), back)
    return node.select("graph_id", "node_id", "label").join(reached, ["graph_id", "node_id"], "left_anti")


def levels(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(graph_id, node_id, level): the fewest steps from a node without incoming edges; null for nodes that only cycles lead to."""
    into = edge.where("src <> dst").select("graph_id", F.col("dst").alias("node_id")).distinct()
    all_nodes = node.select("graph_id", "node_id").distinct()
    roots = all_nodes.join(into, ["graph_id", "node_id"], "left_anti")
    found = graphs.distances(roots, edge).withColumnRenamed("steps", "level")
    return all_nodes.join(found, ["graph_id", "node_id"], "left")


def components(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(graph_id, node_id, component): weakly connected parts, named by their smallest node."""
    own = graphs.components(edge).withColumnRenamed("smallest", "c")
    all_nodes = node.select("graph_id", "node_id").distinct()
    return all_nodes.join(own, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.coalesce("c", "node_id").alias("component"))


def report(node: DataFrame, edge: DataFrame, args: DataFrame) -> DataFrame:
    """A row for each graph: its nodes, edges and issues (arguments of unclear origin)."""
    n = node.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("call_order", "node_id", "label"))).alias("nodes"))
    e = edge.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "label"))).alias("edges"))
    i = unprovenanced(args, edge).groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("call_id", "name", "arg"))).alias("issues"))
    return n.join(e, "graph_id", "left").join(i, "graph_id", "left")


def markdown(row) -> str:
    """One report row as text."""
    lines = [f"# Trace {row.graph_id}", "", "## Calls"]
    lines += [f"- {x.call_order if x.call_order is not None else '-'} {x.node_id}: {x.label}" for x in row.nodes]
    lines += ["", "## Origins", *(f"- {x.src} -> {x.dst}: {x.label}" for x in row.edges or [])]
    lines += ["", "## Issues", *(f"- {x.call_id} {x.name}: no origin for {x.arg}" for x in row.issues or [])]
    return "\n".join(lines) + "\n"
