"""Scoring of tool-call traces: multiset comparison of predicted with gold calls, and summaries.

Calls are rows (row_id, name, arguments) with arguments a map; both sides are put in canonical form, numbered among their equals, and
joined by equality, so the comparison is one shuffle by (row_id, call).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import typed
from ..functions.text import canonical_call

CONTROL = ["think", "final_answer"]
LOOKUPS = ["search_for_indicator_names", "get_country_code_from_name", "get_country_name_from_code", "get_indicator_code_from_name", "get_indicator_name_from_code", "get_country_codes_in_region"]


def gold_calls(examples: DataFrame, tools: list[str] | None = None, keep_final: bool = False) -> DataFrame:
    """(row_id, pos, name, arguments) of ``examples(id, actions)``.

    final_answer calls are left out on both sides, so that a perfect trace scores 1; ``keep_final`` keeps the gold ones.
    """
    calls = examples.select(F.col("id").alias("row_id"), F.posexplode("actions").alias("pos", "a")).select("row_id", "pos", "a.name", "a.arguments")
    calls = calls.where(F.col("name").isin(tools)) if tools else calls
    return calls if keep_final else calls.where(~F.col("name").isin(CONTROL))


def predicted_calls(runs: DataFrame) -> DataFrame:
    """(row_id, pos, name, arguments, result) of ``runs(id, messages, slot_values)``.

    less_than is turned into greater_than; a search that found the question's own property counts as the gold search; calls
    without a result keep a null one; control calls are left out.
    """
    m = runs.select(F.col("id").alias("row_id"), F.try_element_at("slot_values", F.lit("property_original")).alias("original"), F.posexplode("messages").alias("at", "m"))
    calls = m.select("row_id", "original", "at", F.posexplode("m.tool_calls").alias("k", "c"))
    results = m.where("m.role = 'tool'").select("row_id", F.col("m.tool_call_id").alias("call_id"), F.col("m.content").alias("result"))
    calls = calls.select("row_id", "original", (F.col("at") * 1000 + F.col("k")).alias("pos"), F.col("c.id").alias("call_id"), F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("arguments"))
    calls = calls.join(results, ["row_id", "call_id"], "left")
    swapped = F.map_from_arrays(F.array(F.lit("value_a"), F.lit("value_b")), F.array(F.try_element_at("arguments", F.lit("value_b")), F.try_element_at("arguments", F.lit("value_a"))))
    less = F.col("name") == "less_than"
    hit = (F.col("name") == "search_for_indicator_names") & F.coalesce(F.contains("result", "original"), F.lit(False))
    arguments = F.when(less, swapped).when(hit, F.create_map(F.lit("keywords"), F.col("original"))).otherwise(F.col("arguments"))
    return calls.select("row_id", "pos", F.when(less, "greater_than").otherwise(F.col("name")).alias("name"), arguments.alias("arguments"), "result").where(~F.col("name").isin(CONTROL))


def _numbered(calls: DataFrame, side: str) -> DataFrame:
    """Calls counted by their canonical text; arguments are a map of texts, or a variant, whose types then count."""
    build = typed.canonical_call if dict(calls.dtypes)["arguments"] == "variant" else canonical_call
    call = calls.select("row_id", build(F.col("name"), F.col("arguments")).alias("call"))
    return call.groupBy("row_id", "call").agg(F.count("*").alias(side))


def compare(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(row_id, call, true_positives, false_positives, false_negatives): multiset intersection and differences."""
    both = _numbered(pred, "p").join(_numbered(gold, "g"), ["row_id", "call"], "full").fillna(0, ["p", "g"])
    return both.select("row_id", "call", F.least("p", "g").alias("true_positives"), F.greatest(F.col("p") - F.col("g"), F.lit(0)).alias("false_positives"), F.greatest(F.col("g") - F.col("p"), F.lit(0)).alias("false_negatives"))


def precision_recall(compared: DataFrame) -> DataFrame:
    """Per row; precision 0 without predictions, coverage 1 without gold calls."""
    s = compared.groupBy("row_id").agg(*(F.sum(c).alias(c) for c in ("true_positives", "false_positives", "false_negatives")))
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    return s.withColumns({"precision": F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), "coverage": F.coalesce(F.try_divide(tp, tp + fn), F.lit(1.0))})


def set_scores(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision, recall and Jaccard over distinct calls; 0 where a denominator is."""
    both = _numbered(pred, "p").join(_numbered(gold, "g"), ["row_id", "call"], "full").fillna(0, ["p", "g"])
    n = lambda c: F.count_if(c)
    p, g = F.col("p") > 0, F.col("g") > 0
    s = both.groupBy("row_id").agg(n(p & g).alias("both"), n(p).alias("pred"), n(g).alias("gold"), F.count("*").alias("either"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return s.select("row_id", ratio("both", "pred").alias("set_precision"), ratio("both", "gold").alias("set_recall"), ratio("both", "either").alias("set_jaccard"))


def error_made(messages: Column) -> Column:
    """P5: whether any tool result is an error (warnings are none)."""
    return F.exists(messages, lambda m: (m["role"] == "tool") & F.coalesce(F.startswith(m["content"], F.lit("Error:")), F.lit(False)))


def right_process(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(row_id, correct_process) whether every gold lookup call is among the predicted ones."""
    wanted = _numbered(gold.where(F.col("name").isin(LOOKUPS)), "g")
    have = _numbered(pred.where(F.col("name").isin(LOOKUPS)), "p")
    return wanted.join(have, ["row_id", "call"], "left").groupBy("row_id").agg((F.count_if(F.col("p").isNull()) == 0).alias("correct_process"))


def wrong_indicator(pred: DataFrame, slots: DataFrame) -> DataFrame:
    """(row_id, wrong_indicator) whether a retrieve_value asked for another indicator than ``slots(row_id, property)``."""
    used = pred.where("name = 'retrieve_value'").join(slots, "row_id")
    return used.groupBy("row_id").agg((F.count_if(~F.col("property").eqNullSafe(F.try_element_at("arguments", F.lit("indicator_code")))) > 0).alias("wrong_indicator"))


def summary(rows: DataFrame, by: str = "run") -> DataFrame:
    """Per run: how many, mean correct, mean and sample deviation of precision and coverage, error rate."""
    one = lambda c: F.avg(F.col(c).cast("double"))
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), one("correct").alias("accuracy"),
        F.avg("precision").alias("precision_mean"), F.stddev_samp("precision").alias("precision_std"),
        F.avg("coverage").alias("coverage_mean"), F.stddev_samp("coverage").alias("coverage_std"), one("error_made").alias("error_rate"),
    )


def conditional(event: Column, given: Column) -> Column:
    """P(event | given) as an aggregate; the denominator is at least 1."""
    return F.count_if(event & given) / F.greatest(F.count_if(given), F.lit(1))


def crosstab(rows: DataFrame, down: str, across: str, values: list) -> DataFrame:
    return rows.groupBy(down).pivot(across, values).agg(F.count(F.lit(1))).fillna(0)


def stop_rules(calls: DataFrame, most: int = 100, same: int = 10, most_messages: int = 100) -> DataFrame:
    """The state of an agent's loop after each of its calls (conv, pos, key, name): running totals, and the first rule that ends it.

    Of rules that hold at once the first counts: budget (``most`` calls), messages (``most_messages`` of them, where ``calls`` has the
    column ``messages``, their number after the call), final_answer, repeated (``same`` equal calls).  One shuffle by conversation; the limits
    bound what a conversation needs.
    """
    order = Window.partitionBy("conv").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    alike = Window.partitionBy("conv", "key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    s = calls.withColumns({"total": F.count("*").over(order), "alike": F.count("*").over(alike)})
    full = F.col("messages") >= most_messages if "messages" in calls.columns else F.lit(False)
    rule = F.when(F.col("total") >= most, "budget").when(full, "messages").when(F.col("name") == "final_answer", "final_answer").when(F.col("alike") >= same, "repeated")
    s = s.withColumn("rule", rule)
    first = s.where("rule IS NOT NULL").groupBy("conv").agg(F.min(F.struct("pos", "rule")).alias("f"))
    return first.select("conv", F.col("f.pos").alias("stopped_at"), F.col("f.rule").alias("rule"))


def legacy_answer(messages: Column) -> Column:
    """P10: the content of the first message of role tool and name final_answer (messages with a ``name``)."""
    return F.get(F.filter(messages, lambda m: (m["role"] == "tool") & (m["name"] == "final_answer")), F.lit(0))["content"]


def legacy_correct(answer: Column, gold: Column, answer_format: Column) -> Column:
    """P10: whether the answer holds a float's text, or equals any other gold text; no answer is not correct."""
    return F.coalesce(F.when(answer_format == "float", F.contains(answer, gold)).otherwise(answer == gold), F.lit(False))


def legacy_calls(messages: Column, clean: bool = False) -> Column:
    """The first call of every assistant's message that has one (name, arguments); ``clean`` leaves out think."""
    said = F.filter(messages, lambda m: (m["role"] == "assistant") & (F.size(m["tool_calls"]) > 0))
    first = F.transform(said, lambda m: F.get(m["tool_calls"], F.lit(0))["function"])
    return F.filter(first, lambda c: c["name"] != "think") if clean else first
