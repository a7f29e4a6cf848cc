"""Worked examples of tool calls: arguments drawn from the data, the call executed, and both as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import toolbox
from ..operators.cells import Cube
from ..operators.dispatch import execute
from ..operators.rows import sample
from ..session import ensure_checkpoint_dir
from .questions import FIRST_YEAR, LAST_YEAR

# The keywords and texts that examples use.
KEYWORDS = ["water", "secondary", "poverty", "tuberculosis"]
THOUGHT = "Use this field to plan or think aloud about what actions to take."


def _numbers(salt: str, many: int) -> Column:
    """``many`` numbers from -5 to 5 with three decimals, by a hash of the draw."""
    at = lambda i: F.round((F.pmod(F.xxhash64("k", F.lit(f"{salt}{i}")), F.lit(10_000)) / 1000.0) - 5, 3)
    return F.array(*map(at, range(many)))


def calls(cube: Cube, indicators: DataFrame, n: int = 3, which: str = "all", seed: int = 0) -> DataFrame:
    """(call_id, name, arguments): ``n`` calls of every tool of the toolbox, arguments drawn by a hash of the seed."""
    spark = cube.geo.sparkSession

    def drawn(name: str, values: DataFrame) -> DataFrame:
        few = sample(values.dropna().distinct(), n, values.columns[0], seed)  # n rows at most
        listed = few.agg(F.sort_array(F.collect_list(values.columns[0])).alias("_v"))
        return spark.range(n).crossJoin(listed).select(F.col("id").alias("k"), F.get("_v", F.pmod("id", F.greatest(F.size("_v"), F.lit(1))).cast("int")).cast("string").alias(name))

    draws = spark.range(n).withColumnRenamed("id", "k")
    years = spark.range(FIRST_YEAR, LAST_YEAR + 1).select("id")
    for name, values in [
        ("country_code", cube.geo.select("country_code")), ("country_name", cube.geo.select("country_name")), ("region", cube.geo.select("region")),
        ("indicator_name", indicators.select("name")), ("indicator_code", indicators.select("id")), ("year", years),
    ]:
        draws = draws.join(drawn(name, values), "k")
    word = F.get(F.array(*map(F.lit, KEYWORDS)), F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(len(KEYWORDS))).cast("int"))
    made = {"value_a": F.get(_numbers(f"a{seed}", 1), F.lit(0)), "value_b": F.get(_numbers(f"b{seed}", 1), F.lit(0)), "values": F.to_json(_numbers(f"v{seed}", 3)), "query_value": F.lit(0.0), "keywords": word, "thought": F.lit(THOUGHT), "answer": F.get(_numbers(f"f{seed}", 1), F.lit(0)) * 10}
    draws = draws.withColumns({k: v.cast("string") for k, v in made.items()})
    given = lambda tool: F.create_map(*(x for a, _, _ in tool.arguments for x in (F.lit(a), F.col(a))))
    every = F.explode(F.array(*(F.struct(F.lit(t.name).alias("name"), given(t).alias("arguments")) for t in toolbox(which))))
    return draws.select("k", every.alias("c")).select(F.concat_ws("-", "c.name", "k").alias("call_id"), "c.name", "c.arguments")


def examples(cube: Cube, indicators: DataFrame, n: int = 3, which: str = "all", seed: int = 0) -> DataFrame:
    """(name, examples): for every tool ``n`` executed calls as text, an error's message standing for its result."""
    ensure_checkpoint_dir(indicators.sparkSession)
    done = execute(calls(cube, indicators, n, which, seed).checkpoint(), cube, indicators, "raise")
    given = F.array_join(F.transform(F.map_entries("arguments"), lambda e: F.concat(e["key"], F.lit("='"), e["value"], F.lit("'"))), ", ")
    text = F.concat(F.lit("Example of `"), "name", F.lit("` tool call: "), "name", F.lit("("), given, F.lit(")\nReturns: "), F.coalesce("result", F.lit("None")))
    numbered = done.select("name", text.alias("t"), F.row_number().over(Window.partitionBy("name").orderBy("call_id")).alias("k"))
    return numbered.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "\n\n").alias("examples"))
