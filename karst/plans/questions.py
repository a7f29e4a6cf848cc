"""Slot domains, valid combinations, rendering, splits and quotas, all as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.cells import Cube
from .templates import SKIPPED, TEMPLATES, answer

#: Fixed values of the slots that do not come from data.
NARY, BINARY, AGGREGATION, NUMBERS = ["highest", "lowest"], ["higher", "lower"], ["total", "mean", "median"], [2, 3, 4, 5]
FIRST_YEAR, LAST_YEAR = 2003, 2022
SPLITS = ["answerable-full", "answerable-partial", "unanswerable-partial", "unanswerable-missing"]


def _literals(spark, name: str, values: list) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))


def domain(cube: Cube, slot: str, years: DataFrame | None = None, operators: list[str] = NARY) -> DataFrame:
    """One column ``slot`` of its allowed values; subjects bring their region along as ``<slot>_region``."""
    spark = cube.geo.sparkSession
    kind = slot.split("_")[0]
    if kind == "subject":
        return cube.geo.select(F.col("country_code").alias(slot), F.col("region").alias(f"{slot}_region"))
    if kind == "region":
        return cube.geo.where("region IS NOT NULL").select(F.col("region").alias(slot)).distinct()
    if kind == "property":
        return cube.observations.select(F.col("indicator_code").alias(slot)).distinct()
    if kind == "year":
        return (years if years is not None else spark.range(FIRST_YEAR, LAST_YEAR + 1).select(F.col("id").cast("int").alias("year"))).select(F.col("year").alias(slot))
    if kind == "n":
        return _literals(spark, slot, NUMBERS)
    if kind == "operator":
        return _literals(spark, slot, operators)
    if kind == "aggregation":
        return _literals(spark, slot, AGGREGATION)
    raise ValueError(f"unknown slot {slot}")


#: Templates whose operator is highest / lowest; the others' is higher / lower.
_NARY_TEMPLATES = {"RegionComparison", "RegionComparisonResult", "RegionPropertyChange", "TopNTotal"}


def operators_of(name: str) -> list[str]:
    return NARY if name in _NARY_TEMPLATES else BINARY


def combinations(cube: Cube, name: str, years: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """Every valid combination of the template's slots, with a question_id that is a digest of them."""
    template = TEMPLATES[name]
    parts = [domain(cube, s, years, operators_of(name)) for s in template.slots]
    every = reduce(DataFrame.crossJoin, parts)
    every = every.where(template.valid())
    every = every.where(where) if where is not None else every
    return every.select(F.sha2(F.concat_ws("|", F.lit(name), *(F.col(s).cast("string") for s in template.slots)), 256).alias("question_id"), *template.slots)


def _draw(key: str, salt: str) -> Column:
    """A whole number below 16**15 from a digest, the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key, F.lit(salt))), 1, 15), 16, 10).cast("long")


def render(questions: DataFrame, name: str, geo: DataFrame, paraphrases: DataFrame, seed: int = 0, wording: int | None = None) -> DataFrame:
    """Adds slot_values and question: wording and paraphrase are chosen by a digest of (question_id, seed), or are number ``wording`` of each.

    ``paraphrases(id, name, paraphrase)``: the property is named by a paraphrase, property_original is its name; countries go by name.
    """
    template = TEMPLATES[name]
    slots = list(template.slots)
    out = questions
    for s in [s for s in slots if s.startswith("subject")]:
        out = out.join(geo.select(F.col("country_code").alias(s), F.col("country_name").alias(f"{s}_name")), s, "left")
    out = out.join(paraphrases.select(F.col("id").alias("property"), F.col("name").alias("property_original"), "paraphrase"), "property", "left")
    place = lambda salt: F.lit(wording) if wording is not None else _draw("question_id", f"{salt}{seed}")
    chosen = lambda options, salt: F.get(options, F.pmod(place(salt), F.size(options)).cast("int"))
    text = chosen(F.array(*map(F.lit, template.wording)), "w")
    shown = {s: F.col(f"{s}_name") if s.startswith("subject") else F.col(s).cast("string") for s in slots} | {"property": chosen(F.col("paraphrase"), "p")}
    for s in slots:
        text = F.replace(text, F.lit(f"{{{s}}}"), shown[s])
    extra = ["property_original", *(f"{s}_name" for s in slots if s.startswith("subject"))]
    values = F.create_map(*(x for s in [*slots, *extra] for x in (F.lit(s), F.col(s).cast("string"))))
    return out.select(*questions.columns, values.alias("slot_values"), text.alias("question"))


def split_of() -> Column:
    """The split of (answerable, data_availability); null for pairs that no split takes."""
    able, state = F.col("answerable"), F.col("data_availability")
    return (
        F.when(able & (state == "full"), "answerable-full")
        .when(able & (state == "partial"), "answerable-partial")
        .when(~able & (state == "partial"), "unanswerable-partial")
        .when(~able & (state == "missing"), "unanswerable-missing")
    )


def answer_text(name: str) -> Column:
    """The answer as text, for tables of several templates: lists as JSON."""
    return F.to_json(F.col("answer")) if TEMPLATES[name].answer_format == "list[str]" else F.col("answer").cast("string")


def examples(cube: Cube, names: list[str], quota: int, years: DataFrame | None = None, seed: int = 0, where: Column | None = None) -> DataFrame:
    """Up to ``quota`` examples for each template and split, drawn by a digest of (question_id, seed) (a sampling operator).

    Quotas are filled by a ranked window, whose limit Spark pushes below the shuffle.
    """
    parts = []
    for name in names:
        got = answer(combinations(cube, name, years, where), cube, name)
        slots = F.create_map(*(x for s in TEMPLATES[name].slots for x in (F.lit(s), F.col(s).cast("string"))))
        parts.append(got.select("question_id", F.lit(name).alias("question_template"), slots.alias("slot_values"), answer_text(name).alias("answer"), "answerable", "data_availability", F.lit(TEMPLATES[name].answer_format).alias("answer_format"), split_of().alias("split")))
    every = reduce(DataFrame.unionByName, parts).where("split IS NOT NULL")
    spark = cube.geo.sparkSession
    skipped = spark.createDataFrame(SKIPPED, "question_template string, split string")
    every = every.join(F.broadcast(skipped), ["question_template", "split"], "left_anti").dropDuplicates(["question_id"])
    order = Window.partitionBy("question_template", "split").orderBy(F.sha2(F.concat_ws("|", "question_id", F.lit(seed)), 256), "question_id")
    return every.withColumn("k", F.row_number().over(order)).where(F.col("k") <= quota).drop("k")
