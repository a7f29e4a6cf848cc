"""Small row and column operations that analyses of runs need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_all(rows: DataFrame, **values) -> DataFrame:
    """Rows in which every named column has the given value (None: is null)."""
    return rows.where(reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in values.items()], F.lit(True)))


def has_final_answer(messages: Column) -> Column:
    """Whether an assistant's message calls final_answer."""
    return F.exists(messages, lambda m: (m["role"] == "assistant") & F.coalesce(F.exists(m["tool_calls"], lambda c: c["function"]["name"] == "final_answer"), F.lit(False)))


def sample(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows drawn by a hash of (key, seed), so that a draw can be repeated (a sampling operator)."""
    return rows.orderBy(F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)), 256), key).limit(n)


def mean_words(catalogue: DataFrame) -> DataFrame:
    """Average number of words of all paraphrases of ``catalogue(id, paraphrase)``."""
    each = catalogue.select(F.explode("paraphrase").alias("p"))
    return each.agg(F.avg(F.size(F.filter(F.split("p", r"\s+"), lambda w: w != ""))).alias("mean_words"))


def merge_paraphrases(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both catalogues, sorted by id; the paraphrases of a new entry replace the old one's."""
    from ..sources.files import upsert

    return upsert(old, new, "id").orderBy("id")


def mean_and_deviation(mean: Column, deviation: Column, digits: int = 2) -> Column:
    """A table cell "mean ± deviation" in LaTeX's notation."""
    return F.concat(F.format_number(mean, digits), F.lit(r" $\pm$ "), F.format_number(deviation, digits))


def count_exploded(rows: DataFrame, column: str) -> DataFrame:
    """How often each element of an array column occurs, most frequent first; rows without any count as 'unknown'."""
    each = rows.select(F.explode_outer(column).alias("_e")).select(F.coalesce(F.col("_e").cast("string"), F.lit("unknown")).alias(column))
    return each.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two arrays as sets, 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, most frequent first, then by value; nulls are left out."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def first_rows(rows: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first ``n`` rows in an order that is said (a limit that a batch is given); without ``n`` all of them."""
    return rows if n is None else rows.orderBy(*order).limit(n)


def clean(rows: DataFrame, needed: list[str], unique: list[str], order: list[str]) -> DataFrame:
    """Rows without nulls in ``needed``, the first (in ``order``, then by all columns) of those equal in ``unique``, sorted."""
    rest = [c for c in rows.columns if c not in unique]
    by = F.struct(*dict.fromkeys([c for c in order if c not in unique] + rest)) if rest else F.lit(0)
    kept = rows.dropna(subset=needed).groupBy(*unique).agg(F.min(by).alias("_first"))
    return kept.select(*(F.col(c) if c in unique else F.col(f"_first.{c}").alias(c) for c in rows.columns)).orderBy(*order)


def timing_summary(timings: DataFrame, splits: list[str]) -> DataFrame:
    """A row for each template of ``timings(template, total_time, time_per_attempt, <splits>)``, and a last one, template Total.

    The total has the sum of the times, the mean time per attempt, and as ``filled`` how many splits were filled at all.
    """
    filled = sum((F.col(f"`{s}`").isNotNull().cast("long") for s in splits), F.lit(0).cast("long"))
    each = timings.select("template", F.col("total_time").cast("double"), F.col("time_per_attempt").cast("double"), filled.alias("filled"))
    total = each.agg(F.coalesce(F.sum("total_time"), F.lit(0.0)).alias("total_time"), F.coalesce(F.avg("time_per_attempt"), F.lit(0.0)).alias("time_per_attempt"), F.coalesce(F.sum("filled"), F.lit(0)).alias("filled"))
    return each.unionByName(total.withColumn("template", F.lit("Total")))
