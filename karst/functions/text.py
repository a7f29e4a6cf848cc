"""Text helpers shared by lookups, matching, scoring and provenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOATS = r"[-+]?\d*\.\d+|\d+"
INTS = r"-?\d+"


def _as_json(text: Column) -> Column:
    """A Python literal in JSON: quotes, None, True, False, tuples and commas before a closing bracket."""
    tokens = F.regexp_extract_all(text, F.lit(r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^'"]++|['"]"""), F.lit(0))

    def token(t: Column) -> Column:
        inside = F.replace(F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"'))
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
        bare = F.regexp_replace(F.translate(bare, "()", "[]"), r",\s*\]", "]")
        return F.when(F.startswith(t, F.lit("'")) & (F.length(t) > 1), F.concat(F.lit('"'), inside, F.lit('"'))).when(F.startswith(t, F.lit('"')), t).otherwise(bare)

    return F.array_join(F.transform(tokens, token), "")


def list_literal(text: Column) -> Column:
    """The elements of a list or tuple, written as JSON or as in Python, as strings (None: null); null if it is no list."""
    t = F.trim(text)
    python = F.startswith(t, F.lit("[")) | (F.startswith(t, F.lit("(")) & F.contains(t, F.lit(",")))
    return F.coalesce(F.from_json(t, "array<string>"), F.when(python, F.from_json(_as_json(t), "array<string>")))


def numbers(text: Column) -> Column:
    """A list literal's elements as doubles; what is no number is null."""
    return F.transform(list_literal(text), lambda x: x.try_cast("double"))


def words(text: Column, strip: str) -> Column:
    """Lower-cased words between white space, without the characters ``strip`` at their ends, empty ones dropped."""
    split = F.transform(F.split(F.lower(text), r"\s+"), lambda t: F.trim(t, F.lit(strip)))
    return F.filter(split, lambda t: t != "")


def plain_words(text: Column) -> Column:
    """Lower-cased words without any punctuation."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"\p{Punct}", ""), r"\s+"), lambda t: t != "")


def named(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it names often: the value is written and computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def number_text(number: Column) -> Column:
    """A double as Python writes it: plain digits from 0.0001 up to below 1e16, beyond that 1e+16 and 1.5e-05; nan, inf and -inf.

    It reads back as the same double; the last of 17 digits may differ from Python's.
    """
    return named(number, lambda x: F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(named(_java_text(x), _python_text)))


def _java_text(x: Column) -> Column:
    # before version 19 Java may write a digit more than tell the number
    least = F.coalesce(*(F.when(F.format_string(f"%.{k}e", x).try_cast("double") == x, F.format_string(f"%.{k}e", x)) for k in (15, 16)), x.cast("string"))
    return F.when(F.length(F.regexp_replace(x.cast("string"), r"E.*|\D", "")) > 16, least).otherwise(x.cast("string"))


def _python_text(java: Column) -> Column:
    digits = F.regexp_replace(F.translate(F.regexp_extract(java, r"^-?([\d.]+)", 1), ".", ""), r"(?<=\d)0+$", "")
    cut = F.struct(F.when(F.startswith(java, F.lit("-")), "-").otherwise("").alias("s"), digits.alias("d"), F.regexp_extract(java, r"[eE]([-+]?\d+)$", 1).try_cast("int").alias("p"))

    def shown(c: Column) -> Column:
        d, p = c["d"], c["p"]
        whole = F.concat(F.substring(F.rpad(d, p + 1, F.lit("0")), F.lit(1), p + 1), F.lit("."), F.when(F.length(d) > p + 1, F.substring(d, p + 2, F.length(d))).otherwise("0"))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -p - 1), d)
        tail = F.when(F.length(d) > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), F.length(d)))).otherwise("")
        far = F.concat(F.substring(d, F.lit(1), F.lit(1)), tail, F.when(p < 0, "e-").otherwise("e+"), F.lpad(F.abs(p).cast("string"), F.greatest(F.lit(2), F.length(F.abs(p).cast("string"))), F.lit("0")))
        return F.concat(c["s"], F.when(p.between(0, 15), whole).when(p.between(-4, -1), small).otherwise(far))

    # Java writes a power from 1e7 on and below 0.001
    return F.when(F.contains(F.lower(java), F.lit("e")), named(cut, shown)).otherwise(java)


def canonical(text: Column) -> Column:
    """Numbers that are equal get equal texts ("2", "2.0"); other texts stay."""
    number = text.try_cast("double")
    return F.coalesce(number.cast("string"), text)


def canonical_call(name: Column, arguments: Column) -> Column:
    """A call as one comparable text: arguments by name, numbers in canonical form, lists of values sorted."""
    pair = lambda k, v: F.concat(k, F.lit("="), F.when(k == "values", _sorted_list(v)).otherwise(F.coalesce(canonical(v), F.lit("null"))))
    entries = F.array_sort(F.map_entries(arguments))
    return F.concat(name, F.lit("("), F.array_join(F.transform(entries, lambda e: pair(e["key"], e["value"])), ", "), F.lit(")"))


def _sorted_list(text: Column) -> Column:
    items = F.transform(F.filter(list_literal(text), lambda x: x.isNotNull()), canonical)
    return F.coalesce(F.array_join(F.array_sort(items), ","), text, F.lit("null"))


def percent_error(pred: Column, gold: Column) -> Column:
    return F.when(gold == 0, F.abs(pred - gold) * 100).otherwise(F.abs(pred - gold) / F.abs(F.nullif(gold, F.lit(0.0))) * 100)


def suffix_coded(indicator: Column, suffixes: list[str]) -> Column:
    """Whether any dot-separated part of the code is one of ``suffixes``."""
    return F.arrays_overlap(F.split(indicator, r"\."), F.array(*map(F.lit, suffixes)))


#: Parts of codes of derived series (per capita, current prices, shares, price parities).
DERIVED = ["PC", "CD", "XD", "ZS", "PP", "P6", "P5", "P2"]


def docstring_arguments(doc: Column) -> Column:
    """A map of the arguments that a docstring's Args section describes to their descriptions, each on one line; empty without one."""
    section = F.regexp_extract(doc, r"(?s)Args:\n(.*?)(\n\S|\z)", 1)
    entries = F.regexp_extract_all(section, F.lit(r"(?sm)^\s*\w+:\s*.*?(?=\n\s*\w+:|\z)"), F.lit(0))
    name = lambda e: F.regexp_extract(e, r"^\s*(\w+):", 1)
    says = lambda e: F.translate(F.regexp_replace(F.regexp_replace(e, r"^\s*\w+:\s*", ""), r"\s+\z", ""), "\n", " ")
    # of a name met again the last counts
    pairs = F.transform(entries, lambda e: F.struct(name(e).alias("name"), says(e).alias("says")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda y: y["name"] == x["name"]))
    return F.map_from_entries(last)


def split_label(label: Column) -> Column:
    """An edge's label as (arg, value): cut at the first ``=``; without one all of it is the argument, and the value is null."""
    at = F.instr(label, F.lit("="))
    return F.struct(F.when(at > 0, F.substring(label, F.lit(1), at - 1)).otherwise(label).alias("arg"), F.when(at > 0, F.substring(label, at + 1, F.length(label))).alias("value"))


def without_prefix(attributes: Column, prefix: str) -> Column:
    """The entries of a map whose keys begin with ``prefix``, without it."""
    own = F.map_filter(attributes, lambda k, v: F.startswith(k, F.lit(prefix)))
    return F.transform_keys(own, lambda k, v: F.substring(k, F.lit(len(prefix) + 1), F.length(k)))
