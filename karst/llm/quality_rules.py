"""Quality rules: documents whose histograms diverge from their language's go.

Two histograms of a document, its characters by class and its words by the common words below (and all
others), are compared by Jensen-Shannon distance with the same histograms summed over all documents of its language.
Documents too short for a histogram to say anything are not judged by it.  The language references are at most one row for
each of ``LANGUAGES`` and one of all documents, which also stands in for other, null or thin languages.

DataFrame functions only; one pass over the texts writes a row of counts per document, all else reads those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import Work, pick

# The languages with references, and the most common words of each.
LANGUAGES = ["en", "fr", "de", "es"]
COMMON_WORDS = [
    "the", "of", "and", "to", "in", "is",
    "le", "la", "les", "et", "des", "que",
    "der", "die", "und", "den", "das", "von",
    "el", "los", "y", "en", "de", "se",
]
CLASSES = {"upper": r"[A-ZÀ-ÖØ-Þ]", "digit": r"[0-9]", "symbol": r"[#*$%&|<>]", "mark": r"[!-\"'-),-/:;=?@\[-`{}~]"}
_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"

MIN_WORDS = 50
#: No histogram is judged below these sizes, nor a language reference used below REFERENCE_WORDS.
CHAR_GUARD, WORD_GUARD, REFERENCE_WORDS = 200, 50, 1000
#: A distance may be (a, b): a + b / sqrt(size), since the distance that chance alone makes falls with the root of the size.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = (0.2, 2.0), (0.16, 1.1)


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the array holds twice or more; linear but for one sort."""
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 3, grams)


def _counts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", "lang", text.alias("text"))
    base = base.withColumn("words", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).withColumn("solid", F.length(F.regexp_replace("text", _SPACE, "")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    base = base.withColumn("lines", lines)
    seen = base.select(
        "doc_id", "lang", "words",
        F.size("words").cast("long").alias("n_words"),
        F.col("solid").cast("long").alias("word_chars"),
        *(F.regexp_count("text", F.lit(p)).cast("long").alias(f"c_{k}") for k, p in CLASSES.items()),
        (F.length("text") - F.col("solid")).cast("long").alias("c_space"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("grams"),
    )
    seen = seen.withColumn("repeats", F.coalesce(F.size(F.array_distinct("grams")) < F.size("grams"), F.lit(False)))
    order = F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    seen = seen.withColumn("order", F.when(F.col("repeats"), order))
    twice = F.filter(F.sequence(F.lit(0), F.size("order") - 1), lambda j: (F.get("order", j)["h"] == F.get("order", j - 1)["h"]) | (F.get("order", j)["h"] == F.get("order", j + 1)["h"]))
    seen = seen.withColumn("at", F.when(F.col("repeats"), F.sort_array(F.transform(twice, lambda j: F.get("order", j)["i"]))))
    covered = F.aggregate(F.sequence(F.lit(0), F.size("at") - 2), F.lit(3).cast("long"), lambda s, k: s + F.least(F.lit(3), F.get("at", k + 1) - F.get("at", k)))
    n = lambda w: (F.col("n_words") - F.size(F.array_remove("words", w))).cast("long")
    return seen.select(
        "doc_id", "lang", "n_words", "word_chars", F.col("c_symbol").alias("n_symbols"), "n_dup_lines",
        F.when(F.col("repeats"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(*(F.col(f"c_{k}") for k in CLASSES), F.col("c_space"), F.col("word_chars") - sum(F.col(f"c_{k}") for k in CLASSES)).alias("chars"),
        F.array(*(n(w) for w in COMMON_WORDS)).alias("common"),
    )


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of counts; null where either sums to 0."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    share = lambda a, t: F.transform(a, lambda x: x.cast("double") / t)
    part = lambda x, m: F.when(x > 0, x * F.ln(x / m)).otherwise(F.lit(0.0))
    a, b = F.when(total(p) > 0, share(p, total(p))), F.when(total(q) > 0, share(q, total(q)))
    terms = F.zip_with(a, b, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / (2 * F.ln(F.lit(2.0)))))


def judge(docs: DataFrame) -> DataFrame:
    """A row for every row of ``docs(doc_id, text, lang)`` with the counts, base_failed, the two distances and kept.

    A null text has no words.  base_failed: fewer than 50 words, or over half of them in repeated 3-word windows.
    kept is false if base_failed or if a distance exceeds its bound where the document passes the length guard.
    Repeated rows are judged each; other columns are ignored; an empty table gives no rows.
    """
    work = Work(docs.sparkSession, "quality-rules")
    counts = work.write(_counts(pick(docs, doc_id="long", text="string", lang="string")), "counts")
    known = F.when(F.col("lang").isin(LANGUAGES), F.col("lang"))
    common = F.concat(F.col("common"), F.array(F.col("n_words") - F.aggregate("common", F.lit(0).cast("long"), lambda s, x: s + x)))
    counts = counts.withColumns({"language": known, "common": common})
    sums = lambda c, n: F.array(*(F.sum(F.get(c, F.lit(i))) for i in range(n))).alias(c)
    cube = counts.withColumn("language", F.explode(F.array(F.lit("*"), F.coalesce("language", F.lit("?"))))).where("language <> '?'")
    reference = cube.groupBy("language").agg(sums("chars", len(CLASSES) + 2), sums("common", len(COMMON_WORDS) + 1), F.sum("n_words").alias("words"))
    reference = work.write(reference, "reference")  # at most one row a language and one of all
    rename = lambda r, x: r.select(F.col("language").alias(f"l{x}"), F.col("chars").alias(f"chars{x}"), F.col("common").alias(f"common{x}"))
    own = rename(reference.where((F.col("language") != "*") & (F.col("words") >= REFERENCE_WORDS)), "1")
    every = rename(reference.where("language = '*'"), "2").drop("l2")
    judged = counts.join(F.broadcast(own), F.col("language") == F.col("l1"), "left").join(F.broadcast(every), F.lit(True), "left")
    judged = judged.withColumn("char_distance", _distance(F.col("chars"), F.coalesce("chars1", "chars2")))
    judged = judged.withColumn("word_distance", _distance(F.col("common"), F.coalesce("common1", "common2")))
    size = F.col("word_chars") + F.get("chars", F.lit(len(CLASSES)))
    bound = lambda n, ab: ab[0] + ab[1] / F.sqrt(n.cast("double"))
    far = ((size >= CHAR_GUARD) & (F.col("char_distance") > bound(size, MAX_CHAR_DISTANCE))) | ((F.col("n_words") >= WORD_GUARD) & (F.col("word_distance") > bound(F.col("n_words"), MAX_WORD_DISTANCE)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "char_distance", "word_distance", (~failed & ~F.coalesce(far, F.lit(False))).alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over the whole of ``documents``."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("char_distance", "word_distance")


def _sql() -> str:
    word_list = ", ".join(f"'{w}'" for w in COMMON_WORDS)
    classes = "\n".join(f"    len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')) AS c_{k}," for k, p in CLASSES.items())
    minus = " - ".join(f"c_{k}" for k in CLASSES)
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i + 1}])" for i in range(n)) + "]"
    distance = lambda p, q: (
        f"sqrt(greatest(0, list_sum([CASE WHEN x[1] > 0 THEN x[1] * ln(x[1] / ((x[1] + x[2]) / 2)) ELSE 0 END + "
        f"CASE WHEN x[2] > 0 THEN x[2] * ln(x[2] / ((x[1] + x[2]) / 2)) ELSE 0 END FOR x IN "
        f"[[CAST({p}[i] AS DOUBLE) / list_sum({p}), CAST({q}[i] AS DOUBLE) / list_sum({q})] FOR i IN range(1, len({p}) + 1)]]) / (2 * ln(2))))"
    )
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, text, regexp_extract_all(text, '{_WORD}') AS words,
        [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{_WORD}')] AS lines FROM t),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM h CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 2 GROUP BY 1),
c AS (SELECT w.doc_id, CASE WHEN lang IN ('en', 'fr', 'de', 'es') THEN lang END AS language, len(words) AS n_words,
    length(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars, length(text) AS n_all,
{classes}
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    [len(words) - len([x FOR x IN words IF x <> m]) FOR m IN [{word_list}]] AS common FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
d AS (SELECT *, [{", ".join(f"c_{k}" for k in CLASSES)}, n_all - word_chars, word_chars - {minus}] AS chars,
    list_append(common, n_words - list_sum(common)) AS common2 FROM c),
f AS (SELECT language, {sums("chars", len(CLASSES) + 2)} AS q_chars, {sums("common2", len(COMMON_WORDS) + 1)} AS q_common FROM d
      WHERE language IS NOT NULL GROUP BY 1 HAVING sum(n_words) >= {REFERENCE_WORDS}),
a AS (SELECT {sums("chars", len(CLASSES) + 2)} AS a_chars, {sums("common2", len(COMMON_WORDS) + 1)} AS a_common FROM d),
j AS (SELECT d.*, coalesce(q_chars, a_chars) AS q1, coalesce(q_common, a_common) AS q2 FROM d LEFT JOIN f ON f.language = d.language CROSS JOIN a),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_all >= {CHAR_GUARD} AND n_all > 0 THEN {distance("chars", "q1")} > {MAX_CHAR_DISTANCE[0]} + {MAX_CHAR_DISTANCE[1]} / sqrt(n_all) ELSE FALSE END AS far1,
    CASE WHEN n_words >= {WORD_GUARD} AND n_words > 0 THEN {distance("common2", "q2")} > {MAX_WORD_DISTANCE[0]} + {MAX_WORD_DISTANCE[1]} / sqrt(n_words) ELSE FALSE END AS far2 FROM j)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(c_symbol AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
    NOT base_failed AND NOT far1 AND NOT far2 AS kept FROM v
"""


ORACLE_SQL = _sql()
