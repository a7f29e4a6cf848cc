"""Fill-in-middle transformation by escaped marker injection, with Spark's own text functions only.

A delimiter that cannot stand in the escaped text is put after every unit (a run of ASCII letters, or any other code point) by one
``regexp_replace``.  Counting it gives the number of units, ``substring_index`` the parts before, between and after the two ranks drawn for a
document, and removing the delimiters and the escapes gives their exact texts.  Draws come from the SHA-256 of seed and id, so they
depend on nothing else.  Rows are not shuffled.

Odd input: a null text counts as empty; an empty text has no units and stays plain, as does a text that contains one of the three markers; repeated
rows are all transformed; a null id draws like an empty one; a text of any length is one row and is never cut.  Further columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import pick

#: What begins prefix, suffix and middle in an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of documents left plain, and of the others with the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
SEED = 1
#: The delimiter and the escape, code points that are escaped where a text has them; the two escapes end in digits, which are no letters.
_END, _ESCAPE = "\x01", "\x02"
_ESCAPES = ((_ESCAPE, _ESCAPE + "2"), (_END, _ESCAPE + "1"))
_UNIT = f"{_ESCAPE}[12]|[A-Za-z]+|[^A-Za-z]"


def escape(text: Column) -> Column:
    for plain, escaped in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    """The text of some units, without the delimiters between them."""
    text = F.replace(text, F.lit(_END), F.lit(""))
    for plain, escaped in reversed(_ESCAPES):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def part(marked: Column, count: Column, begin: Column, end: Column) -> Column:
    """Units ``begin`` to ``end`` (from 0, end excluded) of a marked text with ``count`` units."""
    upto = F.when(end >= count, marked).otherwise(F.concat(F.call_function("substring_index", marked, F.lit(_END), end.cast("int")), F.lit(_END)))
    upto = F.when(end == 0, F.lit("")).otherwise(upto)
    # counted from the end, where the last unit's own delimiter is the first
    rest = F.call_function("substring_index", upto, F.lit(_END), (begin - end - 1).cast("int"))
    return unescape(F.when(begin >= end, F.lit("")).otherwise(rest))


def draw(doc_id: Column, k: int, seed: int = SEED) -> Column:
    """The k-th number (from 0) below 2^32 drawn for a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output): ``form`` is plain, psm or spm; parts are null where it is plain."""
    rows = pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    odd = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        odd = odd | F.contains("text", F.lit(marker))
    form = F.when((F.col("text") == "") | odd | (draw(F.col("doc_id"), 2, seed) % 100 >= 100 - plain), "plain")
    form = form.when(draw(F.col("doc_id"), 3, seed) % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", form.alias("form"), F.regexp_replace(escape(F.col("text")), _UNIT, f"$0{_END}").alias("marked"))
    n = (F.length("marked") - F.length(F.replace("marked", F.lit(_END), F.lit("")))).cast("long")
    rows = rows.withColumn("n", n)
    h1, h2 = (draw(F.col("doc_id"), k, seed) % (F.col("n") + 1) for k in (0, 1))
    rows = rows.withColumns({"low": F.least(h1, h2), "high": F.greatest(h1, h2)})
    bounds = {"prefix": (F.lit(0).cast("long"), F.col("low")), "middle": (F.col("low"), F.col("high")), "suffix": (F.col("high"), F.col("n"))}
    rows = rows.withColumns({k: F.when(F.col("form") != "plain", part(F.col("marked"), F.col("n"), *v)) for k, v in bounds.items()})
    p, s, m = ([F.lit(t), F.col(c)] for t, c in ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", F.concat(*s, *p, *m)).otherwise(F.concat(*p, *s, *m))
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of; each marker stands in it once, since texts that contain one stay plain."""
    after = lambda marker: F.substring_index(output, marker, -1)
    before = lambda text, marker: F.substring_index(text, marker, 1)
    prefix = F.when(form == "spm", before(after(PREFIX), MIDDLE)).otherwise(before(after(PREFIX), SUFFIX))
    suffix = F.when(form == "spm", before(after(SUFFIX), PREFIX)).otherwise(before(after(SUFFIX), MIDDLE))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, after(MIDDLE), suffix))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE_SQL = """
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
  FROM documents
), h AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4
  FROM u
), r AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT doc_id, n, form, text, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:n], '') AS s FROM r
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
