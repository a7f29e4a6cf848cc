"""A training-text pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, all columns; the last returns tokens.  Columns that a stage does not
know pass through, whatever their names; null and empty texts, repeated rows, null ids and empty tables have the results said below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm import bpe, decontaminate, line_dedup, ngram_join, quality_model
from karst.llm._work import Work, send_if_small

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among them, rejects go.

    A null text is judged as an empty one; each row is judged by its whole text alone, so repeated rows stay or go together; no rows, no labels: nothing goes.
    """
    weights = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.keep_quality(docs, weights)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; so does a document of which nothing but white space is left.

    Null and empty texts hold no line to drop and stay; rows of one doc_id are one document; a row with a null doc_id keeps its lines.
    """
    own = {c: f"_own_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(own))
    out = out.where((F.col("n_dropped") == 0) | (F.length(F.trim("text", F.lit(" \t\n\x0b\x0c\r"))) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their five-word shingles only the smallest doc_id stays.

    Texts without words link with nothing and stay, as do rows with a null doc_id; repeated rows of the doc_id that stays all stay.
    """
    found = ngram_join.jaccard_components(docs)
    gone = Work(spark, "near-duplicates").write(found.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return docs.join(send_if_small(gone), "doc_id", "left_anti").select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none; null or empty items are held by none; each row is judged by its whole text, however long.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of the documents left, a row a row; null and empty texts have no tokens."""
    return bpe.coded(docs, bpe.read_file())


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("line dedup", repeated_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("BPE encoding and decoding", tokens),
]

#: BPE has no SQL form; the tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            work.drop(f"stage-{k - 1}")
    return docs
