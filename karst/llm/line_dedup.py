"""Line dedup: a line that several documents hold stays only in the first of them.

Levelled sorted runs of line hashes.  A run is a table of (line hash, owner), bucketed and sorted by
the hash.  A batch of documents merge-anti-joins the runs: keys that a run holds keep their owner, the
others are fresh and become the batch's own run.  ``FANOUT`` runs of a level are compacted into one of the next level
before the next batch, so a key is rewritten once a level.  Batches come in ascending ranges of doc_id, so the owner of a
key is its smallest doc_id, and what a batch decides never changes later.

DataFrame functions only.  Lines are told apart by 128 bits of hash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import Work, parallelism, pick

FANOUT = 2
BATCHES = 4
MIN_POINTS = 10
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key with at least one line in so many is joined by broadcast; there can be no more such keys than this.
HOT_KEYS = 256


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z lower-cased (other letters as they are)."""
    bare = F.trim(line, F.lit(_SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


class LineRuns:
    """The levelled runs.  ``add(lines)`` returns what a batch drops and keeps its fresh keys."""

    def __init__(self, spark: SparkSession, work: Work, buckets: int):
        self.spark, self.work, self.buckets = spark, work, buckets
        self.levels: list[list[str]] = []
        self.tables: list[str] = []

    def _save(self, keys: DataFrame, level: int) -> None:
        name = f"karst_run_{uuid.uuid4().hex}"
        (
            keys.repartition(self.buckets, "k1", "k2").write.bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2")
            .option("path", self.work.path(name)).saveAsTable(name)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        self.tables.append(name)

    def _compact(self) -> None:
        for level in range(len(self.levels)):
            runs = self.levels[level]
            if len(runs) >= FANOUT:
                merged = self.spark.table(runs[0])
                for name in runs[1:]:
                    merged = merged.unionByName(self.spark.table(name))
                self._save(merged, level + 1)
                self.levels[level] = []
                for name in runs:
                    self._forget(name)

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.work.drop(name)
        self.tables.remove(name)

    def add(self, lines: DataFrame, name: str, last: bool = False) -> DataFrame:
        """``lines(k1, k2, doc_id, row, pos)`` of documents later than all before; returns (doc_id, row, pos) to drop.

        ``last``: no batch follows, so the run needs not be kept.
        """
        self._compact()
        keys = lines.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("end"), F.count("*").alias("n"))
        known = keys.withColumn("owner", F.lit(None).cast("long"))
        for run in (r for level in self.levels for r in level):
            held = self.spark.table(run).withColumnRenamed("owner", "held")
            known = known.join(held, ["k1", "k2"], "left").withColumn("owner", F.coalesce("owner", "held")).drop("held")
        known = self.work.write(known, f"{name}-keys")
        if not last:
            self._save(known.where("owner IS NULL").select("k1", "k2", F.col("first").alias("owner")), 0)
        repeated = known.where("owner IS NOT NULL OR first < end").select("k1", "k2", "n", F.coalesce("owner", "first").alias("owner"))
        least = max(2, -(-lines.count() // HOT_KEYS))
        hot = F.broadcast(repeated.where(F.col("n") >= least).select("k1", "k2", F.col("owner").alias("hot_owner")))
        cold = repeated.where(F.col("n") < least).select("k1", "k2", "owner")
        tagged = lines.join(hot, ["k1", "k2"], "left")
        by_hot = tagged.where("hot_owner <> doc_id").select("doc_id", "row", "pos")
        by_cold = tagged.where("hot_owner IS NULL").drop("hot_owner").join(cold, ["k1", "k2"]).where("owner <> doc_id").select("doc_id", "row", "pos")
        return by_hot.union(by_cold)

    def drop(self) -> None:
        for name in list(self.tables):
            self._forget(name)


def dropped_lines(docs: DataFrame, batches: int = BATCHES, min_points: int = MIN_POINTS) -> DataFrame:
    """(doc_id, row, dropped) of ``docs(doc_id, text)``: positions of lines to drop; row is a hash of the text."""
    spark = docs.sparkSession
    work = Work(spark, "line-dedup")
    split = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("row", F.xxhash64("text"))
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / batches) for i in range(1, batches)]), 1000).alias("c")).first().c if batches > 1 else []
    cuts = sorted(set(cuts or []))
    batch = sum([(F.col("doc_id") > c).cast("int") for c in cuts], F.lit(0))
    lines = split.where("doc_id IS NOT NULL").select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_points)
    lines = lines.select(F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(7), "key").alias("k2"), "doc_id", "row", "pos", batch.alias("batch"))
    stored = work.write(lines, "lines")
    runs = LineRuns(spark, work, parallelism(spark))
    parts = []
    try:
        for b in range(len(cuts) + 1):
            out = runs.add(stored.where(F.col("batch") == b).drop("batch"), f"batch-{b}", last=b == len(cuts))
            out = out.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("dropped"))
            parts.append(work.write(out, f"dropped-{b}"))
    finally:
        runs.drop()  # the runs are tables of the catalogue, also where a batch fails
    work.drop("lines")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def dedup_lines(docs: DataFrame, batches: int = BATCHES, min_points: int = MIN_POINTS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and n_lines and n_dropped added.

    Texts are split at \\n (null or empty: one empty line).  Lines whose key (see ``line_key``) has at
    least ``min_points`` code points and is found in two or more documents go, all of them, from every document but the
    smallest doc_id holding the key; the other lines stay in order, joined by \\n.  Rows of one doc_id are one
    document.  A row with a null doc_id keeps its lines and owns none.  Columns other than text pass through unchanged,
    whatever their names (n_lines and n_dropped are replaced).
    """
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    work_row = "_line_dedup_row"
    base = docs.select(*others, "text")
    key = base.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    drops = dropped_lines(key, batches, min_points)
    text = F.coalesce(F.col("text"), F.lit(""))
    drops = drops.select(F.col("doc_id").alias("_line_dedup_id"), F.col("row").alias("_line_dedup_at"), F.col("dropped").alias("_line_dedup_dropped"))
    rows = base.withColumn("text", text).withColumn(work_row, F.xxhash64("text"))
    rows = rows.join(drops, (F.col("doc_id") == F.col("_line_dedup_id")) & (F.col(work_row) == F.col("_line_dedup_at")), "left")
    lines = F.split("text", "\n")
    rows = rows.withColumn("_line_dedup_lines", F.when(F.col("_line_dedup_dropped").isNotNull(), lines))
    at = F.array_except(F.sequence(F.lit(0), F.size("_line_dedup_lines") - 1), F.col("_line_dedup_dropped"))
    kept = F.array_join(F.transform(at, lambda i: F.get(F.col("_line_dedup_lines"), i)), "\n")
    n_lines = (F.length(F.col("text")) - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long")
    return rows.select(
        *others,
        F.when(F.col("_line_dedup_dropped").isNull(), F.col("text")).otherwise(kept).alias("text"),
        n_lines.alias("n_lines"),
        F.coalesce(F.size("_line_dedup_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup over the whole of ``documents``."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="long", text="string")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
