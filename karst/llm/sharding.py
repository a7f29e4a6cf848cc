"""Sharding by extendible hashing: shards split on one more hash bit until each fits a byte limit.

The directory is indexed by the leading bits of a document's hash.  A bucket whose documents exceed the limit
splits on its next bit, others stay as they are, so a shard is the shortest hash prefix that fits.  Buckets split level by level: the
bytes of every cell of ``DEPTH`` bits are summed once, each level sums the cells of the buckets still too large by one bit more, and only these go on.

What ``DEPTH`` bits can't split (rows that share a key, or a directory outgrown) is cut exactly: its rows are ordered by chunks of a second hash
and filled into numbered pieces, piece after piece, each within the limit.  A document larger than the limit has a shard to itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._work import Work, pick

DEPTH = 24
LIMIT_BYTES = 64_000_000
#: Buckets of a level up to this many bits are sent to all tasks: at most so many (a million) rows of 16 bytes.
SENT_BITS = 20


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key's text (null: of the empty text) as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def shards(docs: DataFrame, limit: int = LIMIT_BYTES, depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_bytes, shard_bits, shard_prefix, piece) for every row of ``docs(doc_id, text)``.

    A shard is (shard_bits, shard_prefix, piece): the documents whose hash begins with the shard_bits bits of
    shard_prefix.  piece is 0 but where a prefix of ``depth`` bits still exceeds ``limit`` bytes: pieces are then filled in
    order of (a hash of the row in 16 bits, hash, doc_id, n_bytes), so every shard holds at most ``limit`` bytes or a single document.
    n_bytes is the text's UTF-8 length (null: 0).  Rows with equal or null ids share a hash.  Other columns are ignored; no rows, no shards.
    """
    work = Work(docs.sparkSession, "sharding")
    rows = pick(docs, doc_id="long", text="string").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), key_hash(F.col("doc_id")).alias("hash"))
    rows = work.write(rows.withColumns({"cell": F.shiftright("hash", 60 - depth), "row": F.monotonically_increasing_id()}), "rows")
    open_ = work.write(rows.groupBy("cell").agg(F.sum("n_bytes").alias("n_bytes")), "level")
    leaves = []
    for bits in range(depth + 1):
        prefix = F.shiftright("cell", depth - bits)
        sizes = open_.groupBy(prefix.alias("prefix")).agg(F.sum("n_bytes").alias("size"))
        # at most 2 ** bits buckets
        sizes = F.broadcast(sizes) if bits <= SENT_BITS else sizes
        level = work.write(open_.withColumn("prefix", prefix).join(sizes, "prefix"), f"level-{bits}")
        leaves.append(level.where(F.col("size") <= limit).select("cell", F.lit(bits).alias("bits"), "prefix"))
        open_ = level.where(F.col("size") > limit).select("cell", "n_bytes")
        if open_.isEmpty():
            break
    found = reduce(DataFrame.unionByName, leaves)
    placed = rows.join(found, "cell", "left")
    inside = placed.where("bits IS NOT NULL").select("doc_id", "n_bytes", F.col("bits").alias("shard_bits"), F.col("prefix").alias("shard_prefix"), F.lit(0).cast("long").alias("piece"))
    return inside if open_.isEmpty() else inside.unionByName(_pieces(placed.where("bits IS NULL"), limit, depth))


def _pieces(rows: DataFrame, limit: int, depth: int) -> DataFrame:
    """Cut overfull cells: whole chunks of rows by a running sum over chunk totals, so no task orders a whole cell.

    A row's place is the bytes before it.  A piece begins wherever that place passes a multiple of half the limit,
    which keeps pieces of documents up to half the limit within it; larger documents get pieces of their own.
    """
    half = max(1, limit // 2)
    chunk = rows.withColumn("chunk", F.pmod(F.xxhash64("hash", "doc_id", "n_bytes", "row"), F.lit(1 << 16)))

    def running(part: DataFrame, amount: Column) -> DataFrame:
        """``before``: the sum of ``amount`` over the rows of the cell before each row; a cell has at most 65,536 chunks, a chunk a 65,536th of it."""
        order = Window.partitionBy("cell").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        totals = part.groupBy("cell", "chunk").agg(F.sum(amount).alias("t"))
        base = totals.select("cell", "chunk", F.coalesce(F.sum("t").over(order), F.lit(0)).alias("base"))
        within = Window.partitionBy("cell", "chunk").orderBy("hash", "doc_id", "n_bytes", "row").rowsBetween(Window.unboundedPreceding, -1)
        return part.withColumn("run", F.coalesce(F.sum(amount).over(within), F.lit(0))).join(base, ["cell", "chunk"]).withColumn("before", F.col("base") + F.col("run"))

    small = running(chunk.where(F.col("n_bytes") <= half), F.col("n_bytes")).withColumn("piece", -F.floor(F.col("before") / half).cast("long") - 1)
    large = running(chunk.where(F.col("n_bytes") > half), F.lit(1).cast("long")).withColumn("piece", F.col("before") + 1)
    cols = ["doc_id", "n_bytes", F.lit(depth).alias("shard_bits"), F.col("cell").alias("shard_prefix"), "piece"]
    return small.select(*cols).unionByName(large.select(*cols))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of at most 64 MB of text over the whole of ``documents``."""
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("shard_bits", F.col("shard_bits").cast("int"))


ORACLE_SQL = rf"""
WITH r AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash FROM documents),
p AS (SELECT r.*, b.bits, hash >> (60 - b.bits) AS prefix FROM r CROSS JOIN (SELECT unnest(range(0, {DEPTH + 1})) AS bits) b),
s AS (SELECT bits, prefix, sum(n_bytes) AS size FROM p GROUP BY 1, 2),
f AS (SELECT p.doc_id, p.n_bytes, p.bits, p.prefix, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.bits) AS k
      FROM p JOIN s USING (bits, prefix) WHERE s.size <= {LIMIT_BYTES})
SELECT doc_id, n_bytes, CAST(bits AS INTEGER) AS shard_bits, CAST(prefix AS BIGINT) AS shard_prefix, CAST(0 AS BIGINT) AS piece
FROM f WHERE k = 1
"""
