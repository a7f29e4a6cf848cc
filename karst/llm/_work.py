"""Intermediate tables in the folder all executors share.

``spark.checkpoint.dir`` names that folder; a cluster must have it.  Only where the master is local (tests) and it is unset a
temporary folder of this machine is used, which is the one machine there is.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Work:
    """A folder of written tables; each cuts the lineage, so a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        root = root or spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="karst-")
            spark.sparkContext.setCheckpointDir(root)
        self.spark = spark
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
        """Write and read back; a table known to be small is written by ``parts`` tasks, so that it has no more files."""
        (df.coalesce(parts) if parts else df).write.mode("overwrite").parquet(self.path(name))
        return self.read(name, df)

    def parts(self, rows: int, each: int = 200_000) -> int:
        """How many tasks should write so many rows."""
        return max(1, min(parallelism(self.spark), -(-rows // each)))

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, name: str | None = None) -> None:
        """Remove one table, or everything; silent once the session has ended."""
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may be gone at interpreter exit
            if name:
                raise


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written here drops its shuffle files as soon as it is there, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def parallelism(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: A table of narrow rows is sent to all executors if it has at most so many, counted first; else it is shuffled.
BROADCAST_ROWS = 1_000_000


def send_if_small(narrow: DataFrame) -> DataFrame:
    """The written table ``narrow``, marked for broadcast behind a count of its rows."""
    return F.broadcast(narrow) if narrow.count() <= BROADCAST_ROWS else narrow


#: Bits of the bitmap by which ``maybe_in`` knows ids, in words of 64.
BITMAP_BITS = 1 << 26


def maybe_in(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is among those of ``ids``, and a few others whose hash is; rows are neither shuffled nor sent.

    What goes to the executors is a bitmap of the ids' hashes, at most BITMAP_BITS / 64 words of it (a million), whatever the number of
    ids; with that many ids as bits, most rows pass.  A join by key, of what is made of the rows, leaves the wanted ones.
    """
    at = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(BITMAP_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    word = F.floor(at / 64).cast("long")
    words = ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return rows.withColumn("_word", word).join(F.broadcast(words), "_word").where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names and types; further columns, whatever their names, are left out.

    ``columns`` maps each wanted name to its type; a missing column is an error of the caller.
    """
    return df.select(*(df[c].cast(t).alias(c) for c, t in columns.items()))


#: Rows of one Arrow batch: texts can be long, and a batch is held by the JVM and by Python at once.
ARROW_ROWS = 1000


def ship(spark: SparkSession) -> SparkSession:
    """Make the session ready for Python operators.

    This package's source is sent to the executors, once per application, so they need no installation of it, and Arrow
    batches are limited to ARROW_ROWS rows.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        # read when a plan is executed, which is after the operator returns, so it stays set
        spark.conf.set(name, str(ARROW_ROWS))
    context = spark.sparkContext
    if getattr(context, "_karst_shipped", False):
        return spark
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="karst-")) / "karst_src.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    context._karst_shipped = True
    return spark
