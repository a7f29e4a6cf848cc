"""Cells kept by key: the cube stored once, so that questions meet it where it lies.

``series`` (a country's values of an indicator by year) are bucketed and sorted by indicator and country, ``vectors`` (a region's values of an indicator and
year) by indicator, region and year, which are all that joins compare; both are in partitions by a hash of the indicator.  A join on these keys shuffles the questions only,
and reads only the partitions that the questions' indicators are in: their numbers, at most ``PARTS``, are broadcast and prune the scan while it runs.
"""

from __future__ import annotations

import atexit
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cells import Cube
from ..session import ensure_checkpoint_dir

PARTS = 64


def part_of(indicator: str | Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(indicator), F.lit(parts)).cast("int")


@dataclass(frozen=True)
class KeyedCube(Cube):
    """A cube whose series and vectors are read from tables; ``series`` and ``vectors`` take the rows that ask, for pruning."""

    name: str
    parts: int

    @property
    def _spark(self) -> SparkSession:
        return self.geo.sparkSession

    def _read(self, what: str, asked: DataFrame | None) -> DataFrame:
        table = self._spark.table(f"{self.name}_{what}")
        if asked is not None:
            # one row a partition at most; the comparison tells the optimizer that this is worth pruning by
            wanted = asked.select(part_of("property", self.parts).alias("part")).where("part >= 0").distinct()
            table = table.join(F.broadcast(wanted), "part", "left_semi")
        return table.drop("part")

    def series(self, asked: DataFrame | None = None) -> DataFrame:
        return self._read("series", asked)

    def vectors(self, asked: DataFrame | None = None) -> DataFrame:
        return self._read("vectors", asked)

    def values(self, asks: DataFrame) -> DataFrame:
        """``asks(country_code, indicator_code, year)`` with ``value``, null where the cell is empty."""
        asked = asks.select(F.col("indicator_code").alias("property"))
        got = asks.join(self.series(asked), ["indicator_code", "country_code"], "left")
        return got.withColumn("value", F.try_element_at("by_year", F.col("year"))).drop("by_year")

    def update(self, observations: DataFrame) -> None:
        """Put new cells in, over old ones of the same place; only the partitions of their indicators are written again."""
        new = Cube(self.geo, observations)
        self._merge("series", new.series(), ["indicator_code", "country_code"], "by_year")
        self._merge("vectors", new.vectors(), ["indicator_code", "region", "year"], "have")

    def _merge(self, what: str, new: DataFrame, key: list[str], cells: str) -> None:
        ensure_checkpoint_dir(self._spark)
        new = new.withColumnRenamed(cells, "_new")
        old = self._read(what, new.select(F.col("indicator_code").alias("property")))
        kept = F.map_filter(cells, lambda k, _: ~F.coalesce(F.map_contains_key("_new", k), F.lit(False)))
        both = F.coalesce(F.map_concat(kept, "_new"), "_new", cells)
        merged = old.join(new, key, "full").withColumn(cells, both).drop("_new").withColumn("part", part_of("indicator_code", self.parts))
        # the partitions that are read are replaced, so the rows are put aside first
        merged = merged.select(*self._spark.table(f"{self.name}_{what}").columns).checkpoint()
        conf, mode = self._spark.conf, "spark.sql.sources.partitionOverwriteMode"
        before = conf.get(mode)
        conf.set(mode, "dynamic")  # inserts know this as a setting only
        try:
            merged.write.mode("overwrite").insertInto(f"{self.name}_{what}")
        finally:
            conf.set(mode, before)

    def drop(self) -> None:
        for what in ("series", "vectors"):
            self._spark.sql(f"DROP TABLE IF EXISTS {self.name}_{what}")


def keep(cube: Cube, name: str | None = None, parts: int = PARTS, buckets: int | None = None) -> KeyedCube:
    """Store the cube's series and vectors as tables ``<name>_series`` and ``<name>_vectors`` in the warehouse.

    ``buckets`` should be at least the number of shuffle partitions, which is the default: with fewer, joins would shuffle the cube after all.
    Without a name the tables are dropped at the end of the application.
    """
    spark = cube.geo.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = KeyedCube(cube.geo, cube.observations, name or f"karst_{uuid.uuid4().hex}", parts)
    for what, df, key in (("series", cube.series(), ("indicator_code", "country_code")), ("vectors", cube.vectors(), ("indicator_code", "region", "year"))):
        rows = df.withColumn("part", part_of("indicator_code", parts)).repartition(buckets, *key)
        rows.write.mode("overwrite").partitionBy("part").bucketBy(buckets, *key).sortBy(*key).format("parquet").saveAsTable(f"{kept.name}_{what}")
    if name is None:
        atexit.register(forget, kept)
    return kept


def forget(kept: KeyedCube) -> None:
    """Drop the tables; silent once the session has ended."""
    try:
        kept.drop()
    except Exception:  # noqa: BLE001  the session may be gone at interpreter exit
        pass
