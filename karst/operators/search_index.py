"""Keyword search by an inverted index that is kept: the catalogue's names are taken apart when they come, not at every query.

``<name>_docs`` holds the catalogue's rows with a number each, ``<name>_postings`` for every word of a name the places of its rows, sorted, in one array for each
block of numbers (the rows that one task wrote, so no array grows with the catalogue).  Both are in segments, one a batch that was added.  Rows that
a later batch replaces are listed in ``<name>_gone``.  Postings are bucketed by word and docs by number, so a search shuffles what is asked and found, not the index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from .lookup import asked_words

#: A row's number is its block times this, and its place in the block; a whole name is a word of its own behind a mark that no word begins with.
_BLOCK = 1 << 33
_WHOLE = " "


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    name: str

    def _table(self, what: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{what}")

    def _put(self, rows: DataFrame, what: str, by: str) -> None:
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if self.spark.catalog.tableExists(f"{self.name}_{what}"):
            rows.select(*self._table(what).columns).write.mode("append").insertInto(f"{self.name}_{what}")
        else:
            rows.write.partitionBy("segment").bucketBy(buckets, by).sortBy(by).format("parquet").saveAsTable(f"{self.name}_{what}")

    def add(self, indicators: DataFrame) -> int:
        """Add a batch of indicators(id, name, description) as a segment; those with an id that is there replace it.  Returns the segment's number.

        Of equal ids within a batch all stay, as in the catalogue that a search without an index reads.
        """
        first = not self.spark.catalog.tableExists(f"{self.name}_docs")
        segment = 0 if first else 1 + (self._table("docs").agg(F.max("segment")).first()[0] or 0)
        rows = indicators.select(F.col("id").alias("indicator_code"), F.col("name").alias("indicator_name"), F.col("description").alias("indicator_description"))
        # numbers of a segment follow those before it: a block is a task of the write, of which there are fewer than 2^20
        number = F.monotonically_increasing_id() + F.lit(segment * (1 << 53))
        self._put(rows.select(number.alias("doc"), "*", F.lit(segment).alias("segment")), "docs", "doc")
        docs = self._table("docs").where(F.col("segment") == segment)
        if not first:
            old = self._table("docs").where(F.col("segment") < segment).select("doc", "indicator_code")
            gone = docs.select("indicator_code").distinct().join(old, "indicator_code").select("doc", F.lit(segment).alias("segment"))
        else:
            gone = docs.limit(0).select("doc", "segment")
        self._put(gone, "gone", "doc")
        terms = F.array_union(words(F.col("indicator_name"), "(),"), F.array(F.concat(F.lit(_WHOLE), F.lower("indicator_name"))))
        each = docs.where("indicator_name IS NOT NULL").select(F.explode(terms).alias("token"), F.floor(F.col("doc") / _BLOCK).alias("block"), (F.col("doc") % _BLOCK).cast("int").alias("place"))
        lists = each.groupBy("token", "block").agg(F.sort_array(F.collect_list("place")).alias("places")).withColumn("segment", F.lit(segment))
        self._put(lists, "postings", "token")
        return segment

    def _rows(self, asked: DataFrame, token: Column) -> DataFrame:
        """``asked`` with the live catalogue rows that hold the token."""
        hits = asked.withColumn("token", token).join(self._table("postings").drop("segment"), "token")
        hits = hits.withColumn("place", F.explode("places")).withColumn("doc", F.col("place") + F.col("block") * F.lit(_BLOCK)).drop("token", "block", "places", "place")
        return hits.join(self._table("gone").select("doc"), "doc", "left_anti").join(self._table("docs").drop("segment"), "doc").drop("doc")

    def search(self, args: DataFrame, key: str = "query_id", arg: str = "keywords") -> DataFrame:
        """The rows of ``lookup.search_names`` for the same catalogue."""
        out = [key, "keyword_no", "keyword", "indicator_code", "indicator_name", "indicator_description"]
        whole = self._rows(args.select(key, F.lit(0).alias("keyword_no"), F.col(arg).alias("keyword")), F.concat(F.lit(_WHOLE), "keyword")).select(*out)
        rest = args.join(whole.select(key).distinct(), key, "left_anti")
        return whole.unionByName(self._rows(asked_words(rest, key, arg), F.lower("keyword")).select(*out))

    def merge(self) -> SearchIndex:
        """A new index of the live rows in one segment, under the name with ``_m`` added; the old one stays."""
        new = SearchIndex(self.spark, f"{self.name}_m")
        live = self._table("docs").join(self._table("gone").select("doc"), "doc", "left_anti")
        new.add(live.select(F.col("indicator_code").alias("id"), F.col("indicator_name").alias("name"), F.col("indicator_description").alias("description")))
        return new

    def drop(self) -> None:
        for what in ("docs", "gone", "postings"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{what}")
