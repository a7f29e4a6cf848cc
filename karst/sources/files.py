"""Readers of the engine's files, and the reshaping they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model


def geo_csv(spark: SparkSession, path: str) -> DataFrame:
    """The country dimension; names may be quoted; pos is the order of codes, which is the file's order."""
    rows = spark.read.schema("country_name string, country_code string, region string").option("header", True).csv(path)
    codes = F.sort_array(F.collect_set("country_code"))
    order = rows.agg(codes.alias("codes"))
    return rows.crossJoin(order).select("country_code", "country_name", "region", (F.array_position("codes", F.col("country_code")) - 1).cast("int").alias("pos"))


def indicators_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(model.INDICATORS).option("header", True).csv(path)


def paraphrases_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(model.PARAPHRASES).option("multiLine", True).json(path)


def examples_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(model.EXAMPLE).json(path)


def runs_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Run files; ``run`` is the file's stem."""
    rows = spark.read.schema(model.RUN).json(path)
    return rows.select("*", F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl?$", "").alias("run"))


def graph_xml(spark: SparkSession, path: str, tag: str = "edge") -> DataFrame:
    """Nodes or edges of GEXF files (``tag`` node or edge)."""
    return spark.read.format("xml").option("rowTag", tag).load(path)


def gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GEXF documents in folders graph_id=...: nodes(graph_id, node_id, label, attributes), edges(graph_id, src, dst, label).

    ``attributes`` maps the attributes' titles to their values.
    """
    # the folder's name is escaped, and escaped again in the file's address
    graph = F.url_decode(F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"graph_id=([^/]+)/", 1))).alias("graph_id")
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(f"{path}/graph_id=*")
    titles = read("attribute", "_id string, _title string").select(graph, F.col("_id").alias("k"), F.col("_title").alias("title")).distinct()
    node = read("node", "_id string, _label string, attvalues struct<attvalue: array<struct<_for: string, _value: string>>>")
    node = node.select(graph, F.col("_id").alias("node_id"), F.col("_label").alias("label"), F.col("attvalues.attvalue").alias("a"))
    each = node.select("graph_id", "node_id", F.explode("a").alias("x")).select("graph_id", "node_id", F.col("x._for").alias("k"), F.col("x._value").alias("v")).join(titles, ["graph_id", "k"])
    own = each.groupBy("graph_id", "node_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("title", "v")))).alias("attributes"))
    edge = read("edge", "_source string, _target string, _label string").select(graph, F.col("_source").alias("src"), F.col("_target").alias("dst"), F.col("_label").alias("label"))
    return node.drop("a").join(own, ["graph_id", "node_id"], "left"), edge


def wide_csv(spark: SparkSession, path: str, indicators: list[str] | None = None) -> DataFrame:
    """Long observations of wide indicator files (one file an indicator, a column a year, ragged headers).

    ``indicators`` names the files to read; the others are not opened.

    Files are read as lines, and each line meets its own file's header: reading them together as CSV would
    bind columns by the first file's header.  Cells hold no quotes.
    """
    paths = path if indicators is None else [f"{path}/{i}.csv" for i in indicators]
    lines = spark.read.text(paths).select("value", F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "").alias("indicator_code"))
    lines = lines.withColumn("cells", F.split("value", ",", -1))
    header = lines.where("startswith(value, 'country_code')").select("indicator_code", F.col("cells").alias("years"))
    body = lines.where("NOT startswith(value, 'country_code')").join(header, "indicator_code")
    pair = F.explode(F.arrays_zip(F.slice("years", 2, F.size("years") - 1).alias("y"), F.slice("cells", 2, F.size("cells") - 1).alias("v")))
    cell = body.select("indicator_code", F.get("cells", F.lit(0)).alias("country_code"), pair.alias("c"))
    return cell.select("indicator_code", "country_code", F.col("c.y").cast("int").alias("year"), F.nullif("c.v", F.lit("")).try_cast("double").alias("value"))


def links(pages: DataFrame, prefix: str) -> DataFrame:
    """(page_id, link): hrefs of ``pages(page_id, html)`` that begin with prefix and have two slashes, without what follows ``?``."""
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"""href=["']([^"']+)["']"""), F.lit(1))).alias("href"))
    bare = F.substring_index("href", "?", 1)
    return found.where(F.startswith("href", F.lit(prefix)) & (F.length(bare) - F.length(F.replace(bare, F.lit("/"), F.lit(""))) == 2)).select("page_id", bare.alias("link"))


def pivot_wide(observations: DataFrame, years: list[int]) -> DataFrame:
    """A column a year (mean of repeated cells); ``years`` are given, so no job looks for them."""
    return observations.groupBy("indicator_code", "country_code").pivot("year", years).agg(F.avg("value"))


def unpivot_long(wide: DataFrame, keys: list[str]) -> DataFrame:
    columns = [c for c in wide.columns if c not in keys]
    return wide.unpivot(keys, columns, "year", "value").where("value IS NOT NULL").withColumn("year", F.col("year").cast("int"))


def region_backoff(rows: DataFrame, *columns: str) -> DataFrame:
    """``region``: the first of the columns that is there."""
    return rows.withColumn("region", F.coalesce(*(F.col(c) for c in columns)))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key, the new one where both have it: one full join, no ranking."""
    value = [c for c in old.columns if c != key]
    o = old.select(key, F.struct(*value).alias("_o"))
    n = new.select(key, F.struct(*value).alias("_n"))
    return o.join(n, key, "full").select(key, F.coalesce("_n", "_o").alias("_v")).select(key, "_v.*")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not done yet (incremental fetches and resumed runs)."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
