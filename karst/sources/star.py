"""The star schema (orders, customer, nation, region) seen as an observation cube."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cells import Cube


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("n_nationkey").cast("string").alias("country_code"), F.col("n_name").alias("country_name"), F.col("r_name").alias("region"), F.col("n_nationkey").cast("int").alias("pos"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total price of finished orders by indicator (priority|segment), customer's nation and year."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderpriority", "o_totalprice", F.year("o_orderdate").alias("year"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    grouped = joined.groupBy(F.concat_ws("|", "o_orderpriority", "c_mktsegment").alias("indicator_code"), F.col("c_nationkey").cast("string").alias("country_code"), "year")
    return grouped.agg(F.round(F.sum("o_totalprice"), 5).alias("value")).select("indicator_code", "country_code", "year", "value")


def cube(spark: SparkSession, sf_dir: str) -> Cube:
    return Cube(geo(spark, sf_dir), observations(spark, sf_dir))
