"""The test tables as the engine's own kinds of table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ROW


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    xyz = [F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("XYZ")]
    return e.select(F.col("vec_id").cast("long").alias(ROW), *xyz, (F.col("label") + 1).cast("double").alias("mass"))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem")
    return item.select(
        F.col("l_quantity").cast("double").alias("X"), (F.col("l_extendedprice").cast("double") / 1000).alias("Y"),
        (F.col("l_discount").cast("double") * 100).alias("Z"), F.col("l_tax").cast("double").alias("mass"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias(ROW), F.col("o_totalprice").cast("double").alias("price"), F.col("o_custkey").cast("double").alias("cust"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias(ROW), F.col("p_retailprice").cast("double").alias("price"), F.col("p_size").cast("double").alias("size"))
