"""Adapters from plain tables to cell tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prepare import CellTable, cell_table


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_REST = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def slide_lineitem(spark: SparkSession, folder: str) -> CellTable:
    """Images: return flag and line status. The key columns repeat, so a number among equal keys is part of the id."""
    numbered = table(spark, folder, "lineitem").selectExpr("*", f"row_number() over (partition by {', '.join(LINE_KEY)} order by {', '.join(LINE_REST)}) as k")
    df = numbered.select(
        F.concat("l_returnflag", "l_linestatus").alias("image_id"), F.concat_ws(":", *LINE_KEY, "k").alias("cell_id"), F.col("l_partkey").cast("double").alias("x"), F.col("l_suppkey").cast("double").alias("y"),
        F.col("l_quantity").alias("cell:QTY:mean"), (F.col("l_quantity") - 25).alias("cytoplasm:QTY:mean"), F.col("l_extendedprice").alias("cell:PRICE:mean"), F.col("l_discount").alias("cell:DISC:mean"), F.col("l_tax").alias("cell:TAX:mean"),
        F.col("l_discount").alias("nucleus:TAX:mean"), F.col("l_tax").alias("cytoplasm:TAX:mean"),
    )
    return cell_table(df)


def slide_events(spark: SparkSession, folder: str) -> CellTable:
    k = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    return cell_table(table(spark, folder, "events").select(F.col("event_type").alias("image_id"), F.col("event_id").alias("cell_id"), F.col("user_id").cast("double").alias("x"), k.alias("y"), F.col("value").alias("cell:VALUE:mean")))


def slide_customer(spark: SparkSession, folder: str) -> CellTable:
    """Balances are partly negative, so signals are missing."""
    return cell_table(table(spark, folder, "customer").select(F.col("c_mktsegment").alias("image_id"), F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").cast("double").alias("x"), F.col("c_custkey").cast("double").alias("y"), F.col("c_acctbal").alias("cell:BAL:mean")))


def slide_part(spark: SparkSession, folder: str) -> CellTable:
    return cell_table(table(spark, folder, "part").select(F.col("p_brand").alias("image_id"), F.col("p_partkey").alias("cell_id"), F.col("p_size").cast("double").alias("x"), F.col("p_partkey").cast("double").alias("y"), F.col("p_size").cast("double").alias("cell:SIZE:mean"), F.col("p_retailprice").alias("cell:RETAIL:mean")))


def slide_embeddings(spark: SparkSession, folder: str, n: int = 8) -> CellTable:
    value = lambda k: F.col("embedding")[k].cast("double")
    return cell_table(table(spark, folder, "embeddings").select(F.lit("all").alias("image_id"), F.col("vec_id").alias("cell_id"), (value(0) * 100).alias("x"), (value(1) * 100).alias("y"), F.col("label"), *((value(k) + 1).alias(f"cell:E{k}:mean") for k in range(n))))
