"""Connected components by alternating star steps, each round cut off by a checkpoint."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpoint_ready(df: DataFrame) -> None:
    """Takes the folder of spark.checkpoint.dir; sets one of our own only on a single machine where it is unset."""
    context = df.sparkSession.sparkContext
    if context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir():
        return
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="cytoloom-"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each component, for nodes of edges (a, b) of longs."""
    checkpoint_ready(edges)
    now = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        outward = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        lowest = outward.groupBy("b").agg(F.min("a").alias("m"))
        inward = outward.join(lowest, "b").where("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(lowest.select(F.col("m").alias("x"), F.col("b").alias("y")))
        now = inward.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct().checkpoint()
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    tips = now.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("label")))
    return tips.groupBy("node").agg(F.min("label").alias("label"))
