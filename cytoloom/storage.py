"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values (rows times columns) of a table made from driver rows that may be broadcast; larger ones are joined by shuffle.
BROADCAST_VALUES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset (tests, a single machine), one of our own."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cytoloom-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what it took is not done twice, lineage ends there, and readers
    take only the columns that they need."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cytoloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast where the counted ``rows`` are within the bound; beyond it Spark chooses by the sizes it finds."""
    return F.broadcast(df) if rows * max(1, len(df.columns)) <= BROADCAST_VALUES else df
