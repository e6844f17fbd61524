"""What the operators share: the shared folder, lineage cuts, text columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contracts: ASCII letters that are lower-cased, and what separates words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\f\r"


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


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cytoloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and lost executors cost no recomputation.
    The tables stay for whoever reads the result, until ``release`` or ``clear``."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clear(spark: SparkSession) -> None:
    """Deletes everything that the operators of this application stored; call it when their results have been written."""
    remove(spark, f"{shared_dir(spark)}/cytoloom/{spark.sparkContext.applicationId}")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of ``df``, one for each of ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a few numbers that may be broadcast, some tens of megabytes; beyond them a join shuffles.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame) -> DataFrame:
    """A stored ``df`` of narrow rows, broadcast if its counted rows are within BROADCAST_ROWS, so that a join with texts
    moves no text; beyond that Spark joins by sizes."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Of a table's rows a key may hold one in HOT before its rows are dealt over SALTS parts.
HOT, SALTS = 1000, 64


def join_by_class(rows: DataFrame, classes: DataFrame, key: str, spread: Column) -> DataFrame:
    """``rows`` with the columns of ``classes``, which has one row for each ``key`` and its number of rows, n (dropped).

    Keys with over a thousandth of all rows, at most HOT of them, are broadcast; their rows are dealt by ``spread``
    over SALTS parts, and their class goes to each part, so a key with a third of all rows fills no task.
    """
    total = classes.agg(F.sum("n")).first()[0] or 0
    hot = classes.where(F.col("n") * HOT > total).select(key, F.lit(True).alias("_hot"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(spread, F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    parts = F.when(F.col("n") * HOT > total, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(classes.withColumn("_salt", F.explode(parts)).drop("n"), [key, "_salt"]).drop("_salt")
