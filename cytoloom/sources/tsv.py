"""Typed tab-separated tables: everything is text, NA is missing, doubles read back exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NumberError, require

#: Spellings of the format.
MISSING, TRUE, FALSE = "NA", "TRUE", "FALSE"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def write_tsv(df: DataFrame, path: str, packed: bool = True) -> None:
    """A folder of TSV parts with a header; gzip if ``packed``. Doubles are written in Java's shortest exact form."""
    text = [F.when(F.col(f"`{n}`"), TRUE).when(~F.col(f"`{n}`"), FALSE).alias(n) if k == "boolean" else F.col(f"`{n}`").cast("string").alias(n) for n, k in df.dtypes]
    df.select(*text).write.option("sep", "\t").option("header", True).option("nullValue", MISSING).option("emptyValue", "").option("quote", '"').option("escape", '"').option("compression", "gzip" if packed else "none").csv(path)


def read_tsv(spark: SparkSession, path: str, types: dict[str, str] | None = None, check: bool = True) -> DataFrame:
    """All columns as text but those in ``types`` (name -> double, int, bigint, boolean, string).

    With ``check`` a value that isn't one of its type raises (one pass over the table); without, it becomes missing.
    """
    raw = spark.read.option("sep", "\t").option("header", True).option("nullValue", MISSING).option("quote", '"').option("escape", '"').csv(path)
    types = types or {}
    out, wrong = [], []
    for name in raw.columns:
        c, kind = F.col(f"`{name}`"), types.get(name, "string")
        if kind == "boolean":
            out.append(F.when(c == TRUE, True).when(c == FALSE, False).alias(name))
            wrong.append(F.count_if(c.isNotNull() & ~c.isin(TRUE, FALSE)).alias(name))
        elif kind == "string":
            out.append(c)
        else:
            fine = c.rlike(NUMBER) & c.try_cast(kind).isNotNull()
            whole = fine & (c.try_cast("double") == F.floor(c.try_cast("double"))) if kind != "double" else fine
            out.append(F.when(whole, c.try_cast("double").cast(kind) if kind != "double" else c.try_cast("double")).alias(name))
            wrong.append(F.count_if(c.isNotNull() & ~F.coalesce(whole, F.lit(False))).alias(name))
    if check and wrong:
        counts = raw.agg(*wrong).first().asDict()
        bad = {k: v for k, v in counts.items() if v}
        require(not bad, f"values of the wrong type: {bad}", NumberError)
    return raw.select(*out)
