"""Expressions that the operators share. All guard against NULL, NaN and infinities, which Spark orders above numbers."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFINITY = float("inf")
LOCALIZATION_OFFSET = 1e-9


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def finite(c: Column) -> Column:
    """True or false, never NULL."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INFINITY))


def finite_or_null(c: Column) -> Column:
    return F.when(finite(c), c)


def apart(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the column ``name`` passed through a function that Spark leaves out of its generated methods, so that what
    lies before and after a join by it gets methods of its own. The JVM never compiles one of more than 8,000 bytes."""
    return df.withColumn(name, F.get(F.transform(F.array(col(name)), lambda x: x), F.lit(0)))


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def transformed(c: Column, kind: str, cofactor: float | None) -> Column:
    if kind == "asinh":
        return F.asinh(c / F.lit(float(cofactor)))
    return F.log1p(c) if kind == "log1p" else c


def all_true(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in columns), F.lit(True))


def any_true(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in columns), F.lit(False))


def none_true(columns: Iterable[Column]) -> Column:
    """NULL counts as not true."""
    return ~any_true(columns)


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """xmin, xmax, ymin, ymax, bounds included."""
    return x.between(box[0], box[1]) & y.between(box[2], box[3])
