"""Canonical JSON and digests of driver-side objects; digests of tables that do not depend on row order."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InputError, NumberError
from ..session import ready


def number_text(x: float) -> str:
    """Integers without fraction below 2**53, else 15 significant digits if they read back the same, else 17."""
    if math.isnan(x) or math.isinf(x):
        raise InputError("JSON has no such number")
    if x == int(x) and abs(x) < 2**53:
        return str(int(x))
    short = f"{x:.15g}"
    return short if float(short) == x else f"{x:.17g}"


def canonical(value: Any) -> str:
    """JSON with sorted keys, no blanks and one spelling for each number."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return number_text(float(value)) if isinstance(value, float) or abs(value) < 2**53 else str(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    raise InputError(f"JSON has no {type(value).__name__}")


def sha256(value: Any) -> str:
    """Hex digest of text, bytes, or the canonical JSON of anything else."""
    data = value if isinstance(value, bytes) else (value if isinstance(value, str) else canonical(value)).encode()
    return hashlib.sha256(data).hexdigest()


def parse_double(text: str) -> float:
    if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
        raise NumberError(f"{text!r} is no decimal number")
    return float(text)


def parse_integer(text: str) -> int:
    value = parse_double(text)
    if value != int(value):
        raise NumberError(f"{text!r} is no whole number")
    return int(value)


def parse_logical(text: str) -> bool:
    if text not in ("TRUE", "FALSE"):
        raise NumberError(f"{text!r} is neither TRUE nor FALSE")
    return text == "TRUE"


def typed_rows(df: DataFrame) -> DataFrame:
    """One text for a row: every field with its type and byte length, so that no two rows share it; -0.0 counts as 0.0.

    Fields are turned into text in a projection of their own, each once: in one expression with their lengths they make a
    method too large for the JVM to compile.
    """
    kinds = dict(df.dtypes)

    def text(name: str) -> Column:
        c = F.col(f"`{name}`")
        return (F.when(c == 0, F.lit(0.0)).otherwise(c) if kinds[name] in ("double", "float") else c).cast("string").alias(name)

    parts = []
    for name, kind in kinds.items():
        c = F.col(f"`{name}`")
        parts.append(F.coalesce(F.concat(F.lit(f"{name}|{kind}|"), F.octet_length(c).cast("string"), F.lit(":"), c, F.lit(";")), F.lit(f"{name}|{kind}|-;")))
    return df.select(*map(text, kinds)).select((F.concat(*parts) if parts else F.lit("")).alias("row"))


def word_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The count of a task's digests and the sums of their eight words, as text; nothing for a task without rows."""
    n, sums = 0, [0] * 8
    for batch in batches:
        if not batch.num_rows:
            continue
        digests = batch.column(0).cast(pa.binary(32))
        words = np.frombuffer(digests.buffers()[1], ">u4", 8 * len(digests), 32 * digests.offset).reshape(-1, 8).sum(axis=0, dtype=np.uint64)
        n, sums = n + len(digests), [a + int(b) for a, b in zip(sums, words, strict=True)]
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([str(x)]) for x in (n, *sums)], names=["n", *(f"w{k}" for k in range(8))])


def table_digest(df: DataFrame) -> str:
    """SHA-256 over the schema, the row count and the sums of the rows' digests, in eight words of 32 bits.

    Sums do not depend on order or partitioning, count repeated rows, and merge map-side; nothing but one row is
    brought to the driver. Rows are hashed by Spark; the words are cut and added in Arrow batches, as Spark reads
    numbers from hex texts a digit at a time.
    """
    ready(df.sparkSession)
    names = sorted(df.columns)
    rows = typed_rows(df.select(*(F.col(f"`{n}`") for n in names))).select(F.unhex(F.sha2("row", 256)).alias("h"))
    parts = rows.mapInArrow(word_sums, ", ".join(f"{c} string" for c in ("n", *(f"w{k}" for k in range(8)))))
    n, *sums = parts.agg(*(F.sum(F.col(c).cast("decimal(38,0)")) for c in parts.columns)).first()
    kinds = dict(df.dtypes)
    return sha256({"columns": [[c, kinds[c]] for c in names], "sums": [str(x) for x in (n or 0, *sums)]})


def fingerprint(df: DataFrame) -> str:
    """A quick binding of a table's content: schema, row count and the sum of the rows' 64-bit hashes, in one pass. Like
    ``table_digest`` it does not depend on order; it tells tables apart, but does not withstand forgery."""
    names = sorted(df.columns)
    columns = [F.when(c == 0, F.lit(0.0)).otherwise(c) if dict(df.dtypes)[n] in ("double", "float") else c for n, c in ((n, F.col(f"`{n}`")) for n in names)]
    marks = [F.concat(*(F.when(c.isNull(), "1").otherwise("0") for c in columns))] if columns else [F.lit("")]
    got = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns, *marks).cast("decimal(38,0)"))).first()
    kinds = dict(df.dtypes)
    return sha256({"columns": [[n, kinds[n]] for n in names], "sums": [str(x) for x in got]})


def cell_key(image: str = "image_id", cell: str = "cell_id") -> Column:
    """Both ids in one text, each after its byte length."""
    return F.concat(*(p for c in (image, cell) for p in (F.octet_length(c).cast("string"), F.lit(":"), F.col(c))))
