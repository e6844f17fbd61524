"""URL rules by a sort-merge range join.

A url is reduced to host and path. The canonical key of a host is its labels in reverse, each closed by U+0000 (which is
escaped within labels), so that a host with all its subdomains is one interval of keys, and rules' intervals are nested
or apart. Both sides are cut into the same key ranges, sorted, and swept once: a stack holds the rules whose interval is
open at the url's key, outermost first. The path rules of an open host are intervals as well: sorted, each with a link to
the one that it is nested in, so the longest that starts a path is found by bisection and a walk up its nesting, never by
trying rules in turn. Over the open hosts the longest rule (host and path together) wins, then the one with the longer
host, then block before allow.

Ranges: boundaries come from a bounded sample of url keys (SAMPLE for each range; it only sets how even ranges are). A
rule enters every range that its interval touches. A key that fills several ranges (a hot host) is dealt over them by
page, and its rules enter all of them. Within a range everything streams but the path rules of the hosts open at a time.

Nulls: a url that is null or has no :// has empty host and path, fits no rule and gets the default verdict. A rule with
null or empty host is ignored, a null path is empty, and of equal rules with both verdicts block counts. Hosts may hold
blanks, control characters, empty labels and dots at their ends: only whole labels are compared. Repeated pages come out
as often as they come in. The columns ``ids`` of any type pass; host, path, rule and verdict get underscores where an id
has such a name. Empty tables give no rows, or the default verdict for all.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import ready
from .common import ascii_lower, fresh

SAMPLE = 40
#: The rules of the query's contract.
CONTRACT_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
LABEL_END, ABOVE, ESCAPED = "\x00", "\x01", "\x02"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    """Labels from the last to the first, each followed by LABEL_END, which labels hold in another form only."""
    free = F.replace(F.replace(host, F.lit(ABOVE), F.lit(ABOVE + ESCAPED)), F.lit(LABEL_END), F.lit(ABOVE + ABOVE))
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(free, r"\.")), LABEL_END), F.lit(LABEL_END)))


def _boundaries(urls: DataFrame, ranges: int) -> list[str]:
    """Up to ranges - 1 keys; equal ones mark a hot key."""
    total = urls.count()
    share = min(1.0, SAMPLE * ranges / max(total, 1))
    chosen = sorted(r.key for r in urls.select("key", F.xxhash64("key", "id").alias("h")).where(F.expr(f"pmod(h, 1000003) < {int(share * 1000003) + 1}")).select("key").limit(4 * SAMPLE * ranges).collect())
    return [chosen[len(chosen) * k // ranges] for k in range(1, ranges)] if chosen else []


class OpenHost:
    """The path rules of a host whose interval is open, in ascending order of their paths, and for each the one that it is
    nested in."""

    def __init__(self, key: str):
        self.key, self.paths, self.rules, self.within = key, [], [], []

    def add(self, path: str, verdict: str, text: str) -> None:
        if self.paths and self.paths[-1] == path:
            if verdict == "block":
                self.rules[-1] = (verdict, text)
            return
        k = len(self.paths) - 1
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.within[k]
        self.paths.append(path)
        self.rules.append((verdict, text))
        self.within.append(k)

    def longest(self, path: str) -> int:
        """The number of the longest rule that starts ``path``, or -1. What sorts between a prefix of a text and the text
        starts with that prefix, so all candidates are among those that the last one not above it is nested in."""
        k = bisect_right(self.paths, path) - 1
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.within[k]
        return k


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Rows of a task sorted by range, key, side (rules first) and path; the pages' rows leave with rule and verdict."""
    stack: list[OpenHost] = []  # hosts with open intervals
    here = None
    for batch in batches:
        pages, found = [], []
        for at, (area, key, side, path, verdict, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("area", "key", "side", "path", "verdict", "text")), strict=True)):
            if area != here:
                here, stack = area, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if side == 0:
                if not stack or stack[-1].key != key:
                    stack.append(OpenHost(key))
                stack[-1].add(path, verdict, text)
                continue
            best = None
            for host in stack:
                k = host.longest(path)
                # an inner host's rule wins a tie
                if k >= 0 and (best is None or len(host.key) + len(host.paths[k]) >= best[0]):
                    best = (len(host.key) + len(host.paths[k]), host.rules[k])
            pages.append(at)
            found.append(best[1] if best else (default, None))
        yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(pages, pa.int64())), pa.array([f[1] for f in found], pa.string()), pa.array([f[0] for f in found], pa.string())], names=["row", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, ids: list[str], url: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """ids..., host, path, rule, verdict for each row of ``pages``. rules: (verdict, host, path)."""
    spark = ready(pages.sparkSession)
    ranges = ranges or max(1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    chosen = pages.select(*(F.col(f"`{c}`") for c in ids))
    names = [*chosen.columns, *fresh(chosen, "host", "path", "rule", "verdict")]
    address = F.col(f"`{url}`").cast("string")
    # ids under numbers, so that no two names clash
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(ids)), host_of(address).alias("host"), path_of(address).alias("path"))
    spread = [F.col(f"`{c}`").cast("string") if "map<" in f.dataType.simpleString() else F.col(f"`{c}`") for c, f in zip(ids, chosen.schema.fields, strict=True)]
    urls = pages.select(key_of(host_of(address)).alias("key"), row.alias("row"), path_of(address).alias("path"), F.xxhash64(address, *spread).alias("id"))
    bounds = _boundaries(urls.select("key", "id"), ranges)
    hot = {b for b in bounds if bounds.count(b) > 1}

    @F.arrow_udf("int")
    def area_of(key: pa.Array, spread: pa.Array) -> pa.Array:
        out = []
        for k, s in zip(key.to_pylist(), spread.to_pylist(), strict=True):
            low, high = bisect_left(bounds, k), bisect_right(bounds, k)
            out.append(low + s % (high - low + 1) if k in hot else high)
        return pa.array(out, pa.int32())

    @F.arrow_udf("array<int>")
    def areas_of(key: pa.Array) -> pa.Array:
        spans = ((bisect_left(bounds, k), bisect_right(bounds, k[:-1] + ABOVE)) for k in key.to_pylist())
        return pa.array([list(range(a, b + 1)) for a, b in spans], pa.list_(pa.int32()))

    none = F.lit(None).cast("string")
    left = urls.withColumn("area", area_of("key", F.pmod(F.col("id"), F.lit(1_000_003)))).select("area", "key", F.lit(1).alias("side"), "path", none.alias("verdict"), none.alias("text"), "row")
    named = rules.where(F.col("host").isNotNull() & (F.col("host") != "")).select(key_of(ascii_lower(F.col("host"))).alias("key"), F.coalesce("path", F.lit("")).alias("path"), "verdict", F.concat(ascii_lower(F.col("host")), F.coalesce("path", F.lit(""))).alias("text"))
    right = named.withColumn("area", F.explode(areas_of("key"))).select("area", "key", F.lit(0).alias("side"), "path", "verdict", "text", F.lit(None).cast(left.schema["row"].dataType).alias("row"))
    # a partition for each range, by its number; the batches of Arrow are small, so a task holds little besides the rules
    dealt = left.unionByName(right).repartition(ranges, "area").sortWithinPartitions("area", "key", "side", "path")
    shape = StructType([StructField("row", left.schema["row"].dataType), StructField("rule", StringType()), StructField("verdict", StringType())])
    swept = dealt.mapInArrow(lambda batches: _sweep(batches, default), shape)
    values = [F.col("row").getField(f"c{k}") for k in range(len(ids))] + [F.col("row").getField("host"), F.col("row").getField("path"), F.col("rule"), F.col("verdict")]
    return swept.select(*(v.alias(n) for v, n in zip(values, names, strict=True)))


def op4_url_filter(pages: DataFrame) -> DataFrame:
    rules = pages.sparkSession.createDataFrame(CONTRACT_RULES, "verdict string, host string, path string")
    return judge(pages, rules, ["page_id"])
