"""Exact quantiles of groups of any size.

``percentile`` and ``median`` gather all distinct values of a group in one task. Here a first pass takes approximate
quantiles (mergeable sketches), between whose neighbours each wanted order statistic must lie; a second counts what lies
below that bracket and, value by value, what lies in it: about a hundredth of a group. Brackets that still hold more
than LIMIT distinct values are cut into equal parts, by counts over the stored bracket, until none does; then the values
are ranked. Groups of up to LIMIT rows go into their bracket whole. A table of up to WHOLE rows is left to ``percentile``,
whose memory is bounded then. The results are exact whatever the way.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..storage import small, stored

LIMIT, STEPS, PARTS, WHOLE = 50_000, 200, 1024, 200_000


def quantiles(df: DataFrame, keys: list[str], columns: list[str], probs: list[float], limit: int | None = None) -> DataFrame:
    """(keys..., name, n, q array<double>) of each group and column: the count of the values that aren't NULL or NaN, and
    their quantiles by linear interpolation between order statistics (type 7), NULL without values. Stored."""
    whole_table = limit is None and df.count() <= WHOLE
    limit = LIMIT if limit is None else limit
    groups = [f"g{k}" for k in range(len(keys))]
    values = [F.when(~F.isnan(c := col(name).cast("double")), c) for name in columns]
    # -0.0 and 0.0 are one value
    base = df.select(*(col(k).alias(g) for k, g in zip(keys, groups, strict=True)), *((v + F.lit(0.0)).alias(f"v{k}") for k, v in enumerate(values)))
    if whole_table:
        share = F.array(*(F.lit(float(p)) for p in probs))
        rows = base.groupBy(*groups).agg(*(F.struct(F.lit(name).alias("name"), F.count(f"v{k}").alias("n"), F.percentile(f"v{k}", share).alias("q")).alias(f"s{k}") for k, name in enumerate(columns)))
        none = F.array(*(F.lit(None).cast("double") for _ in probs))
        listed = rows.select(*(F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)), F.inline(F.array(*(F.col(f"s{k}") for k in range(len(columns))))))
        return stored(listed.withColumn("q", F.coalesce("q", none)), "quantiles")
    steps = F.array(*(F.lit(k / STEPS) for k in range(STEPS + 1)))
    first = base.groupBy(*groups).agg(*(F.struct(F.lit(k).alias("k"), F.count(f"v{k}").alias("n"), F.min(f"v{k}").alias("least"), F.max(f"v{k}").alias("most"), F.percentile_approx(f"v{k}", steps, F.lit(10_000)).alias("a")).alias(f"s{k}") for k in range(len(columns))))
    first = stored(first.select(*groups, F.inline(F.array(*(F.col(f"s{k}") for k in range(len(columns)))))), "sketch")
    wanted = F.inline(F.array(*(F.struct(F.lit(j).alias("j"), F.lit(float(p)).alias("p")) for j, p in enumerate(probs))))
    at = first.where("n > 0").select("*", wanted).withColumn("low", F.floor((F.col("n") - 1) * F.col("p"))).withColumn("high", F.least(F.col("n") - 1, F.col("low") + 1))
    before, behind = F.floor(F.col("low") * STEPS / F.col("n")) - 2, F.ceil((F.col("high") + 1) * STEPS / F.col("n")) + 2
    whole = F.col("n") <= limit
    brackets = stored(at.select(*groups, "k", "j", "n", "p", "low", "high", F.when(whole | (before < 0), F.col("least")).otherwise(F.get("a", before.cast("int"))).alias("b0"), F.when(whole | (behind > STEPS), F.col("most")).otherwise(F.get("a", behind.cast("int"))).alias("b1")), "brackets")
    # one row for each group, the brackets side by side
    slots = [(k, j) for k in range(len(columns)) for j in range(len(probs))]
    wide = brackets.groupBy(*groups).agg(*(F.max(F.when((F.col("k") == k) & (F.col("j") == j), F.struct("b0", "b1"))).alias(f"b{s}") for s, (k, j) in enumerate(slots)))
    joined = _same(base, small(wide, wide.count()), groups) if groups else base.crossJoin(F.broadcast(wide))
    inside = F.array(*(F.struct(F.lit(s).alias("s"), F.when(F.col(f"v{k}") >= F.col(f"b{s}.b0"), F.col(f"v{k}")).alias("v"), (F.col(f"v{k}") <= F.col(f"b{s}.b1")).alias("here")) for s, (k, j) in enumerate(slots)))
    counted = stored(joined.select(*groups, F.inline(inside)).where("here").groupBy(*groups, "s", "v").agg(F.count(F.lit(1)).alias("n")), "bracketed")
    target = brackets.select(*groups, (F.col("k") * len(probs) + F.col("j")).alias("s"), "low", "high")
    counted = _narrowed(counted, target, [*groups, "s"], limit)
    part = ", ".join([*groups, "s"])
    ranked = counted.selectExpr("*", f"sum(n) over (partition by {part} order by v nulls first) as upto")
    found = _same(ranked, target, [*groups, "s"]).groupBy(*groups, "s").agg(F.min(F.when((F.col("upto") > F.col("low")), F.col("v"))).alias("x0"), F.min(F.when(F.col("upto") > F.col("high"), F.col("v"))).alias("x1"))
    exact = _same(brackets.withColumn("s", F.col("k") * len(probs) + F.col("j")), found, [*groups, "s"]).select(*groups, "k", "j", (F.col("x0") + ((F.col("n") - 1) * F.col("p") - F.col("low")) * (F.col("x1") - F.col("x0"))).alias("q"))
    listed = exact.groupBy(*groups, "k").agg(*(F.max(F.when(F.col("j") == j, F.col("q"))).alias(f"q{j}") for j in range(len(probs))))
    names = F.array(*(F.lit(c) for c in columns))
    out = _same(first.select(*groups, "k", "n"), listed, [*groups, "k"], "left")
    return stored(out.select(*(F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)), F.get(names, F.col("k")).alias("name"), "n", F.array(*(F.col(f"q{j}") for j in range(len(probs)))).alias("q")), "quantiles")


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys in which NULL is a value."""
    renamed = b.withColumnsRenamed({k: f"{k}_b" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"{k}_b")) for k in keys]
    return a.join(renamed, on, how).drop(*(f"{k}_b" for k in keys))


def _narrowed(counted: DataFrame, target: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Cuts brackets of more than ``limit`` distinct values to the parts that hold the wanted ranks; what lies below them
    becomes one row without value."""
    while (counted.groupBy(*keys).agg(F.count("v").alias("m")).agg(F.max("m")).first()[0] or 0) > limit:
        spans = counted.groupBy(*keys).agg(F.min("v").alias("b0"), F.max("v").alias("b1"), F.count("v").alias("m"))
        placed = _same(counted, spans, keys)
        # halves before differences, so that the range of all doubles does not overflow
        share = (F.col("v") / 2 - F.col("b0") / 2) / (F.col("b1") / 2 - F.col("b0") / 2)
        placed = placed.withColumn("part", F.when(F.col("v").isNull(), -1).when(F.col("b1") > F.col("b0"), F.least(F.lit(PARTS - 1), F.floor(share * PARTS).cast("int"))).otherwise(0))
        by = ", ".join(keys)
        parts = placed.groupBy(*keys, "part").agg(F.sum("n").alias("n"), F.max("m").alias("m")).selectExpr("*", f"sum(n) over (partition by {by} order by part) as upto")
        need = _same(parts, target, keys).where(f"m <= {limit} or part >= 0 and upto > low and upto - n <= high").select(*keys, "part", F.lit(True).alias("needed"))
        bounds = need.groupBy(*keys).agg(F.min(F.when(F.col("part") >= 0, F.col("part"))).alias("p0"), F.max("part").alias("p1"))
        cut = _same(placed, bounds, keys).where("part <= p1").withColumn("v", F.when(F.col("part") >= F.col("p0"), F.col("v")))
        counted = stored(cut.groupBy(*keys, "v").agg(F.sum("n").alias("n")), "bracketed")
    return counted


def whole_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """The quantiles of each column over all rows, on the driver."""
    if not columns:
        return {}
    found = {r.name: list(r.q) for r in quantiles(df, [], columns, probs).collect()}
    return {c: [None if q is None or math.isnan(q) else q for q in found[c]] for c in columns}
