"""The estimators for groups with more distinct values than one task should hold, as aggregations over all groups at once.

The same numbers as ``estimators`` computes from points: moments, exact quantiles (``order``), masses on the lattice of
each curve, which is at most a few thousand rows for a group, and counts on both sides of cuts. What comes to the driver is
a few scalars for each group. ``values`` is a table (image_id, marker, v) that is read several times, so it should be
stored.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ready
from ..storage import small, stored
from . import estimators as est
from .order import quantiles

KEY = ["image_id", "marker"]
Key = tuple[str, str]
#: Distinct values that a part may hold when pairs are counted.
PART = 50_000


def _table(values: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return small(values.sparkSession.createDataFrame(rows, f"image_id string, marker string, {schema}"), len(rows))


def moments(values: DataFrame, by: list[str] = KEY) -> dict[tuple, Any]:
    rows = values.groupBy(*by).agg(F.count("v").alias("n"), F.stddev_samp("v").alias("sd"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
    return {tuple(r[c] for c in by): r for r in rows}


def spots(values: DataFrame, probs: list[float]) -> dict[Key, dict[float, float]]:
    return {(r.image_id, r.marker): dict(zip(probs, r.q, strict=True)) for r in quantiles(values, KEY, ["v"], probs).collect()}


def masses(values: DataFrame, lattices: dict[Key, est.Lattice]) -> DataFrame:
    """(image_id, marker, cell, mass) of every group's lattice."""
    table = _table(values, [(*k, g.start, g.step, g.size) for k, g in lattices.items()], "start double, step double, size int")
    at = values.join(table, KEY).withColumn("at", (F.col("v") - F.col("start")) / F.col("step")).withColumn("cell", F.floor("at")).where("cell >= 0 and cell <= size - 2")
    parts = F.array(F.struct(F.col("cell").cast("int").alias("cell"), (1 - (F.col("at") - F.col("cell"))).alias("w")), F.struct((F.col("cell") + 1).cast("int").alias("cell"), (F.col("at") - F.col("cell")).alias("w")))
    return at.select(*KEY, F.inline(parts)).groupBy(*KEY, "cell").agg(F.sum("w").alias("mass"))


def _dense(pdf: pd.DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size)
    out[pdf.cell.to_numpy()] = pdf.mass.to_numpy()
    return out


PLACE = "image_id string, marker string, cut double, peak double, status string, details string, evidence map<string,array<double>>"


def places(values: DataFrame, plan: dict[Key, tuple[str, dict[str, Any]]], lattices: dict[Key, est.Lattice], totals: dict[Key, int]) -> DataFrame:
    """Where valley and tail cut, a row for each group (PLACE); stored."""
    ready(values.sparkSession)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        method, args = plan[key]
        x, y = lattices[key].curve(_dense(pdf, lattices[key].size), totals[key])
        row: dict[str, Any] = {"image_id": key[0], "marker": key[1], "cut": None, "peak": None, "status": None, "details": None, "evidence": {}}
        if method == "valley":
            found = est.valley_place(x, y, args)
            if isinstance(found, est.Estimate):
                row |= {"status": found.status, "details": found.details}
            else:
                row |= {"cut": found[0], "evidence": found[1]}
        else:
            cut, peak, evidence = est.tail_place(x, y, args)
            row |= {"cut": cut, "peak": peak, "evidence": evidence}
        return pd.DataFrame([row]).astype({"cut": "float64", "peak": "float64"})

    return stored(masses(values, lattices).groupBy(*KEY).applyInPandas(run, PLACE), "places")


def sides(values: DataFrame, cuts: dict[Key, tuple[float, float | None]]) -> dict[Key, tuple[est.Pools, int]]:
    """Pools at the cut of each group, and how many values lie below its second number. Everything above a cut is larger
    than everything not above it, so the AUC is 1."""
    if not cuts:
        return {}
    table = _table(values, [(*k, c, m) for k, (c, m) in cuts.items()], "cut double, mirror double")
    joined = values.join(table, KEY)
    counts = joined.groupBy(*KEY).agg(F.count_if(F.col("v") <= F.col("cut")).alias("negative"), F.count_if(F.col("v") > F.col("cut")).alias("positive"), F.count_if(F.col("v") < F.col("mirror")).alias("mirror")).collect()
    q99 = spots(joined.where("v <= cut").select(*KEY, "v"), [0.99])
    return {(r.image_id, r.marker): (est.Pools(cuts[r.image_id, r.marker][0], r.negative, r.positive, q99.get((r.image_id, r.marker), {}).get(0.99), 1.0 if r.positive and r.negative else None), r.mirror) for r in counts}


def curves(values: DataFrame, plan: dict[Key, tuple[str, dict[str, Any]]]) -> tuple[dict[Key, est.Estimate], DataFrame | None]:
    """Valley and tail: estimates without evidence, and (image_id, marker, evidence)."""
    out: dict[Key, est.Estimate] = {}
    wanted = sorted({q for _, args in plan.values() for q in (*est.range_of(args), 0.25, 0.75, args.get("fallback_quantile", 0.99))})
    found, at = moments(values), spots(values, wanted)
    lattices: dict[Key, est.Lattice] = {}
    for key, (_, args) in plan.items():
        m = found.get(key)
        if m is None or not est.usable(m.n, m.high > m.low, args):
            out[key] = est.Estimate(est.UNDERPOWERED, details=est.TOO_FEW)
            continue
        low, high = (at[key][q] for q in est.range_of(args))
        if high <= low:
            out[key] = est.Estimate()
        else:
            lattices[key] = est.Lattice(low, high, int(args["grid_n"]), est.reference_width(m.n, m.sd, at[key][0.75] - at[key][0.25], m.low))
    if not lattices:
        return out, None
    table = places(values, {k: plan[k] for k in lattices}, lattices, {k: found[k].n for k in lattices})
    cuts: dict[Key, tuple[float, float | None]] = {}
    for r in table.drop("evidence").collect():
        key = r.image_id, r.marker
        if r.status:
            out[key] = est.Estimate(r.status, details=r.details)
            continue
        cut = r.cut if r.cut is not None and not math.isnan(r.cut) else at[key][plan[key][1]["fallback_quantile"]]
        cuts[key] = (cut, 2 * r.peak - cut if plan[key][0] == "tail" else None)
    for key, (pools, n_mirror) in sides(values, cuts).items():
        method, args = plan[key]
        out[key] = est.valley_estimate(pools, {}) if method == "valley" else est.tail_estimate(pools, n_mirror, args, {})
    return out, table.select(*KEY, "evidence")


def mixtures(values: DataFrame, plan: dict[Key, dict[str, Any]]) -> tuple[dict[Key, est.Estimate], list[tuple]]:
    """Two-component mixtures: one aggregation for a round of all groups that have not settled. Estimates, and evidence rows
    (image_id, marker, evidence)."""
    out: dict[Key, est.Estimate] = {}
    found, at = moments(values), spots(values, [0.25, 0.75])
    models: dict[Key, est.Mixture] = {}
    for key, args in plan.items():
        m = found.get(key)
        if m is None or not est.usable(m.n, m.high > m.low, args):
            out[key] = est.Estimate(est.UNDERPOWERED, details=est.TOO_FEW)
    running = [k for k in plan if k not in out]
    if not running:
        return out, []
    table = _table(values, [(*k, at[k][0.25], at[k][0.75]) for k in running], "q1 double, q3 double")
    for r in values.join(table, KEY).groupBy(*KEY).agg(F.stddev_samp(F.when(F.col("v") <= F.col("q1"), F.col("v"))).alias("a"), F.stddev_samp(F.when(F.col("v") >= F.col("q3"), F.col("v"))).alias("b")).collect():
        key = r.image_id, r.marker
        models[key] = est.Mixture([0.5, 0.5], [at[key][0.25], at[key][0.75]], [s if s is not None and math.isfinite(s) and s > 0 else max(found[key].sd / 2, 1e-6) for s in (r.a, r.b)])
    before, rounds, final = dict.fromkeys(running, -math.inf), dict.fromkeys(running, 0), {}
    while running:
        sums = _round(values, {k: models[k] for k in running})
        for key in list(running):
            now, step = sums[key]
            if rounds[key]:
                settled = abs(now - before[key]) <= plan[key]["tol"] * (1 + abs(now)) or rounds[key] >= int(plan[key]["max_iter"])
                if settled:
                    final[key] = now
                    running.remove(key)
                    continue
                before[key] = now
            models[key] = step(found[key].n, found[key].sd)
            rounds[key] += 1
    cuts, evidence = {}, {}
    for key, likelihood in final.items():
        place = est.mixture_place(models[key], likelihood, found[key].n, found[key].sd, plan[key])
        if isinstance(place, est.Estimate):
            out[key] = place
        else:
            cuts[key], evidence[key] = (place[0], None), place[1]
    for key, (pools, _) in sides(values, cuts).items():
        out[key] = est.mixture_estimate(pools, {})
    return out, [(*k, v) for k, v in evidence.items()]


def _round(values: DataFrame, models: dict[Key, est.Mixture]) -> dict[Key, tuple[float, Any]]:
    """For each group the likelihood of its model, and a function that gives the next one."""
    rows = [(*k, *(math.log(w) if w > 0 else -math.inf for w in m.weight), *m.mean, *m.sd) for k, m in models.items()]
    joined = values.join(_table(values, rows, "l1 double, l2 double, m1 double, m2 double, s1 double, s2 double"), KEY)
    part = lambda j: F.col(f"l{j}") - 0.5 * F.pow((F.col("v") - F.col(f"m{j}")) / F.col(f"s{j}"), 2) - F.log(f"s{j}") - 0.5 * math.log(2 * math.pi)
    shared = joined.withColumn("a", part(1)).withColumn("b", part(2)).withColumn("r", 1 / (1 + F.exp(F.col("b") - F.col("a"))))
    both = F.greatest("a", "b") + F.log1p(F.exp(-F.abs(F.col("a") - F.col("b"))))
    parts = []
    for j, r in ((1, F.col("r")), (2, 1 - F.col("r"))):
        away = F.col("v") - F.col(f"m{j}")
        parts += [F.sum(r).alias(f"r{j}"), F.sum(r * away).alias(f"x{j}"), F.sum(r * away * away).alias(f"q{j}")]
    out = {}
    for row in shared.groupBy(*KEY).agg(F.sum(both).alias("likelihood"), *parts).collect():
        key = row.image_id, row.marker

        def step(n: int, sd: float, row: Any = row, old: est.Mixture = models[key]) -> est.Mixture:
            weights, means, sds = [], [], []
            for j in (1, 2):
                total, x, q = row[f"r{j}"], row[f"x{j}"], row[f"q{j}"]
                shift = x / total if total > 0 else math.nan
                spread = math.sqrt(max(q / total - shift * shift, 0.0)) if total > 0 else math.nan
                weights.append(total / n)
                means.append(old.mean[j - 1] + shift)
                sds.append(spread if math.isfinite(spread) and spread > 1e-8 else max(sd / 100, 1e-6))
            order = slice(None, None, -1) if means[0] > means[1] else slice(None)
            return est.Mixture(weights[order], means[order], sds[order])

        out[key] = (row.likelihood, step)
    return out


def parents(values: DataFrame, plan: dict[Key, tuple[dict[str, Any], float, int]]) -> dict[Key, est.Estimate]:
    """Parent crossings of (image_id, marker, v, inside: true in the parent, false in the reference)."""
    pools = moments(values, [*KEY, "inside"])
    halves = {inside: spots(values.where(F.col("inside") == inside).select(*KEY, "v"), [0.25, 0.5, 0.75]) for inside in (True, False)}
    areas = rank_areas(values)
    size = lambda key, inside: pools[(*key, inside)].n if (*key, inside) in pools else 0
    lattices: dict[bool, dict[Key, est.Lattice]] = {True: {}, False: {}}
    for key, (args, _, min_cells) in plan.items():
        if min(size(key, True), size(key, False)) < max(2, min_cells):
            continue
        low, high = min(pools[(*key, s)].low for s in (True, False)), max(pools[(*key, s)].high for s in (True, False))
        if high > low:
            for side in (True, False):
                m, q = pools[(*key, side)], halves[side][key]
                lattices[side][key] = est.Lattice(low, high, int(args.get("n_grid", 2048)), est.reference_width(m.n, m.sd, q[0.75] - q[0.25], m.low))
    crossings: dict[Key, float | None] = {}
    if lattices[True]:
        ready(values.sparkSession)
        dealt = [masses(values.where(F.col("inside") == side).select(*KEY, "v"), lattices[side]).withColumn("inside", F.lit(side)) for side in (True, False)]
        totals = {side: {k: size(k, side) for k in lattices[side]} for side in (True, False)}

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            curve = {side: lattices[side][key].curve(_dense(pdf[pdf.inside == side], lattices[side][key].size), totals[side][key]) for side in (True, False)}
            return pd.DataFrame({"image_id": [key[0]], "marker": [key[1]], "cut": np.array([est.first_crossing(curve[True][0], curve[True][1], curve[False][1])], float)})

        for r in dealt[0].unionByName(dealt[1]).groupBy(*KEY).applyInPandas(run, "image_id string, marker string, cut double").collect():
            crossings[r.image_id, r.marker] = None if r.cut is None or math.isnan(r.cut) else r.cut
    out = {}
    for key, (_, min_auc, min_cells) in plan.items():
        higher = key in halves[True] and key in halves[False] and halves[True][key][0.5] > halves[False][key][0.5]
        out[key] = est.parent_estimate(size(key, True), size(key, False), areas.get(key), crossings.get(key), higher, min_auc, min_cells)
    return out


def rank_areas(values: DataFrame, limit: int = PART) -> dict[Key, float]:
    """Mann-Whitney areas of (image_id, marker, v, inside): pairs are counted by value within parts of a group's range, and
    between parts by their sums. Parts of more than ``limit`` distinct values are cut again."""
    counted = values.groupBy(*KEY, "v").agg(F.count_if("inside").alias("p"), F.count_if(~F.col("inside")).alias("n")).withColumn("path", F.lit(""))
    counted = stored(counted, "ranked")
    while (counted.groupBy(*KEY, "path").agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0] or 0) > limit:
        spans = counted.groupBy(*KEY, "path").agg(F.min("v").alias("low"), F.max("v").alias("high"), (F.count(F.lit(1)) > limit).alias("heavy"))
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        deeper = F.concat("path", F.format_string(".%04d", F.least(F.lit(999), F.floor(share * 1000).cast("int"))))
        counted = stored(counted.join(spans, [*KEY, "path"]).select(*KEY, "v", "p", "n", F.when(F.col("heavy"), deeper).otherwise(F.col("path")).alias("path")), "ranked")
    inner = counted.selectExpr(*KEY, "path", "p", "n", "coalesce(sum(n) over (partition by image_id, marker, path order by v rows between unbounded preceding and 1 preceding), 0L) as less")
    parts = inner.groupBy(*KEY, "path").agg(F.sum(F.col("p") * (F.col("less") + F.col("n") / 2.0)).alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    outer = parts.selectExpr("*", "coalesce(sum(n) over (partition by image_id, marker order by path rows between unbounded preceding and 1 preceding), 0L) as less")
    total = outer.groupBy(*KEY).agg(F.sum(F.col("won") + F.col("p").cast("double") * F.col("less")).alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return {(r.image_id, r.marker): r.won / (r.p * r.n) for r in total.where("p > 0 and n > 0").collect()}
