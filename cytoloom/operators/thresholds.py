"""One cut and status for each image and identity marker.

Manual and unsupported rows are made on the driver. For the others the scores of the needed markers are counted by
value. Groups with at most POINTS distinct values are worked out by one task each (``estimators``), larger ones by
aggregations over all of them (``large``), with the same result. Curves stay in a stored table; the driver gets scalars.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import StateError, require
from ..functions.canonical import canonical
from ..functions.columns import col
from ..plans.config import Config
from ..plans.methods import method_args
from ..session import ready
from ..storage import small, stored
from . import estimators as est
from . import large
from .embed import Embedding
from .prepare import Prepared, same_scores, score_digest, support_map

POINTS = 16_384
SCHEMA = (
    "image_id string, marker string, parent string, role string, method string, status string, estimate double, crossing double, negative_q99 double, auc double, "
    "n_positive_pool long, n_negative_pool long, positive_populations string, negative_populations string, rule string, args_json string, details string, evidence_ref string"
)
COLUMNS = [c.split(" ")[0] for c in SCHEMA.split(", ")]


class Evidence(Mapping):
    """Curves and parameters by reference, read from their table when asked for."""

    def __init__(self, table: DataFrame | None, refs: dict[str, tuple[str, str]]):
        self.table, self.refs = table, refs

    def __getitem__(self, ref: str) -> dict[str, list[float]]:
        image, marker = self.refs[ref]
        row = self.table.where((F.col("image_id") == image) & (F.col("marker") == marker)).select("evidence").first()
        return dict(row.evidence)

    def __iter__(self) -> Iterator[str]:
        return iter(self.refs)

    def __len__(self) -> int:
        return len(self.refs)

    def frame(self, spark) -> DataFrame:
        """(evidence_ref, name, values array<double>)."""
        if not self.refs:
            return spark.createDataFrame([], "evidence_ref string, name string, values array<double>")
        named = spark.createDataFrame([(ref, *key) for ref, key in self.refs.items()], "evidence_ref string, image_id string, marker string")
        return self.table.join(named, ["image_id", "marker"]).select("evidence_ref", F.explode("evidence").alias("name", "values"))


@dataclass(frozen=True)
class Thresholds:
    """rows: images x markers dictionaries on the driver; evidence: curves and parameters by reference."""

    rows: tuple[dict[str, Any], ...]
    evidence: Mapping[str, dict[str, list[float]]]
    config_digest: str
    score_digest: str = ""

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in self.rows], SCHEMA)

    @cached_property
    def by_key(self) -> dict[tuple[str, str, str | None], list[dict[str, Any]]]:
        out: dict[tuple[str, str, str | None], list[dict[str, Any]]] = {}
        for r in self.rows:
            out.setdefault((r["image_id"], r["marker"], r["parent"]), []).append(r)
        return out

    def lookup(self, image: str, marker: str, parent: str | None = None) -> dict[str, Any] | None:
        """The row of an image, marker and parent; None where there isn't exactly one."""
        found = self.by_key.get((image, marker, parent), [])
        return found[0] if len(found) == 1 else None

    def cut(self, image: str, marker: str) -> float | None:
        row = self.lookup(image, marker)
        return row["estimate"] if row and row["status"] in ("CALLABLE", "MANUAL") else None

    def __repr__(self) -> str:
        callable_rows = sum(r["status"] in ("CALLABLE", "MANUAL") for r in self.rows)
        return f"<Thresholds {len(self.rows)} rows, {callable_rows} callable>"


def long_scores(prepared: Prepared, markers: list[str], scores: DataFrame | None = None, *keep: str) -> DataFrame:
    """(image_id, keep..., marker, v) of the finite scores of ``markers``."""
    df = prepared.df if scores is None else scores
    parts = F.array(*(F.struct(F.lit(m).alias("marker"), col(f"score_{m}").alias("v")) for m in markers))
    return df.select("image_id", *keep, F.inline(parts)).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))


def points(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., v, w): distinct values of every group with their counts; stored."""
    return stored(long.groupBy(*keys, (F.col("v") + F.lit(0.0)).alias("v")).agg(F.count(F.lit(1)).alias("w")), "points")


def large_groups(counted: DataFrame, keys: list[str], limit: int | None = None) -> set[tuple]:
    """The groups with more than ``limit`` distinct values."""
    limit = POINTS if limit is None else limit
    return {tuple(r[k] for k in keys) for r in counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > limit).collect()}


def _row(image: str, marker: str, parent: str | None, role: str, method: str, args: dict[str, Any], e: est.Estimate, ref: str | None) -> dict[str, Any]:
    return {
        "image_id": image, "marker": marker, "parent": parent, "role": role, "method": method, "status": e.status, "estimate": e.estimate, "crossing": e.crossing, "negative_q99": e.negative_q99,
        "auc": e.auc, "n_positive_pool": e.n_positive_pool, "n_negative_pool": e.n_negative_pool, "positive_populations": e.positive_populations, "negative_populations": e.negative_populations,
        "rule": e.rule, "args_json": canonical(args), "details": e.details, "evidence_ref": ref,
    }


RESULT = "image_id string, marker string, status string, estimate double, crossing double, negative_q99 double, auc double, n_positive_pool long, n_negative_pool long, positive_populations string, negative_populations string, rule string, details string, evidence map<string,array<double>>"


def result_frame(image: str, marker: str, e: est.Estimate) -> pd.DataFrame:
    return pd.DataFrame([{"image_id": image, "marker": marker} | {k: getattr(e, k) for k in ("status", "estimate", "crossing", "negative_q99", "auc", "n_positive_pool", "n_negative_pool", "positive_populations", "negative_populations", "rule", "details")} | {"evidence": e.evidence}])


def estimate_groups(long: DataFrame, plan: dict[tuple[str, str], tuple[str, dict[str, Any]]]) -> tuple[dict[tuple[str, str], est.Estimate], DataFrame | None]:
    """Runs valley, tail and mixture on the groups (image_id, marker) of ``plan``: estimates without evidence, and
    (image_id, marker, evidence)."""
    spark = ready(long.sparkSession)
    keys = ["image_id", "marker"]
    counted = points(long, keys)
    big = large_groups(counted, keys) & set(plan)
    named = lambda groups: small(spark.createDataFrame(sorted(groups), "image_id string, marker string"), len(groups))
    out, evidence = {}, []
    rest = set(plan) - big
    if rest:

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            method, args = plan[key]
            return result_frame(*key, est.ESTIMATORS[method](est.Points.of(pdf.v, pdf.w), args))

        done = stored(counted.join(named(rest), keys, "left_semi").groupBy(*keys).applyInPandas(run, RESULT), "estimates")
        out |= collected(done)
        evidence.append(done.select(*keys, "evidence"))
    if big:
        values = stored(long.join(named(big), keys, "left_semi").select(*keys, "v"), "values")
        curved = {k: plan[k] for k in big if plan[k][0] != "mixture"}
        if curved:
            found, table = large.curves(values, curved)
            out |= found
            evidence += [table] if table is not None else []
        mixed = {k: plan[k][1] for k in big if plan[k][0] == "mixture"}
        if mixed:
            found, rows = large.mixtures(values, mixed)
            out |= found
            evidence += [spark.createDataFrame(rows, "image_id string, marker string, evidence map<string,array<double>>")] if rows else []
    table = None
    for e in evidence:
        table = e if table is None else table.unionByName(e)
    return out, table


def collected(df: DataFrame) -> dict[tuple[str, str], est.Estimate]:
    """Estimates of a table (RESULT), without their evidence."""
    out = {}
    for r in df.drop("evidence").collect():
        d = r.asDict()
        key = d.pop("image_id"), d.pop("marker")
        out[key] = est.Estimate(**d)
    return out


def _crossings(prepared: Prepared, scores: DataFrame, population: DataFrame, plan: dict, config: Config) -> dict[tuple[str, str], est.Estimate]:
    """Population crossings: moments of every population, and samples of max_per_population values (a setting of the
    method), chosen by hash of the cell key."""
    ready(scores.sparkSession)
    markers = sorted({m for _, m in plan})
    joined = scores.join(population.select("image_id", "cell_id", "population"), ["image_id", "cell_id"]).where("population is not null")
    long = long_scores(prepared, markers, joined, "cell_id", "population")
    most = max(args["max_per_population"] for _, args in plan.values())
    sizes = long.groupBy("image_id", "marker", "population").agg(F.count(F.lit(1)).alias("n"))
    # a threshold on the hash keeps about 1.5 times the sample of a large pool, so that ranking stays small
    drawn = long.join(sizes, ["image_id", "marker", "population"]).withColumn("_h", F.xxhash64(F.lit("sample"), "cell_id"))
    drawn = drawn.where((F.col("n") <= 4 * most) | (F.pmod("_h", F.lit(1 << 30)) < (F.lit(1.5 * (1 << 30)) * most / F.col("n"))))
    ranked = drawn.selectExpr("*", "row_number() over (partition by image_id, marker, population order by _h, cell_id) as _k")
    sampled = ranked.where(F.col("_k") <= most).select("image_id", "marker", "population", "v", F.col("_k").alias("w"), F.lit(True).alias("sample"))
    pools = population_moments(long)
    every = pools.select("image_id", "marker", "population", F.col("mean").alias("v"), F.col("n").alias("w"), "variance", F.lit(False).alias("sample"))
    sampled = sampled.select("image_id", "marker", "population", "v", F.col("w").cast("long").alias("w"), F.lit(0.0).alias("variance"), "sample")
    support = {m: config.marker(m).support for m in markers}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key not in plan:
            return pd.DataFrame([], columns=[c.split(" ")[0] for c in RESULT.split(", ")])
        _, args = plan[key]
        pools = {int(r.population): est.Moments(int(r.w), r.v, r.variance * r.w) for r in pdf[~pdf["sample"]].itertuples()}
        some = pdf[pdf["sample"] & (pdf.w <= args["max_per_population"])]
        taken = {int(k): est.Points.of(g.v) for k, g in some.groupby("population")}
        return result_frame(*key, est.population_crossing(pools, taken, args, support[key[1]].min_auc, support[key[1]].min_cells))

    return collected(every.unionByName(sampled).groupBy("image_id", "marker").applyInPandas(run, RESULT))


def population_moments(long: DataFrame) -> DataFrame:
    """(image_id, marker, population, n, mean, variance) of (image_id, marker, population, v)."""
    return long.groupBy("image_id", "marker", "population").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.coalesce(F.var_pop("v"), F.lit(0.0)).alias("variance"))


def thresholds(prepared: Prepared, scores: DataFrame | None = None, population: DataFrame | Embedding | None = None) -> Thresholds:
    """Cuts of all images and identity markers. ``scores``: a corrected table with score_ columns; ``population``: an
    embedding of these scores, or a table (image_id, cell_id, population)."""
    if isinstance(population, Embedding):
        same_scores(population.score_digest, prepared, scores, "populations")
        population = population.df
    config = prepared.config
    status = support_map(prepared)
    images = sorted({i for i, _ in status})
    table = scores if scores is not None else prepared.df
    settled: dict[tuple[str, str], est.Estimate] = {}
    methods: dict[tuple[str, str], tuple[str, dict[str, Any]]] = {}
    for image in images:
        for name in config.gated:
            m, o = config.marker(name), config.override(image, name)
            method = (o and o.method) or m.method
            args = method_args(method, o.args if o and o.args is not None else m.args, m.role)
            methods[image, name] = (method, args)
            state, details = status.get((image, name), ("NOT_CALLABLE_UNAVAILABLE", "Nothing is known about the marker's support."))
            if state.startswith("NOT_CALLABLE"):
                settled[image, name] = est.Estimate(state, details=details)
            elif method == "manual":
                settled[image, name] = est.manual(args)
            elif method == "population_crossing" and population is None:
                settled[image, name] = est.Estimate("NOT_CALLABLE_NO_POPULATION", details="The method needs the populations of an embedding.")
    open_groups = {k: v for k, v in methods.items() if k not in settled}
    curves = {k: v for k, v in open_groups.items() if v[0] in est.ESTIMATORS}
    evidence = None
    if curves:
        wanted = small(prepared.df.sparkSession.createDataFrame(sorted(curves), "image_id string, marker string"), len(curves))
        long = long_scores(prepared, sorted({m for _, m in curves}), table).join(wanted, ["image_id", "marker"], "left_semi")
        found, evidence = estimate_groups(long, curves)
        settled |= found
    crossings = {k: v for k, v in open_groups.items() if v[0] == "population_crossing"}
    if crossings:
        settled |= _crossings(prepared, table, population, crossings, config)
    rows, refs = [], {}
    for key, (method, args) in methods.items():
        missing = est.Estimate("NOT_CALLABLE_NO_POPULATION", details=est.NO_POPULATIONS) if method == "population_crossing" else est.Estimate(est.UNDERPOWERED, details=est.TOO_FEW)
        m = config.marker(key[1])
        found = settled.get(key, missing)
        ref = f"E{len(refs) + 1:04d}" if key in curves and found.status == "CALLABLE" else None
        if ref:
            refs[ref] = key
        rows.append(_row(*key, None, m.role, method, args, est.enforce_pools(found, m.support.min_cells), ref))
    return Thresholds(tuple(rows), Evidence(evidence, refs), config.digest(), score_digest(prepared, scores))


def coverage(prepared: Prepared, frame: DataFrame) -> DataFrame:
    """(image_id, marker, n) of the images and identity markers that have no or several rows in a table of thresholds."""
    want = prepared.support.where(F.col("marker").isin(*prepared.config.gated)).select("image_id", "marker")
    found = frame.where("parent is null").groupBy("image_id", "marker").agg(F.count(F.lit(1)).alias("n"))
    return want.join(found, ["image_id", "marker"], "full_outer").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> 1")


def validate_thresholds(prepared: Prepared, cuts: Thresholds, scores: DataFrame | None = None) -> None:
    """Exactly one row for each image and identity marker, finite where callable, of the same configuration and scores."""
    same_scores(cuts.score_digest, prepared, scores, "thresholds")
    require(cuts.config_digest == prepared.config.digest(), "thresholds belong to another configuration", StateError)
    want = {(i, m) for i in {i for i, _ in support_map(prepared)} for m in prepared.config.gated}
    got = [(r["image_id"], r["marker"]) for r in cuts.rows if r["parent"] is None]
    require(len(got) == len(set(got)) and set(got) == want, "thresholds do not cover images and markers", StateError)
    require(all(r["estimate"] is not None for r in cuts.rows if r["status"] in ("CALLABLE", "MANUAL")), "a callable threshold has no estimate", StateError)


def auc_table(df: DataFrame, group: str, value: str, positive: str) -> DataFrame:
    """(group, auc): Mann-Whitney by group from counts of each value, so ranks need no sort of single rows.

    ``positive`` is a boolean column; NULL values and flags are left out.
    """
    counted = df.where(F.col(value).isNotNull() & F.col(positive).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    below = counted.selectExpr("*", "coalesce(sum(n) over (partition by g order by v rows between unbounded preceding and 1 preceding), 0L) as less")
    pairs = F.sum(F.col("p") * (F.col("less") + F.col("n") / F.lit(2.0)))
    return below.groupBy(F.col("g").alias(group)).agg((pairs / (F.sum("p").cast("double") * F.sum("n"))).alias("auc"), F.sum("p").alias("n_positive"), F.sum("n").alias("n_negative"))


def density_table(df: DataFrame, group: str, value: str, n: int = 256, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """(group, k, x, density): Gaussian kernel density on n places between two quantiles of each group.

    Exact sums over the distinct values; for plots, whose grids are small.
    """
    base = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    q = base.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"), F.percentile("v", F.array(*(F.lit(x) for x in (low, high, 0.25, 0.75)))).alias("q"))
    h = q.where("q[1] > q[0]").selectExpr("g", "n", "q[0] as lo", "q[1] as hi", "0.9D * if(least(sd, (q[3] - q[2]) / 1.34D) > 0, least(sd, (q[3] - q[2]) / 1.34D), sd) * pow(n, -0.2D) as h")
    grid = h.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).selectExpr("g", "n", "h", "k", f"lo + k * (hi - lo) / {float(n - 1)}D as x")
    z = (F.col("x") - F.col("v")) / F.col("h")
    summed = points(base, ["g"]).join(grid, "g").groupBy("g", "k", "x", "n", "h").agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("s"))
    return summed.select(F.col("g").alias(group), "k", "x", (F.col("s") / (F.col("n") * F.col("h") * F.sqrt(F.lit(2.0) * F.pi()))).alias("density"))


def crossing_table(df: DataFrame, group: str, value: str, positive: str, n: int = 256) -> DataFrame:
    """(group, crossing): for each group the first of n places over the common range, behind the peak of the negative
    pool's density, where the positive pool's density is at least as high; NULL without one."""
    base = df.select(F.col(group).alias("g"), F.col(positive).alias("p"), F.col(value).cast("double").alias("v")).where("v is not null and p is not null and not isnan(v)")
    stats = base.groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"), F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    widths = stats.selectExpr("g", "p", "n", "0.9D * if(least(sd, (q[1] - q[0]) / 1.34D) > 0, least(sd, (q[1] - q[0]) / 1.34D), sd) * pow(n, -0.2D) as h")
    spans = base.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("hi > lo")
    grid = spans.select("g", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).selectExpr("g", "k", f"lo + k * (hi - lo) / {float(n - 1)}D as x").join(widths, "g")
    z = (F.col("x") - F.col("v")) / F.col("h")
    curves = points(base, ["g", "p"]).join(grid, ["g", "p"]).groupBy("g", "k", "x").pivot("p", [True, False]).agg(F.sum(F.col("w") * F.exp(-0.5 * z * z) / (F.col("n") * F.col("h"))))
    peak = curves.groupBy("g").agg(F.max_by("k", F.struct(F.col("false"), -F.col("k"))).alias("top"))
    hits = curves.join(peak, "g").where((F.col("k") > F.col("top")) & (F.col("true") >= F.col("false"))).groupBy("g").agg(F.min("x").alias("crossing"))
    return spans.select("g").join(hits, "g", "left").select(F.col("g").alias(group), "crossing")


def mixture_step_table(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, w1, w2, m1, m2, s1, s2): one round of expectation and maximisation from the usual start, as aggregations;
    for groups whose points do not fit one task's bound exactly, rounds of this kind can be iterated."""
    base = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)").groupBy("g", "v").agg(F.count(F.lit(1)).alias("w"))
    wide = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).groupBy("g").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.stddev_samp("v").alias("sd0"))
    outer = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).join(wide, "g").groupBy("g").agg(F.stddev_samp(F.when(F.col("v") <= F.col("q")[0], F.col("v"))).alias("a"), F.stddev_samp(F.when(F.col("v") >= F.col("q")[1], F.col("v"))).alias("b"))
    start = wide.join(outer, "g").selectExpr("g", "q[0] as a1", "q[1] as a2", "if(a > 0, a, greatest(sd0 / 2, 1e-6D)) as d1", "if(b > 0, b, greatest(sd0 / 2, 1e-6D)) as d2")
    shared = base.join(start, "g").selectExpr("g", "v", "w", "1D / (1D + exp(-0.5D * pow((v - a2) / d2, 2) - ln(d2) + 0.5D * pow((v - a1) / d1, 2) + ln(d1))) as r")
    sums = shared.groupBy("g").agg(F.sum("w").alias("n"), *(F.sum(e).alias(a) for a, e in (("r1", F.expr("w * r")), ("x1", F.expr("w * r * v")), ("r2", F.expr("w * (1 - r)")), ("x2", F.expr("w * (1 - r) * v")))))
    means = sums.selectExpr("g", "r1", "r2", "r1 / n as w1", "r2 / n as w2", "x1 / r1 as m1", "x2 / r2 as m2")
    spread = shared.join(means, "g").groupBy("g", "w1", "w2", "m1", "m2", "r1", "r2").agg(F.sum(F.expr("w * r * pow(v - m1, 2)")).alias("q1"), F.sum(F.expr("w * (1 - r) * pow(v - m2, 2)")).alias("q2"))
    return spread.selectExpr(f"g as `{group}`", "w1", "w2", "m1", "m2", "sqrt(q1 / r1) as s1", "sqrt(q2 / r2) as s2")


def mode_table(curve: DataFrame, group: str, share: float = 0.03) -> DataFrame:
    """(group, k, x, density, rank): strict local maxima of at least ``share`` of the highest."""
    near = curve.selectExpr("*", f"lag(density) over (partition by {group} order by k) as before", f"lead(density) over (partition by {group} order by k) as after", f"max(density) over (partition by {group}) as top")
    return near.where((F.col("density") > F.col("before")) & (F.col("density") > F.col("after")) & (F.col("density") >= F.lit(share) * F.col("top"))).selectExpr(group, "k", "x", "density", f"row_number() over (partition by {group} order by density desc, k) as rank")


def evidence_frame(spark, cuts: Thresholds) -> DataFrame:
    """(evidence_ref, name, values array<double>)."""
    return cuts.evidence.frame(spark) if isinstance(cuts.evidence, Evidence) else Evidence(None, {}).frame(spark)


__all__ = ["Thresholds", "auc_table", "crossing_table", "density_table", "evidence_frame", "mixture_step_table", "mode_table", "points", "thresholds", "validate_thresholds"]
