"""State markers within parents: a long table of cell x state marker x parent, and a cut for each image, marker and
parent."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import StateError, require
from ..functions.columns import col, finite
from ..plans.config import Config
from ..session import ready
from ..storage import small, stored
from . import estimators as est
from . import large
from .classify import Classification
from .prepare import KEYS, Prepared, available, score_digest, support_map, with_support
from .thresholds import COLUMNS, RESULT, SCHEMA, _row, collected, estimate_groups, large_groups, points, result_frame


@dataclass(frozen=True)
class StateCalls:
    """df: keys, marker, parent, in_parent, evaluable, score, estimate, localization_ratio, positive, enabled.
    rows: thresholds by image, marker and parent, on the driver. ``scores`` is the corrected table that they were made
    from, if any."""

    df: DataFrame
    rows: tuple[dict[str, Any], ...]
    config: Config
    scores: DataFrame | None = None

    def thresholds(self) -> DataFrame:
        return self.df.sparkSession.createDataFrame([tuple(r[c] for c in COLUMNS) for r in self.rows], SCHEMA)

    def __repr__(self) -> str:
        return f"<StateCalls {len(self.rows)} thresholds>"


def pairs(config: Config) -> list[tuple[str, str]]:
    return [(m.marker, p) for m in config.panel if m.role == "state" for p in m.parents]


def in_labels(label: Column, config: Config, parents: list[str]) -> Column:
    labels = sorted({x for p in parents for x in config.parent_sets[p]})
    return F.coalesce(label.isin(*labels), F.lit(False)) if labels else F.lit(False)


def min_ratio(config: Config, marker: str) -> float:
    rule = config.marker(marker).localization
    return rule.min_ratio if rule else 0.0


def long_states(prepared: Prepared, classification: Classification, scores: DataFrame | None = None) -> DataFrame:
    """keys, cell_type, marker, parent, in_parent, for_estimate, reference, supported, evaluable, score, ratio.

    for_estimate: in the parent, or for pooled markers in one of its parents; reference: true for the pool that it is
    compared with.
    """
    config = prepared.config
    if classification.scores is scores:
        joined = classification.full
    else:
        base = with_support(prepared if scores is None else Prepared(scores, config, prepared.support))
        joined = base.join(classification.df.select(*KEYS, "cell_type"), KEYS)
    label = F.col("cell_type")
    parts = []
    for marker, parent in pairs(config):
        m = config.marker(marker)
        args = m.full_args
        inside = in_labels(label, config, [parent])
        pool = in_labels(label, config, list(m.parents)) if args.get("pooled") and len(m.parents) > 1 else inside
        reference = args.get("reference", "rest")
        rest = ~pool if reference == "rest" else in_labels(label, config, [reference]) & ~pool
        supported = F.coalesce(col(f"ok_{marker}"), F.lit(False))
        parts.append(F.struct(F.lit(marker).alias("marker"), F.lit(parent).alias("parent"), inside.alias("in_parent"), pool.alias("for_estimate"), rest.alias("reference"), supported.alias("supported"), evaluable(config, marker).alias("evaluable"), col(f"score_{marker}").alias("score"), ratio_of(config, marker).alias("localization_ratio"), F.lit(min_ratio(config, marker)).alias("min_ratio")))
    require(parts, "the panel has no state markers", StateError)
    return joined.select(*KEYS, "cell_type", F.inline(F.array(*parts)))


def ratio_of(config: Config, marker: str) -> Column:
    return col(f"ratio_{marker}") if config.marker(marker).localization else F.lit(1.0)


def evaluable(config: Config, marker: str) -> Column:
    """Whether the row's own measurement can be called: support, a score, and a localization ratio where asked for."""
    located = F.coalesce(col(f"located_{marker}"), F.lit(False)) if config.marker(marker).localization else F.lit(True)
    return F.coalesce(col(f"ok_{marker}"), F.lit(False)) & available(marker) & located & finite(ratio_of(config, marker)) & finite(col(f"score_{marker}"))


def estimate_states(long: DataFrame, config: Config, status: dict[tuple[str, str], tuple[str, str]]) -> list[dict[str, Any]]:
    """Threshold rows of all images, state markers and parents."""
    images = sorted({i for i, _ in status})
    settled: dict[tuple[str, str], est.Estimate] = {}
    manual_pools: list[tuple[str, str]] = []
    for image in images:
        for marker, parent in pairs(config):
            m = config.marker(marker)
            state, details = status.get((image, marker), ("NOT_CALLABLE_UNAVAILABLE", "Nothing is known about the marker's support."))
            key = (image, f"{marker}\t{parent}")
            if state.startswith("NOT_CALLABLE"):
                settled[key] = est.Estimate(state, details=details)
            elif m.method == "manual":
                settled[key] = est.manual(m.full_args)
                manual_pools.append(key)
    usable = long.where("supported and (for_estimate or reference)").where(finite(F.col("score"))).withColumn("marker", F.concat("marker", F.lit("\t"), "parent"))
    if manual_pools:
        sizes = usable.groupBy("image_id", "marker").agg(F.count_if("for_estimate").alias("p"), F.count_if("reference").alias("r"))
        for r in sizes.collect():
            if (r.image_id, r.marker) in manual_pools:
                settled[r.image_id, r.marker].n_positive_pool, settled[r.image_id, r.marker].n_negative_pool = r.p, r.r
    open_markers = {f"{m}\t{p}": config.marker(m) for m, p in pairs(config) if config.marker(m).method != "manual"}
    if open_markers and any((i, k) not in settled for i in images for k in open_markers):
        ready(long.sparkSession)
        plan = {k: (m.method, m.full_args, m.support) for k, m in open_markers.items()}
        keys = ["image_id", "marker"]
        some = usable.where(F.col("marker").isin(*open_markers)).withColumnRenamed("score", "v").select(*keys, "for_estimate", "reference", "v")
        weighted = points(some, [*keys, "for_estimate", "reference"])
        big = large_groups(weighted, keys)
        named = small(long.sparkSession.createDataFrame(sorted(big), "image_id string, marker string"), len(big))

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            method, args, support = plan[key[1]]
            positive = est.Points.of(pdf.v[pdf.for_estimate], pdf.w[pdf.for_estimate])
            if method == "parent_crossing":
                reference = est.Points.of(pdf.v[pdf.reference], pdf.w[pdf.reference])
                e = est.parent_crossing(positive, reference, args, support.min_auc, support.min_cells)
            else:
                e = est.ESTIMATORS[method](positive, args)
            return result_frame(*key, e)

        found = collected(weighted.join(named, keys, "left_anti").groupBy(*keys).applyInPandas(run, RESULT))
        if big:
            values = stored(some.join(named, keys, "left_semi"), "values")
            crossed = {k: (plan[k[1]][1], plan[k[1]][2].min_auc, plan[k[1]][2].min_cells) for k in big if plan[k[1]][0] == "parent_crossing"}
            if crossed:
                both = F.array(*(F.struct(F.lit(side).alias("inside"), F.col(c).alias("here")) for side, c in ((True, "for_estimate"), (False, "reference"))))
                found |= large.parents(stored(values.select(*keys, "v", F.inline(both)).where("here").drop("here"), "pools"), crossed)
            others = {k: plan[k[1]][:2] for k in big if plan[k[1]][0] != "parent_crossing"}
            if others:
                found |= estimate_groups(values.where("for_estimate").select(*keys, "v"), others)[0]
        found = {k: e if plan[k[1]][0] == "parent_crossing" else est.enforce_pools(e, plan[k[1]][2].min_cells) for k, e in found.items()}
        settled = found | settled
    rows = []
    for image in images:
        for marker, parent in pairs(config):
            m = config.marker(marker)
            e = settled.get((image, f"{marker}\t{parent}"), est.Estimate(est.UNDERPOWERED, details="The parent or what it is compared with holds too few cells."))
            rows.append(_row(image, marker, parent, "state", m.method, m.full_args, e, None))
    return rows


def call_states(long: DataFrame, rows: list[dict[str, Any]]) -> DataFrame:
    """The long table with estimates joined (broadcast: images x pairs rows) and positivity; nothing is enabled yet."""
    cuts = long.sparkSession.createDataFrame([(r["image_id"], r["marker"], r["parent"], r["estimate"] if r["status"] in ("CALLABLE", "MANUAL") else None, r["estimate"]) for r in rows], "image_id string, marker string, parent string, cut double, estimate double")
    joined = long.join(small(cuts, len(rows)), ["image_id", "marker", "parent"], "left")
    return joined.select(*KEYS, "marker", "parent", "in_parent", "evaluable", "score", "estimate", "localization_ratio", positive(F.col("cut")).alias("positive"), F.lit(False).alias("enabled"))


def positive(cut: Column) -> Column:
    return F.coalesce(F.col("evaluable") & F.col("in_parent") & (F.col("localization_ratio") >= F.col("min_ratio")) & cut.isNotNull() & (F.col("score") >= cut), F.lit(False))


def state_calls(prepared: Prepared, classification: Classification, scores: DataFrame | None = None) -> StateCalls:
    require(classification.config.digest() == prepared.config.digest(), "inputs do not share a configuration", StateError)
    require(not classification.score_digest or not prepared.source or classification.score_digest in (prepared.source, score_digest(prepared, scores)), "labels belong to another table", StateError)
    long = long_states(prepared, classification, scores)
    rows = estimate_states(long, prepared.config, support_map(prepared))
    return StateCalls(call_states(long, rows), tuple(rows), prepared.config, scores)


def completeness(states: DataFrame, cells: DataFrame, config: Config) -> DataFrame:
    """Keys that are missing (n = 0) or repeat (n > 1) in a state table; empty when it is complete."""
    spark = cells.sparkSession
    want = cells.select(*KEYS).crossJoin(F.broadcast(spark.createDataFrame(pairs(config), "marker string, parent string")))
    keys = [*KEYS, "marker", "parent"]
    found = states.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return want.join(found, keys, "full_outer").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> 1")


def validate_states(prepared: Prepared, classification: Classification, calls: StateCalls) -> None:
    """Refuses a state table that is incomplete, or whose parents, evaluability, ratios or positivity are not what the
    labels, scores and cuts give; one pass of set differences."""
    require(completeness(calls.df, prepared.df, calls.config).isEmpty(), "the state table lacks or repeats cells", StateError)
    fresh = call_states(long_states(prepared, classification, calls.scores), list(calls.rows)).drop("enabled")
    given = calls.df.select(*fresh.columns)
    wrong = given.exceptAll(fresh).first()
    require(wrong is None, f"a state does not follow from its cell: {wrong}", StateError)
