"""Classification: cuts, flags and ordered rules compiled to one projection.

Cuts and rule switches are pivoted to one row for each image and broadcast (images x markers values); everything else is
CASE expressions. A call is true, false, or NULL where the marker is not callable on the image.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DisabledRules, StateError, require
from ..functions.columns import all_true, any_true, col, finite, none_true
from ..plans.config import Config, Rule, Terms
from ..storage import small
from .prepare import Prepared, available, score_digest, support_map, with_support
from .thresholds import Thresholds, validate_thresholds


@dataclass(frozen=True)
class Classification:
    """df: keys, cell_type, rule_id, pending_review, flag columns, excluded; calls: keys and call_<marker>; full: both
    with all prepared columns, so that nobody needs to join them by key. disabled: rows on the driver. ``scores`` is the
    corrected table that the calls were made from, if any."""

    df: DataFrame
    calls: DataFrame
    disabled: tuple[dict[str, str], ...]
    config: Config
    full: DataFrame
    scores: DataFrame | None = None
    support: DataFrame | None = None
    score_digest: str = ""

    def callability(self) -> DataFrame:
        return self.support

    def summary(self) -> DataFrame:
        return summary(self.df)

    def __repr__(self) -> str:
        return f"<Classification {len(self.config.hierarchy.rules)} rules, {len(self.disabled)} disabled>"


def cut_row(prepared: Prepared, cuts: Thresholds) -> dict[str, dict[str, float | None]]:
    """image -> marker -> cut, None where the marker isn't callable there. Lookups go by key."""
    status = support_map(prepared)
    out: dict[str, dict[str, float | None]] = {}
    for image in sorted({i for i, _ in status}):
        fine = lambda m: not status.get((image, m), ("NOT_CALLABLE",))[0].startswith("NOT_CALLABLE")  # noqa: B023, E731
        out[image] = {m: cuts.cut(image, m) if fine(m) else None for m in prepared.config.gated}
    return out


def disabling(rule: Rule, callable_markers: set[str]) -> tuple[list[str], str]:
    """Markers for which the rule is off on an image, and why; every marker of any_of must be callable too."""
    required = [m for m in dict.fromkeys((*rule.all_of, *rule.any_of)) if m not in callable_markers]
    excluded = [m for m in rule.none_of if m not in callable_markers] if rule.on_uncallable == "disable_rule" else []
    reason = "A marker that the rule needs cannot be called on the image." if required else "A marker that the rule excludes cannot be called on the image, and the rule is to be off then." if excluded else ""
    return list(dict.fromkeys([*required, *excluded])), reason


def disabled_rules(config: Config, by_image: dict[str, dict[str, float | None]]) -> list[dict[str, str]]:
    out = []
    for image, cuts in by_image.items():
        on = {m for m, c in cuts.items() if c is not None}
        for rule in config.hierarchy.rules:
            off, reason = disabling(rule, on)
            if off:
                out.append({"image_id": image, "rule_id": rule.rule_id, "label": rule.label, "reason": reason, "markers": ",".join(off)})
    return out


def matches(terms: Terms) -> Column:
    """NULL calls are not positive, and negative where excluded; rules that are to be off instead are switched off by
    image."""
    call = lambda names: [col(f"call_{m}") for m in names]
    out = all_true(call(terms.all_of)) & none_true(call(terms.none_of))
    return out & any_true(call(terms.any_of)) if terms.any_of else out


def label_columns(config: Config) -> list[Column]:
    """cell_type, rule_id, pending_review, flags, excluded, over call_<marker> and on_<rule number>."""
    h = config.hierarchy
    flags = {name: matches(f) for name, f in h.flags.items()}
    by_policy = lambda p: any_true([flags[n] for n in flags if h.flag_policy[n] == p])
    exclude, unresolved = by_policy("exclude"), by_policy("unresolved")
    hits = [col(f"on_{k}") & matches(r) for k, r in enumerate(h.rules)]
    kind = F.when(exclude, F.lit(h.excluded_label)).when(unresolved, F.lit(h.unresolved_label))
    none = F.lit(None).cast("string")
    rule = F.when(exclude | unresolved, none)
    pending = F.when(exclude | unresolved, F.lit(False))
    for hit, r in zip(hits, h.rules, strict=True):
        kind, rule, pending = kind.when(hit, F.lit(r.pending_label if r.review else r.label)), rule.when(hit, F.lit(r.rule_id)), pending.when(hit, F.lit(r.review))
    return [kind.otherwise(F.lit(h.undefined_label)).alias("cell_type"), rule.otherwise(none).alias("rule_id"), pending.otherwise(F.lit(False)).alias("pending_review"), *(c.alias(n) for n, c in flags.items()), exclude.alias("excluded")]


def call_columns(config: Config) -> list[Column]:
    return [F.when(col(f"cut_{m}").isNotNull(), F.coalesce(available(m) & finite(col(f"score_{m}")) & (col(f"score_{m}") >= col(f"cut_{m}")), F.lit(False))).alias(f"call_{m}") for m in config.gated]


def classify(prepared: Prepared, cuts: Thresholds, scores: DataFrame | None = None, quiet: bool = False) -> Classification:
    """Calls, flags, first matching rules and labels of all cells."""
    config = prepared.config
    require(cuts.config_digest == config.digest(), "thresholds belong to another configuration", StateError)
    validate_thresholds(prepared, cuts, scores)
    by_image = cut_row(prepared, cuts)
    off = disabled_rules(config, by_image)
    if off and not quiet:
        warnings.warn(f"{len(off)} hierarchy rules disabled because required markers are not callable.", DisabledRules, stacklevel=2)
    switched = {(r["image_id"], r["rule_id"]) for r in off}
    base = with_support(prepared) if scores is None else with_support(Prepared(scores, config, prepared.support))
    full = labelled(base, config, by_image, off)
    return Classification(full.select("image_id", "cell_id", *label_names(config)), full.select("image_id", "cell_id", *(col(f"call_{m}") for m in config.gated)), tuple(off), config, full, scores, prepared.support, score_digest(prepared, scores))


def label_names(config: Config) -> list[str]:
    return ["cell_type", "rule_id", "pending_review", *config.hierarchy.flags, "excluded"]


def labelled(base: DataFrame, config: Config, by_image: dict[str, dict[str, float | None]], off: list[dict[str, str]]) -> DataFrame:
    """``base`` (over ``with_support``) with cut_, on_, call_ and label columns: cuts and switches joined by image, and a
    projection."""
    switched = {(r["image_id"], r["rule_id"]) for r in off}
    rows: list[tuple[Any, ...]] = [(i, *(c[m] for m in config.gated), *((i, r.rule_id) not in switched for r in config.hierarchy.rules)) for i, c in by_image.items()]
    schema = ", ".join(["image_id string", *(f"`cut_{m}` double" for m in config.gated), *(f"on_{k} boolean" for k in range(len(config.hierarchy.rules)))])
    cuts = base.sparkSession.createDataFrame(rows, schema)
    return base.join(small(cuts, len(rows)), "image_id").select("*", *call_columns(config)).select("*", *label_columns(config))


def summary(cells: DataFrame, image: str = "image_id", label: str = "cell_type") -> DataFrame:
    """n and proportion of every label on every image, with zeros; the cross is of distinct images and labels."""
    counts = cells.groupBy(image, label).agg(F.count(F.lit(1)).alias("n"))
    full = counts.select(image).distinct().crossJoin(counts.select(label).distinct()).join(counts, [image, label], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = counts.groupBy(image).agg(F.sum("n").alias("total"))
    return full.join(totals, image).select(image, label, F.col("n").cast("long").alias("n"), (F.col("n") / F.col("total")).alias("proportion"))
