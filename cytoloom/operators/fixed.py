"""Fixed ternary calls, declarative candidate rules, and state diagnostics: projections with literals."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InputError, require
from ..functions.columns import LOCALIZATION_OFFSET, INFINITY, col, finite

STATES = ("HIGH", "LOW", "UNAVAILABLE")


def _known(value: float | None) -> bool:
    return value is not None and abs(value) < INFINITY


def ternary(score: Column, cutoff: float | None, enabled: bool, usable: Column | None = None) -> Column:
    if not enabled or not _known(cutoff):
        return F.lit("UNAVAILABLE")
    ok = finite(score) if usable is None else finite(score) & usable
    return F.when(ok, F.when(score >= F.lit(float(cutoff)), "HIGH").otherwise("LOW")).otherwise("UNAVAILABLE")


def threshold_calls(scores: DataFrame, keys: list[str], cutoffs: dict[str, float | None], enabled: dict[str, bool]) -> DataFrame:
    """keys and one HIGH / LOW / UNAVAILABLE column for each marker."""
    markers = [c for c in scores.columns if c not in keys]
    require(list(cutoffs) == markers and list(enabled) == markers, "cutoffs and enablement must name the columns, in order", InputError)
    return scores.select(*keys, *(ternary(col(m), cutoffs[m], enabled[m]).alias(m) for m in markers))


def signal_calls(df: DataFrame, keys: list[str], markers: list[str], selected: dict[str, str], source: dict[str, str], features: list[str], cutoffs: dict[str, float | None], enabled: dict[str, bool], min_finite: int = 20) -> tuple[DataFrame, DataFrame]:
    """Ternary calls that also need support. ``selected`` and ``source``: marker -> column of the selected signal, and of
    the name of the feature it came from; ``features``: raw feature columns.

    A marker needs min_finite non-negative finite selected values and two different ones, the named feature min_finite
    finite values and two different ones, over the whole table; and the feature's value must be finite in the row.
    Returns (calls, support), support with a row for each marker and feature.
    """
    require(min_finite >= 2 and isinstance(min_finite, int), "min_finite must be a count of at least 2")
    require(list(cutoffs) == markers and list(enabled) == markers, "cutoffs and enablement must name the markers, in order")
    named = lambda kind, name, c, extra: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.count_if(finite(c) & extra).alias("n"), (F.max(F.when(finite(c) & extra, c)) > F.min(F.when(finite(c) & extra, c))).alias("varied"))
    parts = [named("marker", m, col(selected[m]), col(selected[m]) >= 0) for m in markers] + [named("feature", f, col(f), F.lit(True)) for f in features]
    support = df.agg(F.array(*parts).alias("s")).select(F.inline("s")).select("kind", "name", ((F.col("n") >= min_finite) & F.coalesce("varied", F.lit(False))).alias("supported"))
    wide = support.agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit("|"), "name"), "supported"))).alias("_support"))
    joined = df.crossJoin(F.broadcast(wide))  # one row
    calls = []
    for m in markers:
        name = col(source[m])
        value = F.lit(None).cast("double")
        for f in features:
            value = F.when(name == f, col(f)).otherwise(value)
        usable = finite(value) & finite(col(selected[m])) & (col(selected[m]) >= 0) & F.coalesce(F.col("_support")[F.concat(F.lit("feature|"), name)], F.lit(False)) & F.coalesce(F.col("_support")[F.lit(f"marker|{m}")], F.lit(False))
        calls.append(ternary(col(m), cutoffs[m], enabled[m], usable).alias(f"call_{m}"))
    return joined.select(*keys, *calls), support


@dataclass(frozen=True)
class Candidate:
    """All of ``all`` and, if there are any, one of ``any``: marker -> allowed states."""

    id: str
    label: str
    all: dict[str, tuple[str, ...]] = field(default_factory=dict)
    any: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        require(self.id and self.label, "a rule needs an id and a label")
        for allowed in (*self.all.values(), *self.any.values()):
            require(allowed and set(allowed) <= set(STATES) and len(set(allowed)) == len(allowed), f"{self.id}: allowed states are {STATES}")

    def column(self) -> Column:
        out = F.lit(True)
        for m, allowed in self.all.items():
            out = out & col(m).isin(*allowed)
        if self.any:
            one = F.lit(False)
            for m, allowed in self.any.items():
                one = one | col(m).isin(*allowed)
            out = out & one
        return out


def candidate_rules(calls: DataFrame, keys: list[str], rules: list[Candidate], default: str) -> DataFrame:
    """keys, label, rule_id of the last matching rule, and two authorizations that are always false."""
    require(default and len({r.id for r in rules}) == len(rules), "rule ids repeat, or there is no default label")
    require(all(set(r.all) | set(r.any) <= set(calls.columns) for r in rules), "a rule names an unknown marker")
    label, rule_id = F.lit(default), F.lit(None).cast("string")
    for r in rules:
        label, rule_id = F.when(r.column(), F.lit(r.label)).otherwise(label), F.when(r.column(), F.lit(r.id)).otherwise(rule_id)
    return calls.select(*keys, label.alias("label"), rule_id.alias("rule_id"), F.lit(False).alias("review_authorized"), F.lit(False).alias("production_eligible"))


@dataclass(frozen=True)
class DiagnosticState:
    value: str
    cutoff: float | None
    parent: str
    numerator: str | None = None
    denominator: str | None = None
    minimum: float | None = None
    audit_missing: str = "false"

    def __post_init__(self) -> None:
        require(self.audit_missing in ("false", "propagate"), "audit_missing is false or propagate")
        require(self.minimum is None or _known(self.minimum), "a localization minimum must be finite")
        require((self.minimum is None) == (self.numerator is None) == (self.denominator is None), "localization needs both operands and a minimum")


def state_diagnostics(df: DataFrame, keys: list[str], states: dict[str, DiagnosticState], offset: float = LOCALIZATION_OFFSET) -> DataFrame:
    """A row for each row and state: audit_positive (three-valued), measurement_evaluable, nullable_positive, and a
    status whose order is measurement, threshold, parent, evaluable."""
    require(offset >= 0 and _known(offset), "the offset must be finite and not negative")
    parts = []
    for name, s in states.items():
        value, parent = col(s.value), col(s.parent)
        measured, threshold = finite(value), _known(s.cutoff)
        above = F.when(finite(value), value >= F.lit(s.cutoff)) if s.cutoff is not None else F.lit(None).cast("boolean")
        if s.minimum is not None:
            num, den = col(s.numerator) + F.lit(offset), col(s.denominator) + F.lit(offset)
            ratio = F.try_divide(num, den)
            measured = measured & finite(col(s.numerator)) & finite(col(s.denominator)) & finite(num) & finite(den) & F.coalesce(den != 0, F.lit(False)) & finite(ratio)
            above = above & (ratio >= F.lit(s.minimum))
        missing = F.lit(False) if s.audit_missing == "false" else F.lit(None).cast("boolean")
        audit = F.when(measured, above).otherwise(missing) & parent & F.lit(threshold)
        sure = F.coalesce(parent, F.lit(False))
        status = F.when(~measured, "UNAVAILABLE_MEASUREMENT_OR_LOCALIZATION")
        status = status.when(F.lit(not threshold), "UNAVAILABLE_THRESHOLD").when(~sure, "PARENT_INELIGIBLE_OR_UNKNOWN").otherwise("EVALUABLE_RULE_ONLY")
        parts.append(F.struct(F.lit(name).alias("state"), audit.alias("audit_positive"), measured.alias("measurement_evaluable"), parent.alias("parent_eligible"), F.lit(threshold).alias("threshold_available"), status.alias("diagnostic_status"), F.when(measured & sure & F.lit(threshold), audit).alias("nullable_positive")))
    return df.select(*keys, F.inline(F.array(*parts))).withColumns({"review_authorized": F.lit(False), "production_eligible": F.lit(False)})
