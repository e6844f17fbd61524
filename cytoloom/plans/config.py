"""Configuration objects, their checks, their JSON form and digest.

All are small and live on the driver; operators turn them into column expressions.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from ..errors import ConfigError, require
from ..functions.canonical import canonical, sha256
from .methods import COMPARTMENTS, IDENTITY_ROLES, METHODS, ROLES, TRANSFORMS, method_args

FLAG_POLICIES = ("exclude", "flag_only", "unresolved")
ON_UNCALLABLE = ("disable_rule", "treat_as_negative")
DECISIONS = ("Tumor", "Benign", "Unresolved")
SCHEMA = "cytoloom-config-1.0.0"


def _name(value: object, what: str) -> None:
    require(isinstance(value, str) and value and value == value.strip() and ":" not in value, f"{what} {value!r} must be text without outer blanks or colons", ConfigError)


def _number(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)


@dataclass(frozen=True)
class Signal:
    """Which measurement stands for a marker: the preferred compartment, else the fallback, if finite and >= min_value."""

    marker: str
    compartment: str = "cell"
    statistic: str = "mean"
    fallback: str | None = None
    min_value: float = 0.0

    def __post_init__(self) -> None:
        _name(self.marker, "marker")
        _name(self.statistic, "statistic")
        require(self.compartment in COMPARTMENTS and self.fallback in (None, *COMPARTMENTS), f"{self.marker}: compartments are {COMPARTMENTS}", ConfigError)
        require(self.fallback != self.compartment, f"{self.marker}: the fallback is the preferred compartment", ConfigError)
        require(_number(self.min_value), f"{self.marker}: min_value must be finite", ConfigError)


def signal_policy(markers: Iterable[str], compartment: Any = "cell", statistic: Any = "mean", fallback: Any = None, min_value: Any = 0.0) -> tuple[Signal, ...]:
    """A policy for several markers; single values serve all of them."""
    markers = list(markers)
    spread = lambda x: list(x) if isinstance(x, (list, tuple)) else [x] * len(markers)
    columns = [spread(x) for x in (compartment, statistic, fallback, min_value)]
    require(all(len(c) == len(markers) for c in columns), "one value for each marker, or one for all", ConfigError)
    require(len(set(markers)) == len(markers), "markers repeat", ConfigError)
    return tuple(Signal(*row) for row in zip(markers, *columns, strict=True))


@dataclass(frozen=True)
class MinSupport:
    min_cells: int = 20
    max_unavailable: float = 0.2
    min_auc: float = 0.65
    near_constant_mode_fraction: float = 0.99

    def __post_init__(self) -> None:
        require(isinstance(self.min_cells, int) and self.min_cells >= 1, "min_cells must be a count", ConfigError)
        for name in ("max_unavailable", "min_auc", "near_constant_mode_fraction"):
            require(_number(getattr(self, name)) and 0 <= getattr(self, name) <= 1, f"{name} must lie between 0 and 1", ConfigError)


@dataclass(frozen=True)
class Localization:
    numerator: str
    denominator: str
    min_ratio: float
    statistic: str = "mean"

    def __post_init__(self) -> None:
        require({self.numerator, self.denominator} <= set(COMPARTMENTS) and self.numerator != self.denominator, "localization needs two different compartments", ConfigError)
        require(_number(self.min_ratio) and self.min_ratio > 0, "min_ratio must be positive", ConfigError)


@dataclass(frozen=True)
class Marker:
    marker: str
    role: str = "identity"
    transform: str = "none"
    cofactor: float | None = None
    method: str = "valley"
    args: dict[str, Any] = field(default_factory=dict)
    parents: tuple[str, ...] = ()
    localization: Localization | None = None
    support: MinSupport = MinSupport()
    optional: bool = False

    def __post_init__(self) -> None:
        _name(self.marker, "marker")
        require(self.role in ROLES, f"{self.marker}: roles are {ROLES}", ConfigError)
        require(self.transform in TRANSFORMS, f"{self.marker}: transforms are {TRANSFORMS}", ConfigError)
        require(self.transform != "asinh" or _number(self.cofactor) and self.cofactor > 0, f"{self.marker}: asinh needs a positive cofactor", ConfigError)
        if self.role != "context":
            args = method_args(self.method, self.args, self.role)
            require(self.method != "manual" or _number(args["value"]), f"{self.marker}: a manual value must be finite", ConfigError)
        require(self.role != "state" or self.parents, f"{self.marker}: a state marker needs parents", ConfigError)
        object.__setattr__(self, "parents", tuple(self.parents))

    @property
    def gated(self) -> bool:
        return self.role in IDENTITY_ROLES

    @property
    def full_args(self) -> dict[str, Any]:
        return method_args(self.method, self.args, self.role)


def panel(*parts: Marker | Iterable[Marker]) -> tuple[Marker, ...]:
    """Markers and panels in one panel; a marker may occur once."""
    out = [m for p in parts for m in ([p] if isinstance(p, Marker) else p)]
    names = [m.marker for m in out]
    require(out and len(set(names)) == len(names), "a panel needs markers, each once", ConfigError)
    return tuple(out)


@dataclass(frozen=True)
class Terms:
    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for name in ("all_of", "any_of", "none_of"):
            object.__setattr__(self, name, tuple(getattr(self, name)))

    @property
    def markers(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.all_of, *self.any_of, *self.none_of)))


@dataclass(frozen=True)
class Flag(Terms):
    def __post_init__(self) -> None:
        super().__post_init__()
        require(self.all_of or self.any_of, "a flag needs a positive term", ConfigError)


@dataclass(frozen=True)
class Rule(Terms):
    rule_id: str = ""
    label: str = ""
    on_uncallable: str = "disable_rule"
    review: bool = False
    pending_label: str | None = None
    decisions: dict[str, str] | None = None

    def __post_init__(self) -> None:
        super().__post_init__()
        _name(self.rule_id, "rule_id")
        require(self.label, f"{self.rule_id}: a rule needs a label", ConfigError)
        require(self.markers, f"{self.rule_id}: a rule needs markers", ConfigError)
        require(not set(self.none_of) & {*self.all_of, *self.any_of}, f"{self.rule_id}: a marker is both required and excluded", ConfigError)
        require(self.on_uncallable in ON_UNCALLABLE, f"{self.rule_id}: on_uncallable is one of {ON_UNCALLABLE}", ConfigError)
        if self.review:
            require(self.pending_label and self.decisions and set(self.decisions) == set(DECISIONS), f"{self.rule_id}: a review rule needs a pending label and decisions {DECISIONS}", ConfigError)
        else:
            require(self.pending_label is None and self.decisions is None, f"{self.rule_id}: only review rules have pending labels and decisions", ConfigError)

    def labels(self) -> list[str]:
        return [self.pending_label, *self.decisions.values()] if self.review else [self.label]


@dataclass(frozen=True)
class Hierarchy:
    rules: tuple[Rule, ...]
    flags: dict[str, Flag] = field(default_factory=dict)
    flag_policy: dict[str, str] = field(default_factory=dict)
    undefined_label: str = "Undefined"
    excluded_label: str = "Excluded"
    unresolved_label: str = "Unresolved"
    version: str = "1.0.0"
    rationale: str = ""

    def __post_init__(self) -> None:
        object.__setattr__(self, "rules", tuple(self.rules))
        ids = [r.rule_id for r in self.rules]
        require(ids and len(set(ids)) == len(ids), "a hierarchy needs rules with different ids", ConfigError)
        require(set(self.flags) == set(self.flag_policy) and all(p in FLAG_POLICIES for p in self.flag_policy.values()), f"each flag has a policy of {FLAG_POLICIES}", ConfigError)

    def labels(self) -> list[str]:
        """Every label that a record can get before refinements."""
        return list(dict.fromkeys([x for r in self.rules for x in r.labels()] + [self.undefined_label, self.excluded_label, self.unresolved_label]))

    def table(self) -> list[dict[str, Any]]:
        return [{"order": k, "rule_id": r.rule_id, "label": r.label, "all_of": list(r.all_of), "any_of": list(r.any_of), "none_of": list(r.none_of), "review": r.review} for k, r in enumerate(self.rules, 1)]


@dataclass(frozen=True)
class Refinement:
    rule_id: str
    marker: str
    parent: str
    from_label: str
    to_label: str


@dataclass(frozen=True)
class Override:
    image_id: str
    marker: str
    reason: str
    method: str | None = None
    args: dict[str, Any] | None = None
    parent: str | None = None

    def __post_init__(self) -> None:
        require(self.reason and self.reason.strip(), "an override needs a reason", ConfigError)
        require(self.method or self.args is not None, "an override changes the method or its arguments", ConfigError)


@dataclass(frozen=True)
class Config:
    policy: tuple[Signal, ...]
    panel: tuple[Marker, ...]
    parent_sets: dict[str, tuple[str, ...]]
    hierarchy: Hierarchy
    overrides: tuple[Override, ...] = ()
    refinements: tuple[Refinement, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "policy", tuple(self.policy))
        object.__setattr__(self, "panel", panel(self.panel))
        object.__setattr__(self, "parent_sets", {k: tuple(v) for k, v in self.parent_sets.items()})

    def __repr__(self) -> str:
        return f"<Config {len(self.panel)} markers, {len(self.hierarchy.rules)} rules, {self.digest()[:12]}>"

    def marker(self, name: str) -> Marker:
        return next(m for m in self.panel if m.marker == name)

    def signal(self, name: str) -> Signal:
        return next(s for s in self.policy if s.marker == name)

    def markers(self, *roles: str) -> list[str]:
        return [m.marker for m in self.panel if not roles or m.role in roles]

    @property
    def gated(self) -> list[str]:
        return self.markers(*IDENTITY_ROLES)

    @property
    def states(self) -> list[str]:
        return self.markers("state")

    def override(self, image: str, marker: str) -> Override | None:
        """The first override of an identity marker on an image; overrides with a parent never apply here."""
        return next((o for o in self.overrides if (o.image_id, o.marker, o.parent) == (image, marker, None)), None)

    def checks(self) -> list[dict[str, Any]]:
        """A row for each check: check, ok, details. None stops at the first failure."""
        names, gated, states = set(self.markers()), set(self.gated), set(self.states)
        labels = set(self.hierarchy.labels()) | {r.to_label for r in self.refinements}
        pairs = {(m.marker, p) for m in self.panel for p in m.parents}

        def row(name: str, wrong: Iterable[object]) -> dict[str, Any]:
            wrong = sorted(map(str, wrong))
            return {"check": name, "ok": not wrong, "details": ", ".join(wrong)}

        return [
            row("panel_in_policy", names - {s.marker for s in self.policy}),
            row("rule_markers", {m for r in self.hierarchy.rules for m in r.markers} - gated),
            row("flag_markers", {m for f in self.hierarchy.flags.values() for m in f.markers} - gated),
            row("state_parents", {p for m in self.panel for p in m.parents} - set(self.parent_sets)),
            row("parent_labels", {x for v in self.parent_sets.values() for x in v} - labels),
            row("refinements", [r.rule_id for r in self.refinements if r.marker not in states or (r.marker, r.parent) not in pairs or r.from_label not in labels]),
            row("overrides", [f"{o.image_id}/{o.marker}" for o in self.overrides if not self._override_ok(o, pairs)]),
        ]

    def _override_ok(self, o: Override, pairs: set) -> bool:
        found = [m for m in self.panel if m.marker == o.marker]
        if not found or (o.parent is None) != (found[0].role != "state") or o.parent is not None and (o.marker, o.parent) not in pairs:
            return False
        try:
            method_args(o.method or found[0].method, o.args if o.args is not None else found[0].args, found[0].role)
        except ConfigError:
            return False
        return True

    def checked(self) -> Config:
        failed = [c for c in self.checks() if not c["ok"]]
        require(not failed, "; ".join(f"{c['check']}: {c['details']}" for c in failed), ConfigError)
        return self

    def to_dict(self) -> dict[str, Any]:
        plain = lambda x: {f.name: plain(getattr(x, f.name)) for f in fields(x)} if hasattr(x, "__dataclass_fields__") else [plain(v) for v in x] if isinstance(x, (list, tuple)) else {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else x
        return {"schema": SCHEMA, **plain(self)}

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> Config:
        require(isinstance(d, dict) and d.get("schema") == SCHEMA, f"the schema must be {SCHEMA}", ConfigError)
        try:
            markers = [Marker(**(m | {"localization": m["localization"] and Localization(**m["localization"]), "support": MinSupport(**m["support"])})) for m in d["panel"]]
            h = d["hierarchy"]
            hierarchy = Hierarchy(**(h | {"rules": tuple(Rule(**r) for r in h["rules"]), "flags": {k: Flag(**f) for k, f in h["flags"].items()}}))
            return cls(tuple(Signal(**s) for s in d["policy"]), tuple(markers), d["parent_sets"], hierarchy, tuple(Override(**o) for o in d["overrides"]), tuple(Refinement(**r) for r in d["refinements"]))
        except (KeyError, TypeError) as e:
            raise ConfigError(f"a part of the configuration is missing or unknown: {e}") from e

    def digest(self) -> str:
        return sha256(canonical(self.to_dict()))


def validate(build: Callable[[], Config] | Config) -> list[dict[str, Any]]:
    """The check table of a configuration, with a row for its construction; never raises for wrong content."""
    try:
        config = build() if callable(build) else build
    except ConfigError as e:
        return [{"check": "construction", "ok": False, "details": str(e)}]
    return [{"check": "construction", "ok": True, "details": ""}, *config.checks()]


def write_config(config: Config, path: str) -> None:
    target = Path(path)
    staged = target.with_name(f".{target.name}.{os.getpid()}")
    staged.write_text(canonical(config.checked().to_dict()) + "\n")
    os.replace(staged, target)


def read_config(path: str) -> Config:
    return Config.from_dict(json.loads(Path(path).read_text())).checked()


def with_manual_cuts(config: Config, cuts: dict[str, float]) -> Config:
    """The configuration with manual thresholds for some markers."""
    return replace(config, panel=tuple(replace(m, method="manual", args={"value": cuts[m.marker]}) if m.marker in cuts else m for m in config.panel))


def json_schema() -> dict[str, Any]:
    """A JSON Schema (draft 7) of the configuration's JSON form, made from the classes. Cross-references are left to
    ``validate``."""
    kinds = {"str": {"type": "string"}, "bool": {"type": "boolean"}, "int": {"type": "integer"}, "float": {"type": "number"}, "Any": {}}

    def of_type(text: str) -> dict[str, Any]:
        text = text.strip()
        if text.endswith("| None"):
            return {"anyOf": [of_type(text.removesuffix("| None")), {"type": "null"}]}
        if text.startswith("tuple["):
            return {"type": "array", "items": of_type(text[6:].removesuffix("]").removesuffix(", ..."))}
        if text.startswith("dict["):
            return {"type": "object", "additionalProperties": of_type(text[5:].removesuffix("]").split(", ", 1)[1])}
        return kinds[text] if text in kinds else of_class(globals()[text])

    def of_class(cls: type, **extra: Any) -> dict[str, Any]:
        named = {f.name: of_type(f.type) for f in fields(cls)}
        choices = {"role": list(ROLES), "transform": list(TRANSFORMS), "compartment": list(COMPARTMENTS), "method": [*METHODS]}
        for name, values in choices.items():
            if name in named:
                optional = "anyOf" in named[name]
                named[name] = {"enum": [*values, None] if optional else values}
        properties = {**extra, **named}
        return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}

    return {"$schema": "http://json-schema.org/draft-07/schema#", "title": "Configuration", **of_class(Config, schema={"const": SCHEMA})}
