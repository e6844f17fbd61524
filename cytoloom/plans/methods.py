"""The closed catalogue of threshold methods."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from ..errors import ConfigError, require

IDENTITY_ROLES = ("identity", "conditional_identity")
ROLES = (*IDENTITY_ROLES, "state", "context")
TRANSFORMS = ("none", "asinh", "log1p")
COMPARTMENTS = ("cell", "nucleus", "cytoplasm", "membrane")


@dataclass(frozen=True)
class Method:
    name: str
    roles: tuple[str, ...]
    defaults: dict[str, Any]
    required: tuple[str, ...] = ()


_GATED = (*IDENTITY_ROLES, "state")
#: The defaults of every method.
METHODS = {
    m.name: m
    for m in (
        Method("manual", _GATED, {}, ("value",)),
        Method("valley", _GATED, {"min_relative_height": 0.03, "grid_n": 4096, "lower_quantile": 0.001, "upper_quantile": 0.999, "min_depth": 0.1, "min_n": 100}),
        Method("tail", _GATED, {"peak_fraction": 0.10, "grid_n": 4096, "fallback_quantile": 0.99, "min_tail_excess": 2, "min_n": 100}),
        Method("mixture", _GATED, {"max_overlap": 0.2, "max_iter": 500, "tol": 1e-8, "min_n": 100}),
        Method("population_crossing", IDENTITY_ROLES, {"rule": "max_crossing_q99", "positive_z": 0.5, "negative_z": 0, "max_per_population": 1000, "n_grid": 2048, "negative_quantile": 0.99}),
        Method("parent_crossing", ("state",), {"reference": "rest", "n_grid": 2048}),
    )
}


def method_args(name: str, given: dict[str, Any] | None, role: str) -> dict[str, Any]:
    """Defaults overlaid with what is given; unknown and missing arguments are errors."""
    method = METHODS.get(name)
    require(method and role in method.roles, f"method {name} isn't one for {role} markers", ConfigError)
    args = dict(method.defaults) | ({"pooled": False} if role == "state" else {})
    unknown = set(given or {}) - set(args) - set(method.required)
    require(not unknown, f"{name} has no arguments {sorted(unknown)}", ConfigError)
    args |= given or {}
    missing = [a for a in method.required if a not in args]
    require(not missing, f"{name} needs {missing}", ConfigError)
    return args


def catalogue() -> list[dict[str, Any]]:
    """A row for each method: name, roles, required arguments, defaults."""
    return [{"method": m.name, "roles": list(m.roles), "required": list(m.required), "defaults": m.defaults} for m in METHODS.values()]
