"""Corrections of the score space, fitted across images, and residual models with frozen parameters.

A fit is a few aggregations whose results (k numbers, or k x k) come to the driver; applying one is a projection with
literals. Markers without support on an image stay NULL there whatever the method.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InputError, IntegrityError, StateError, require
from ..functions.canonical import sha256
from ..functions.columns import clip, col, finite
from ..storage import stored
from .order import whole_quantiles
from .prepare import Prepared, available, with_support

METHODS = ("none", "robust_z", "common_score_residual", "pc1_panel_residual")
MAD_SCALE, LIMIT = 1.4826, 5.0


@dataclass(frozen=True)
class Correction:
    """Parameters of a fit; everything needed to apply it again."""

    method: str
    markers: tuple[str, ...]
    fitted: tuple[str, ...]
    row_center: bool = False
    identity: tuple[str, ...] = ()
    median: dict[str, float] = field(default_factory=dict)
    mad: dict[str, float] = field(default_factory=dict)
    rotation: dict[str, float] = field(default_factory=dict)
    pc_center: dict[str, float] = field(default_factory=dict)
    slope: dict[str, float] = field(default_factory=dict)
    intercept: dict[str, float] = field(default_factory=dict)
    center: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    config_digest: str = ""
    source: str = ""  # the prepared table that it was fitted to

    def digest(self) -> str:
        return sha256(asdict(self))

    def __repr__(self) -> str:
        return f"<Correction {self.method}, {len(self.fitted)} of {len(self.markers)} markers>"


def _mean(columns: list[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total / F.lit(float(len(columns)))


def _z(x: Column, median: float, mad: float) -> Column:
    return clip((x - F.lit(median)) / F.lit(mad), -LIMIT, LIMIT)


def center_and_mad(df: DataFrame, names: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """Medians, and MADs times 1.4826 with 1 in the place of zero."""
    if not names:
        return {}, {}
    center = {n: math.nan if q is None else q for n, (q,) in whole_quantiles(df, names, [0.5]).items()}
    away = df.select(*(F.abs(col(n) - F.lit(center[n])).alias(n) for n in names))
    mad = {n: MAD_SCALE * q if q else 1.0 for n, (q,) in whole_quantiles(away, names, [0.5]).items()}
    return center, mad


def line(df: DataFrame, x: str, ys: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """Least squares slope and intercept of every y on x, in one aggregation."""
    parts = [F.struct(F.covar_samp(col(x), col(y)).alias("c"), F.var_samp(F.when(col(y).isNotNull(), col(x))).alias("v"), F.avg(F.when(col(y).isNotNull(), col(x))).alias("mx"), F.avg(col(y)).alias("my")).alias(f"r{k}") for k, y in enumerate(ys)]
    row = df.agg(*parts).first()
    slope = {y: (row[k].c / row[k].v if row[k].v else 0.0) for k, y in enumerate(ys)}
    return slope, {y: row[k].my - slope[y] * row[k].mx for k, y in enumerate(ys)}


def standard(df: DataFrame, names: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    row = df.agg(*(F.struct(F.avg(col(n)).alias("m"), F.stddev_samp(col(n)).alias("s")).alias(f"r{k}") for k, n in enumerate(names))).first()
    ok = lambda v: v is not None and math.isfinite(v)
    return {n: row[k].m if ok(row[k].m) else 0.0 for k, n in enumerate(names)}, {n: row[k].s if ok(row[k].s) and row[k].s > 0 else 1.0 for k, n in enumerate(names)}


def principal(df: DataFrame, names: list[str]) -> tuple[dict[str, float], dict[str, float], np.ndarray]:
    """Loadings of the first component, column means, and all components (columns, by falling variance). The largest
    loading of each is positive. One aggregation of k * (k + 1) / 2 covariances."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = df.agg(*(F.avg(col(n)) for n in names), *(F.covar_samp(col(names[i]), col(names[j])) for i, j in pairs)).first()
    cov = np.zeros((len(names), len(names)))
    for (i, j), v in zip(pairs, row[len(names) :], strict=True):
        cov[i, j] = cov[j, i] = v if v is not None else 0.0
    values, vectors = np.linalg.eigh(cov)
    vectors = vectors[:, np.argsort(-values, kind="stable")]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(names))])
    vectors = vectors * np.where(signs == 0, 1, signs)
    return dict(zip(names, vectors[:, 0].tolist(), strict=True)), dict(zip(names, map(float, row[: len(names)]), strict=True)), vectors


def _observed(prepared: Prepared, names: list[str]) -> DataFrame:
    """All columns, with x_<marker> the score where it may be used."""
    return with_support(prepared).select("*", *(F.when(available(m), col(f"score_{m}")).alias(f"x_{m}") for m in names))


def _first_component(c: Correction) -> Column:
    total = F.lit(0.0)
    for m in c.identity:
        total = total + (col(f"z_{m}") - F.lit(c.pc_center[m])) * F.lit(c.rotation[m])
    return total


def _residuals(df: DataFrame, c: Correction) -> DataFrame:
    """r_<marker> from z_<marker> by the fitted lines on the common score (mean or first component), with the row's mean
    taken off where asked for."""
    common = _mean([col(f"z_{m}") for m in c.fitted]) if c.method == "common_score_residual" else _first_component(c)
    df = df.withColumn("_common", common)
    df = df.select("*", *((col(f"z_{m}") - F.lit(c.intercept[m]) - F.lit(c.slope[m]) * F.col("_common")).alias(f"r_{m}") for m in c.fitted))
    if c.row_center:
        df = df.withColumn("_mean", _mean([col(f"r_{m}") for m in (c.fitted if c.method == "common_score_residual" else c.identity)]))
        df = df.withColumns({f"r_{m}": col(f"r_{m}") - F.col("_mean") for m in c.fitted})
    return df


def fit(prepared: Prepared, method: str, markers: list[str] | None = None, row_center: bool = False) -> Correction:
    require(method in METHODS, f"methods are {METHODS}")
    names = list(markers or prepared.config.gated)
    require(len(set(names)) == len(names) and set(names) <= set(prepared.markers), "unknown or repeated markers", InputError)
    observed = _observed(prepared, names)
    present = observed.agg(*(F.count(col(f"x_{m}")).alias(f"n{k}") for k, m in enumerate(names))).first()
    fitted = [m for k, m in enumerate(names) if present[k]]
    c = Correction(method, tuple(names), tuple(fitted), row_center, config_digest=prepared.config.digest(), source=prepared.source)
    if method == "none" or not fitted:
        return c
    xs = [f"x_{m}" for m in fitted]
    rows = stored(observed.select(*(col(x) for x in xs)).where(F.coalesce(*(col(x) for x in xs)).isNotNull()), "observed")
    median, mad = center_and_mad(rows, xs)
    bare = lambda d: {k.split("_", 1)[1]: v for k, v in d.items()}
    if method != "robust_z":
        # the residual fits need complete rows: gaps take the observed median, and spreads count them
        rows = rows.withColumns({x: F.coalesce(col(x), F.lit(median[x])) for x in xs})
        median, mad = center_and_mad(rows, xs)
    c = Correction(**(vars(c) | {"median": bare(median), "mad": bare(mad)}))
    if method == "robust_z":
        return c
    rows = rows.withColumns({f"z_{m}": _z(col(f"x_{m}"), c.median[m], c.mad[m]) for m in fitted})
    if method == "pc1_panel_residual":
        identity = [m for m in prepared.config.gated if m in fitted] or fitted
        rotation, center, _ = principal(rows, [f"z_{m}" for m in identity])
        c = Correction(**(vars(c) | {"identity": tuple(identity), "rotation": bare(rotation), "pc_center": bare(center)}))
        rows = rows.withColumn("_common", _first_component(c))
    else:
        rows = rows.withColumn("_common", _mean([col(f"z_{m}") for m in fitted]))
    slope, intercept = line(rows, "_common", [f"z_{m}" for m in fitted])
    c = Correction(**(vars(c) | {"slope": bare(slope), "intercept": bare(intercept)}))
    center, scale = standard(_residuals(rows.drop("_common"), c), [f"r_{m}" for m in fitted])
    return Correction(**(vars(c) | {"center": bare(center), "scale": bare(scale)}))


def apply(prepared: Prepared, c: Correction, markers: list[str] | None = None) -> DataFrame:
    """The prepared cells with score_ columns replaced for the correction's markers (or some of them)."""
    require(c.config_digest == prepared.config.digest(), "the correction belongs to another configuration", StateError)
    require(c.source == prepared.source, "the correction was fitted to another table; a frozen model can be carried over", StateError)
    chosen = list(markers or c.markers)
    require(set(chosen) <= set(c.markers), "markers that the correction doesn't have")
    df = _observed(prepared, list(c.markers))
    if c.method == "none" or not c.fitted:
        done = {m: col(f"x_{m}") for m in c.markers}
    elif c.method == "robust_z":
        done = {m: _z(col(f"x_{m}"), c.median[m], c.mad[m]) if m in c.fitted else F.lit(None).cast("double") for m in c.markers}
    else:
        df = df.withColumns({f"z_{m}": _z(F.coalesce(col(f"x_{m}"), F.lit(c.median[m])), c.median[m], c.mad[m]) for m in c.fitted})
        df = _residuals(df, c)
        done = {m: F.when(col(f"x_{m}").isNotNull(), (col(f"r_{m}") - F.lit(c.center[m])) / F.lit(c.scale[m])) if m in c.fitted else F.lit(None).cast("double") for m in c.markers}
    return df.select(*(done[n.removeprefix("score_")].alias(n) if n.startswith("score_") and n.removeprefix("score_") in chosen else col(n) for n in prepared.df.columns))


def correct(prepared: Prepared, method: str = "none", markers: list[str] | None = None, row_center: bool = False) -> tuple[DataFrame, Correction]:
    c = fit(prepared, method, markers, row_center)
    return apply(prepared, c), c


# --- frozen residual models -----------------------------------------------------------------------------------------

FROZEN_SCHEMA, MIN_ROWS = "frozen-residual-2", 20


@dataclass(frozen=True)
class FrozenModel:
    """Two spaces of parameters: identity residuals (common score, row-centred) and panel residuals (first component,
    mean identity residual taken off). Applying it looks at one row at a time."""

    markers: tuple[str, ...]
    identity: tuple[str, ...]
    identity_space: Correction
    panel_space: Correction
    provenance: dict[str, Any]
    schema: str = FROZEN_SCHEMA
    sha256: str = ""

    def payload(self) -> dict[str, Any]:
        spaces = {k: {n: ("NaN" if isinstance(v, float) and math.isnan(v) else v) for n, v in p.items()} if isinstance(p, dict) else p for s in ("identity_space", "panel_space") for k, p in ((f"{s}.{a}", b) for a, b in asdict(getattr(self, s)).items())}
        return {"schema": self.schema, "markers": list(self.markers), "identity": list(self.identity), "provenance": self.provenance, **spaces}


def _sealed(model: FrozenModel) -> FrozenModel:
    return FrozenModel(**(vars(model) | {"sha256": sha256(model.payload())}))


def _check_scores(df: DataFrame, markers: list[str], identity: list[str]) -> int:
    """Counts rows; infinities and NaN anywhere, or gaps in identity columns, are errors."""
    bad = [F.count_if(col(m).isNotNull() & ~finite(col(m))) for m in markers]
    gaps = [F.count_if(col(m).isNull()) for m in identity]
    row = df.agg(F.count(F.lit(1)), *bad, *gaps).first()
    require(not any(row[1:]), "scores hold NaN or infinite values, or identity markers have gaps")
    return row[0]


def fit_frozen(scores: DataFrame, markers: list[str], identity: list[str], provenance: dict[str, Any] | None = None) -> FrozenModel:
    """Fits both spaces to a table with one double column for each marker."""
    require(identity and set(identity) <= set(markers) and len(set(markers)) == len(markers), "identity markers must be among the markers")
    require(_check_scores(scores, markers, identity) >= MIN_ROWS, f"at least {MIN_ROWS} rows are needed", StateError)
    median, mad = center_and_mad(scores, markers)
    rows = scores.select(*(_z(col(m), median[m], mad[m]).alias(f"z_{m}") if not math.isnan(median[m]) else F.lit(None).cast("double").alias(f"z_{m}") for m in markers))

    def space(method: str, fitted: list[str]) -> Correction:
        c = Correction(method, tuple(fitted), tuple(fitted), True, tuple(identity), {m: median[m] for m in fitted}, {m: mad[m] for m in fitted})
        if method == "pc1_panel_residual":
            rotation, center, _ = principal(rows, [f"z_{m}" for m in identity])
            c = Correction(**(vars(c) | {"rotation": {k[2:]: v for k, v in rotation.items()}, "pc_center": {k[2:]: v for k, v in center.items()}}))
            common = _first_component(c)
        else:
            common = _mean([col(f"z_{m}") for m in fitted])
        with_common = rows.withColumn("_common", common)
        require((with_common.agg(F.var_pop("_common")).first()[0] or 0) > 0, "the common score doesn't vary", StateError)
        seen = with_common.agg(*(F.count(col(f"z_{m}")) for m in fitted)).first()
        usable = [m for k, m in enumerate(fitted) if seen[k] >= MIN_ROWS]
        require(set(identity) <= set(usable), "identity markers have too few values", StateError)
        slope, intercept = line(with_common, "_common", [f"z_{m}" for m in usable])
        gap = {m: math.nan for m in fitted}
        c = Correction(**(vars(c) | {"slope": gap | {k[2:]: v for k, v in slope.items()}, "intercept": gap | {k[2:]: v for k, v in intercept.items()}}))
        center, scale = standard(_residuals(rows, c), [f"r_{m}" for m in fitted])
        return Correction(**(vars(c) | {"center": {m: center[f"r_{m}"] if m in usable else math.nan for m in fitted}, "scale": {m: scale[f"r_{m}"] for m in fitted}}))

    return _sealed(FrozenModel(tuple(markers), tuple(identity), space("common_score_residual", list(identity)), space("pc1_panel_residual", list(markers)), provenance or {}))


def apply_frozen(scores: DataFrame, model: FrozenModel, keys: list[str], check: bool = True) -> DataFrame:
    """keys, id_<marker> of the identity space and gate_<marker> of the panel space; one projection."""
    require(model.schema == FROZEN_SCHEMA, f"only {FROZEN_SCHEMA} models can be applied", IntegrityError)
    require(model.sha256 == sha256(model.payload()), "the model's digest differs", IntegrityError)
    names = [c for c in scores.columns if c not in keys]
    require(names == list(model.markers), "the columns must be the model's markers, in order")
    if check:
        _check_scores(scores, names, list(model.identity))
    out = scores
    for prefix, c in (("id", model.identity_space), ("gate", model.panel_space)):
        z = out.withColumns({f"z_{m}": _z(col(m), c.median[m], c.mad[m]) if not math.isnan(c.median[m]) else F.lit(None).cast("double") for m in c.fitted})
        usable = lambda m, c=c: not math.isnan(c.slope[m]) and not math.isnan(c.center[m])
        r = _residuals(z, c)
        kept = [*out.columns] + [f"{prefix}_{m}" for m in c.fitted]
        out = r.withColumns({f"{prefix}_{m}": (col(f"r_{m}") - F.lit(c.center[m])) / F.lit(c.scale[m]) if usable(m) else F.lit(None).cast("double") for m in c.fitted}).select(*(col(k) for k in kept))
    return out.select(*keys, *(col(f"id_{m}") for m in model.identity), *(col(f"gate_{m}") for m in model.markers))


#: The parameters that an imported bundle has for each space.
BUNDLE = ("median", "mad", "slope", "intercept", "center", "scale")


def import_frozen(bundle: dict[str, Any], content: bytes, content_sha256: str, provenance: dict[str, Any] | None = None) -> FrozenModel:
    """A model from given parameters, never refitted. ``content`` are the bytes of the file that they were read from."""
    require(sha256(content) == content_sha256, "the source file's digest differs", IntegrityError)
    wanted = {"markers", "identity", "rotation", "pc_center", "identity_space", "panel_space"}
    require(set(bundle) == wanted, f"a bundle has exactly {sorted(wanted)}")
    markers, identity = list(bundle["markers"]), list(bundle["identity"])
    require(identity and set(identity) <= set(markers), "identity markers must be among the markers")

    def space(name: str, method: str, fitted: list[str]) -> Correction:
        part = bundle[name]
        require(set(part) == set(BUNDLE) and all(list(part[k]) == fitted for k in BUNDLE), f"{name} must have {BUNDLE} for {fitted}")
        require(all(v > 0 for k in ("mad", "scale") for v in part[k].values()), f"{name}: scales must be positive")
        return Correction(method, tuple(fitted), tuple(fitted), True, tuple(identity), **{k: {m: float(v) for m, v in part[k].items()} for k in BUNDLE}, rotation={m: float(v) for m, v in bundle["rotation"].items()}, pc_center={m: float(v) for m, v in bundle["pc_center"].items()})

    return _sealed(FrozenModel(tuple(markers), tuple(identity), space("identity_space", "common_score_residual", identity), space("panel_space", "pc1_panel_residual", markers), provenance or {}))
