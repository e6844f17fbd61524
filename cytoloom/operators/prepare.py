"""Cell tables and their preparation: signal selection, transform, localization, raw support.

A cell table is one wide DataFrame: image_id, cell_id, sample_id, x, y, extras, and a double column for each feature
``<compartment>:<marker>:<statistic>``. Preparation is a single projection, stored once, as all later steps read it;
support is aggregated by image, with quantiles that no task gathers whole (``order``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InputError, StateError, StructureError, require
from ..functions.canonical import fingerprint, sha256
from ..functions.columns import LOCALIZATION_OFFSET, col, finite, finite_or_null, transformed
from ..plans.config import Config
from ..storage import small, stored
from .order import quantiles

KEYS = ["image_id", "cell_id"]


def parse_feature(name: str) -> tuple[str, str, str]:
    parts = name.split(":")
    require(len(parts) == 3 and all(parts), f"feature {name!r} isn't <compartment>:<marker>:<statistic>", StructureError)
    return parts[0], parts[1], parts[2]


def dictionary(features: list[str]) -> dict[tuple[str, str, str], str]:
    """(compartment, marker, statistic) -> column. Lookups go through this, never through pasted names."""
    out = {parse_feature(f): f for f in features}
    require(len(out) == len(features), "features repeat", StructureError)
    return out


@dataclass(frozen=True)
class CellTable:
    df: DataFrame
    features: dict[tuple[str, str, str], str]
    images: DataFrame | None = None
    provenance: dict[str, str] = field(default_factory=dict)

    def feature(self, marker: str, compartment: str, statistic: str) -> str:
        name = self.features.get((compartment, marker, statistic))
        require(name is not None, f"no feature {compartment}:{marker}:{statistic}", StructureError)
        return name


def cell_table(df: DataFrame, images: DataFrame | None = None, features: list[str] | None = None) -> CellTable:
    """A cell table of ``df``: ids as text, sample_id from image_id where absent, measurements as finite doubles or NULL."""
    missing = {"image_id", "cell_id", "x", "y"} - set(df.columns)
    require(not missing, f"columns are missing: {sorted(missing)}", StructureError)
    found = dictionary(features if features is not None else [c for c in df.columns if c.count(":") == 2])
    names = set(found.values())
    columns = [F.col("image_id").cast("string"), F.col("cell_id").cast("string"), (F.col("sample_id") if "sample_id" in df.columns else F.col("image_id")).cast("string").alias("sample_id"), F.col("x").cast("double"), F.col("y").cast("double")]
    columns += [col(c) for c in df.columns if c not in names and c not in ("image_id", "cell_id", "sample_id", "x", "y")]
    columns += [finite_or_null(col(c).cast("double")).alias(c) for c in df.columns if c in names]
    return CellTable(df.select(*columns), found, images)


def validate_cells(cells: CellTable) -> list[dict[str, object]]:
    """Check rows (check, ok, details): ids, coordinates, uniqueness of the key pair, known images; two aggregations."""
    df = cells.df
    bad = df.agg(F.count_if(F.col("image_id").isNull() | F.col("cell_id").isNull() | (F.col("image_id") == "") | (F.col("cell_id") == "")).alias("ids"), F.count_if(~finite(F.col("x")) | ~finite(F.col("y"))).alias("xy"), F.count(F.lit(1)).alias("n")).first()
    repeated = df.groupBy(*KEYS).count().where("count > 1").limit(5).collect()
    out = [
        {"check": "not_empty", "ok": bad.n > 0, "details": f"{bad.n} cells"},
        {"check": "ids", "ok": bad.ids == 0, "details": f"{bad.ids} missing"},
        {"check": "coordinates", "ok": bad.xy == 0, "details": f"{bad.xy} not finite"},
        {"check": "unique_keys", "ok": not repeated, "details": ", ".join(f"{r.image_id}/{r.cell_id}" for r in repeated)},
    ]
    if cells.images is not None:
        unknown = df.select("image_id").distinct().join(cells.images.select("image_id"), "image_id", "left_anti").limit(5).collect()
        out.append({"check": "images", "ok": not unknown, "details": ", ".join(r.image_id for r in unknown)})
    return out


@dataclass(frozen=True)
class Prepared:
    """df: keys, sample_id, x, y, extras, and for each marker raw_, src_ (0 none, 1 preferred, 2 fallback), score_, and
    with localization num_, den_, ratio_, located_. support: the callability table."""

    df: DataFrame
    config: Config
    support: DataFrame
    source: str = ""  # fingerprint of df, that results are bound to

    def callability(self) -> DataFrame:
        return self.support

    @property
    def markers(self) -> list[str]:
        return self.config.markers()

    def __repr__(self) -> str:
        return f"<Prepared {len(self.markers)} markers, config {self.config.digest()[:12]}>"


def signal_columns(cells: CellTable, config: Config) -> list[Column]:
    """raw_<marker> and src_<marker>: the preferred measurement if valid, else the fallback, else none."""
    out = []
    for name in config.markers():
        s = config.signal(name)
        a = col(cells.feature(name, s.compartment, s.statistic))
        ok_a = finite(a) & (a >= F.lit(float(s.min_value)))
        raw, source = F.when(ok_a, a), F.when(ok_a, F.lit(1))
        if s.fallback:
            b = col(cells.feature(name, s.fallback, s.statistic))
            ok_b = finite(b) & (b >= F.lit(float(s.min_value)))
            raw, source = raw.when(ok_b, b), source.when(ok_b, F.lit(2))
        out += [raw.alias(f"raw_{name}"), source.otherwise(F.lit(0)).alias(f"src_{name}")]
    return out


def score_columns(config: Config) -> list[Column]:
    return [transformed(col(f"raw_{m.marker}"), m.transform, m.cofactor).alias(f"score_{m.marker}") for m in config.panel]


def localization_columns(cells: CellTable, config: Config) -> list[Column]:
    out = []
    for m in config.panel:
        if not (rule := m.localization):
            continue
        num, den = col(cells.feature(m.marker, rule.numerator, rule.statistic)), col(cells.feature(m.marker, rule.denominator, rule.statistic))
        both = finite(num) & finite(den) & (den + LOCALIZATION_OFFSET != 0)
        ratio = F.when(both, finite_or_null(F.try_divide(num + LOCALIZATION_OFFSET, den + LOCALIZATION_OFFSET)))
        out += [num.alias(f"num_{m.marker}"), den.alias(f"den_{m.marker}"), ratio.alias(f"ratio_{m.marker}"), ratio.isNotNull().alias(f"located_{m.marker}")]
    return out


def prepare(cells: CellTable, config: Config, images: list[str] | None = None) -> Prepared:
    """Filters images, selects and transforms signals, and computes raw support."""
    config.checked()
    df = cells.df
    if images is not None:
        known = {r.image_id for r in df.select("image_id").where(F.col("image_id").isin(images)).distinct().collect()}
        require(set(images) <= known, f"unknown images: {sorted(set(images) - known)}", InputError)
        df = df.where(F.col("image_id").isin(images))
    features = set(cells.features.values())
    kept = [col(c) for c in df.columns if c not in features]
    selected = df.select(*kept, *signal_columns(cells, config), *localization_columns(cells, config))
    out = stored(selected.select("*", *score_columns(config)), "prepared")
    # images x markers rows: computed once and kept, as every later step asks for them
    return Prepared(out, config, stored(support_table(out, config), "support"), fingerprint(out))


def score_digest(prepared: Prepared, scores: DataFrame | None = None) -> str:
    """What cuts, labels and embeddings are bound to: the prepared table, and the corrected scores in its place."""
    if scores is None:
        return prepared.source
    if not hasattr(scores, "_cytoloom_digest"):
        scores._cytoloom_digest = fingerprint(scores.select(*KEYS, *(col(f"score_{m}") for m in prepared.markers)))
    return sha256({"source": prepared.source, "scores": scores._cytoloom_digest})


def same_scores(digest: str, prepared: Prepared, scores: DataFrame | None, what: str) -> None:
    """Refuses results of another table or score space. Results without digest (made by hand) are taken."""
    require(not digest or not prepared.source or digest == score_digest(prepared, scores), f"{what} belong to other scores", StateError)


#: The sentences of the support table that results are compared by.
SUPPORTED = "Signal supports threshold estimation."
NEAR_CONSTANT = "%.1f%% of cells share one value."
UNAVAILABLE = "%.1f%% of cells have no usable signal (limit %.1f%%)."
FEW_CELLS = "Only %d cells with signal (minimum %d)."
SUPPORT_COLUMNS = ["image_id", "marker", "role", "status", "support", "details", "n_cells", "n_available", "fraction_unavailable", "sd", "mad", "fraction_mode", "q01", "q50", "q99"]


def support_table(df: DataFrame, config: Config) -> DataFrame:
    """One row for each image and marker: availability, spread and quantiles of the raw signal, and a status.

    All markers are aggregated side by side, so the cells are not multiplied. ``df`` is read several times and should be
    stored. Only signals whose MAD is zero are counted value by value.
    """
    names = config.markers()
    raw = [f"raw_{m}" for m in names]
    sizes = df.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_cells"), *(F.stddev_samp(col(f"raw_{m}")).alias(f"sd_{m}") for m in names))
    spots = quantiles(df, ["image_id"], raw, [0.01, 0.5, 0.99])
    medians = spots.groupBy("image_id").agg(*(F.max(F.when(F.col("name") == r, F.col("q")[1])).alias(f"med_{m}") for r, m in zip(raw, names, strict=True)))
    away = df.join(small(medians, spots.count()), "image_id").select("image_id", *(F.abs(col(r) - col(f"med_{m}")).alias(r) for r, m in zip(raw, names, strict=True)))
    spread = quantiles(stored(away, "deviations"), ["image_id"], raw, [0.5]).select("image_id", "name", F.col("q")[0].alias("mad"))
    rules = {m: (config.marker(m).role, config.marker(m).support) for m in names}
    by_marker = df.sparkSession.createDataFrame([(f"raw_{m}", m, role, float(r.max_unavailable), float(r.near_constant_mode_fraction), r.min_cells) for m, (role, r) in rules.items()], "name string, marker string, role string, max_unavailable double, near double, min_cells long")
    deviations = sizes.select("image_id", "n_cells", F.inline(F.array(*(F.struct(F.lit(f"raw_{m}").alias("name"), col(f"sd_{m}").alias("sd")) for m in names))))
    long = deviations.join(spots.withColumnRenamed("n", "n_available"), ["image_id", "name"]).join(spread, ["image_id", "name"]).join(F.broadcast(by_marker), "name")
    flat = long.where("mad = 0").select("image_id", "marker")
    values = df.select("image_id", F.inline(F.array(*(F.struct(F.lit(m).alias("marker"), col(f"raw_{m}").alias("v")) for m in names)))).where("v is not null")
    modes = values.join(flat, ["image_id", "marker"], "left_semi").groupBy("image_id", "marker", "v").count().groupBy("image_id", "marker").agg(F.max("count").alias("mode_n"))
    full = long.join(modes, ["image_id", "marker"], "left")
    unavailable = F.lit(1.0) - F.col("n_available") / F.col("n_cells")
    mode = F.col("mode_n") / F.col("n_available")
    cases = [
        (F.col("fraction_unavailable") > F.col("max_unavailable"), "NOT_CALLABLE_UNAVAILABLE", "mostly_unavailable", F.format_string(UNAVAILABLE, F.col("fraction_unavailable") * 100, F.col("max_unavailable") * 100)),
        ((F.col("n_available") < 2) | F.col("sd").isNull() | (F.col("sd") == 0), "NOT_CALLABLE_ABSENT", "constant", F.lit("All cells with signal have the same value.")),
        ((F.col("mad") == 0) & (F.col("fraction_mode") >= F.col("near")), "NOT_CALLABLE_ABSENT", "near_constant", F.format_string(NEAR_CONSTANT, F.col("fraction_mode") * 100)),
        (F.col("n_available") < F.col("min_cells"), "NOT_CALLABLE_UNDERPOWERED", "few_cells", F.format_string(FEW_CELLS, F.col("n_available"), F.col("min_cells"))),
        (F.col("role") == "context", "NOT_GATED", "ok", F.lit("For context: shown, but no rule may use it.")),
    ]

    def chain(k: int, last: str) -> Column:
        out = F.when(cases[0][0], F.lit(cases[0][k]) if k < 3 else cases[0][k])
        for c in cases[1:]:
            out = out.when(c[0], F.lit(c[k]) if k < 3 else c[k])
        return out.otherwise(F.lit(last))

    return (
        full.withColumn("fraction_unavailable", unavailable).withColumn("fraction_mode", F.when(F.col("mad") == 0, mode))
        .withColumn("q01", F.col("q")[0]).withColumn("q50", F.col("q")[1]).withColumn("q99", F.col("q")[2])
        .withColumn("status", chain(1, "PENDING_THRESHOLD")).withColumn("support", chain(2, "ok")).withColumn("details", chain(3, SUPPORTED))
        .select(*SUPPORT_COLUMNS)
    )


def callable_status(status: Column) -> Column:
    return status.isin("CALLABLE", "MANUAL")


def supported(status: Column) -> Column:
    return ~status.startswith("NOT_CALLABLE")


def support_map(prepared: Prepared) -> dict[tuple[str, str], tuple[str, str]]:
    """(image, marker) -> (status, details); images x markers rows come to the driver."""
    return {(r.image_id, r.marker): (r.status, r.details) for r in prepared.support.select("image_id", "marker", "status", "details").collect()}


def with_support(prepared: Prepared) -> DataFrame:
    """The prepared cells with ok_<marker>: whether the marker is supported on the cell's image (one row for each image
    is broadcast)."""
    wide = prepared.support.groupBy("image_id").agg(*(F.bool_or(F.when(F.col("marker") == m, supported(F.col("status")))).alias(f"ok_{m}") for m in prepared.markers))
    return prepared.df.join(small(wide, prepared.support.count()), "image_id")


def available(marker: str) -> Column:
    """Finite score, some source, and support on the image; over ``with_support``."""
    return F.coalesce(col(f"ok_{marker}"), F.lit(False)) & (col(f"src_{marker}") > 0) & finite(col(f"score_{marker}"))
