"""Queries over the driver's tables, one or more for each operator, and the same in SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EmptySelection
from .operators import classify as cl
from .operators import correct, embed, fixed, large, review, snapshot, states, structures, views
from .operators import estimators as est
from .operators import thresholds as th
from .operators.prepare import Prepared, cell_table, prepare, support_table
from .plans.config import Config, Flag, Hierarchy, Localization, Marker, MinSupport, Override, Refinement, Rule, signal_policy
from .sources import adapters as ad
from .storage import shared_dir

KEYS = ["image_id", "cell_id"]
CUTS = {"QTY": 2.3, "PRICE": 9.2, "DISC": 0.05, "TAX": 0.04}


def lineitem_config(**changes) -> Config:
    """Two continuous markers, two with few values, manual cuts, a flag, three rules and a review rule."""
    manual = lambda m, **k: Marker(m, method="manual", args={"value": CUTS[m]}, **k)
    rules = (
        Rule(rule_id="R1", label="Both", all_of=("QTY", "PRICE")),
        Rule(rule_id="R2", label="Quantity", all_of=("QTY",), none_of=("DISC",), review=True, pending_label="Pending", decisions={"Tumor": "QTumor", "Benign": "QBenign", "Unresolved": "QOpen"}),
        Rule(rule_id="R3", label="Discounted", any_of=("DISC", "TAX")),
    )
    base = {
        "policy": signal_policy(["QTY", "PRICE", "DISC", "TAX", "SPREAD"][:4]),
        "panel": (manual("QTY", transform="asinh", cofactor=5.0), manual("PRICE", transform="asinh", cofactor=5.0), manual("DISC"), manual("TAX")),
        "parent_sets": {},
        "hierarchy": Hierarchy(rules, {"both": Flag(all_of=("DISC", "TAX"))}, {"both": "unresolved"}),
    }
    return Config(**(base | changes))


def state_config() -> Config:
    """TAX becomes a state marker with a localization rule and two parents."""
    base = lineitem_config()
    hierarchy = Hierarchy((Rule(rule_id="R1", label="Both", all_of=("QTY", "PRICE")), Rule(rule_id="R2", label="Quantity", all_of=("QTY",), review=True, pending_label="Pending", decisions={"Tumor": "QTumor", "Benign": "QBenign", "Unresolved": "QOpen"}), Rule(rule_id="R3", label="Discounted", any_of=("DISC",))))
    tax = Marker("TAX", role="state", method="manual", args={"value": 0.04}, parents=("big", "small"), localization=Localization("nucleus", "cytoplasm", 1.0))
    return replace(base, panel=(*base.panel[:3], tax), parent_sets={"big": ("Both",), "small": ("Discounted", "Pending")}, hierarchy=hierarchy, refinements=(Refinement("F1", "TAX", "big", "Both", "Both taxed"),))


def one_marker(name: str, **k) -> Config:
    return Config(signal_policy([name]), (Marker(name, **k),), {}, Hierarchy((Rule(rule_id="R", label="Positive", all_of=(name,)),)))


def lines(spark: SparkSession, d: str, config: Config | None = None, images: list[str] | None = None) -> Prepared:
    return prepare(ad.slide_lineitem(spark, d), config or lineitem_config(), images)


def r6(*names: str) -> list:
    return [F.round(F.col(f"`{n}`"), 6).alias(n.lower().replace("`", "")) for n in names]


# --- queries --------------------------------------------------------------------------------------------------------


def signal_select(spark, d):
    config = lineitem_config(policy=signal_policy(["QTY", "PRICE", "DISC", "TAX"], compartment=["cytoplasm", "cell", "cell", "cell"], fallback=["cell", None, None, None]))
    return lines(spark, d, config).df.select(*KEYS, F.col("raw_QTY").alias("raw_qty"), F.col("src_QTY").alias("src_qty"), F.col("raw_DISC").alias("raw_disc"))


def transform_scores(spark, d):
    config = lineitem_config()
    config = replace(config, panel=(*config.panel[:3], replace(config.panel[3], transform="log1p")))
    return lines(spark, d, config).df.select(*KEYS, *r6("score_QTY", "score_PRICE", "score_DISC", "score_TAX"))


def localization_ratio(spark, d):
    return lines(spark, d, state_config()).df.select(*KEYS, F.round("ratio_TAX", 3).alias("ratio"), F.col("located_TAX").alias("located"))


def image_filter(spark, d):
    return lines(spark, d, images=["AF", "RF"]).df.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score_QTY"), 6).alias("mean_qty"))


SUPPORT = ["image_id", "marker", "role", "status", "support", "details", "n_cells", "n_available"]


def _support(table: DataFrame) -> DataFrame:
    return table.select(*SUPPORT, *r6("fraction_unavailable", "sd", "mad", "fraction_mode", "q01", "q50", "q99"))


def callability(spark, d):
    return _support(lines(spark, d).support)


def callability_unavailable(spark, d):
    return _support(prepare(ad.slide_customer(spark, d), one_marker("BAL", support=MinSupport(max_unavailable=0.09))).support)


def callability_underpowered(spark, d):
    few = MinSupport(min_cells=100)
    config = Config(signal_policy(["SIZE", "RETAIL"]), (Marker("SIZE", support=few), Marker("RETAIL", role="context", support=few)), {}, Hierarchy((Rule(rule_id="R", label="L", all_of=("SIZE",)),)))
    return _support(prepare(ad.slide_part(spark, d), config).support)


def _corrected(method: str):
    def run(spark, d):
        out, _ = correct.correct(lines(spark, d), method)
        return out.select(*KEYS, *r6("score_QTY", "score_PRICE", "score_DISC", "score_TAX"))

    return run


FROZEN = {"median": [25.0, 35_000.0, 0.05], "mad": [12.0, 20_000.0, 0.03], "slope": [0.8123, 0.7071, 0.1234], "intercept": [0.0137, -0.0219, 0.0341], "center": [0.0, 0.1131, -0.1077], "scale": [0.5173, 0.2519, 2.0331]}
NAMES = ["QTY", "PRICE", "DISC"]


def frozen_model() -> correct.FrozenModel:
    part = lambda names: {k: dict(zip(names, v, strict=False)) for k, v in FROZEN.items()}
    bundle = {"markers": NAMES, "identity": NAMES[:2], "rotation": {"QTY": 0.6, "PRICE": 0.8}, "pc_center": {"QTY": 0.1, "PRICE": -0.1}, "identity_space": part(NAMES[:2]), "panel_space": part(NAMES)}
    return correct.import_frozen(bundle, b"x", correct.sha256(b"x"))


def _raw(spark, d) -> DataFrame:
    return lines(spark, d).df.select(*KEYS, *(F.col(f"raw_{m}").alias(m) for m in NAMES))


def frozen_apply(spark, d):
    out = correct.apply_frozen(_raw(spark, d), frozen_model(), KEYS)
    return out.select(*KEYS, *r6("id_QTY", "id_PRICE", "gate_QTY", "gate_PRICE", "gate_DISC"))


def frozen_fit_params(spark, d):
    model = correct.fit_frozen(_raw(spark, d), NAMES, NAMES[:2])
    rows = [(space, k, m, float(v)) for space in ("identity_space", "panel_space") for k in ("median", "mad", "slope", "intercept", "center", "scale") for m, v in getattr(getattr(model, space), k).items()]
    # adding zero makes -0.0 and 0.0 one
    return spark.createDataFrame([(*r[:3], round(r[3], 6) + 0.0) for r in rows], "space string, parameter string, marker string, value double")


def correction_params(spark, d):
    """Medians and scaled MADs of the robust z, all parameters of the first-component residual."""
    c = correct.fit(lines(spark, d), "pc1_panel_residual")
    return spark.createDataFrame([(m, *(round(x[m], 6) + 0.0 for x in (c.median, c.mad, c.rotation, c.slope))) for m in c.fitted], "marker string, median double, mad double, rotation double, slope double")


def _events(spark, d) -> DataFrame:
    return ad.table(spark, d, "events")


def auc_rank(spark, d):
    df = _events(spark, d).select(F.col("event_type").alias("image_id"), F.lit("VALUE").alias("marker"), F.col("value").alias("v"), (F.col("user_id") % 2 == 0).alias("inside"))
    areas = spark.createDataFrame([(image, round(a, 6)) for (image, _), a in large.rank_areas(df).items()], "image_id string, auc double")
    counts = df.groupBy("image_id").agg(F.count_if("inside").alias("n_positive"), F.count_if(~F.col("inside")).alias("n_negative"))
    return counts.join(areas, "image_id").select(F.col("image_id").alias("event_type"), "auc", "n_positive", "n_negative")


def density_grid(spark, d):
    return th.density_table(_events(spark, d), "event_type", "value", 64).select("event_type", "k", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


def density_modes(spark, d):
    return th.mode_table(th.density_table(_events(spark, d), "event_type", "value", 64), "event_type").select("event_type", "k", F.round("density", 8).alias("density"), "rank")


def crossing(spark, d):
    df = _events(spark, d).select("event_type", "value", (F.col("user_id") % 3 == 0).alias("third"))
    return th.crossing_table(df, "event_type", "value", "third", 64).select("event_type", F.round("crossing", 6).alias("crossing"))


def mixture_em_step(spark, d):
    return th.mixture_step_table(_events(spark, d), "event_type", "value").select("event_type", *(F.round(c, 6).alias(c) for c in ("w1", "w2", "m1", "m2", "s1", "s2")))


def threshold_manual(spark, d):
    return th.thresholds(lines(spark, d)).frame(spark).select("image_id", "marker", "role", "method", "status", "estimate", "rule", "args_json", "n_positive_pool")


def _method(method: str, **args):
    def run(spark, d):
        p = prepare(ad.slide_events(spark, d), one_marker("VALUE", method=method, args=args, transform="log1p"))
        return th.thresholds(p).frame(spark).select("image_id", "marker", "method", "status", F.round("estimate", 6).alias("estimate"), F.round("auc", 6).alias("auc"), "n_positive_pool", "n_negative_pool", "rule", "details")

    return run


def _pooled(spark, d) -> DataFrame:
    """Events in two pools: a third of the users measure 300 more, and have S higher by 40."""
    e = _events(spark, d)
    high = F.col("user_id") % 3 == 0
    k = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    return e.select(F.col("event_type").alias("image_id"), F.col("event_id").alias("cell_id"), F.col("user_id").cast("double").alias("x"), k.alias("y"), high.alias("high"), (F.col("value") + F.when(high, 300.0).otherwise(0.0)).alias("cell:VALUE:mean"), (k + F.when(high, 40.0).otherwise(0.0)).alias("cell:S:mean"))


def _pool_method(method: str, **args):
    def run(spark, d):
        p = prepare(cell_table(_pooled(spark, d)), one_marker("VALUE", method=method, args=args))
        return th.thresholds(p).frame(spark).select("image_id", "status", F.round("estimate", 6).alias("estimate"), F.round("negative_q99", 6).alias("negative_q99"), F.round("auc", 6).alias("auc"), "n_positive_pool", "n_negative_pool")

    return run


def threshold_population_pools(spark, d):
    """Both pools are populations, taken whole."""
    p = prepare(cell_table(_pooled(spark, d)), one_marker("VALUE", method="population_crossing", args={"max_per_population": 100_000_000}))
    pops = p.df.select(*KEYS, F.when(F.col("high"), 2).otherwise(1).alias("population"))
    cuts = th.thresholds(p, population=pops).frame(spark)
    return cuts.select("image_id", "status", F.round("estimate", 6).alias("estimate"), F.round("crossing", 6).alias("crossing"), F.round("negative_q99", 6).alias("negative_q99"), F.round("auc", 6).alias("auc"), "n_positive_pool", "n_negative_pool", "positive_populations", "negative_populations")


def state_parent_pools(spark, d):
    """S within the cells whose VALUE is over 300, against the rest."""
    markers = (Marker("VALUE", method="manual", args={"value": 300.0}), Marker("S", role="state", method="parent_crossing", parents=("up",)))
    config = Config(signal_policy(["VALUE", "S"]), markers, {"up": ("Positive",)}, Hierarchy((Rule(rule_id="R", label="Positive", all_of=("VALUE",)),)))
    p = prepare(cell_table(_pooled(spark, d)), config)
    k = cl.classify(p, th.thresholds(p), quiet=True)
    return states.state_calls(p, k).thresholds().select("image_id", "marker", "parent", "status", F.round("estimate", 6).alias("estimate"), F.round("crossing", 6).alias("crossing"), F.round("auc", 6).alias("auc"), "n_positive_pool", "n_negative_pool")


def population_crossing(spark, d):
    names = [f"E{k}" for k in range(8)]
    config = Config(signal_policy(names), tuple(Marker(m, method="population_crossing") for m in names), {}, Hierarchy((Rule(rule_id="R", label="L", all_of=("E0",)),)))
    cells = ad.slide_embeddings(spark, d)
    p = prepare(cells, config)
    pops = p.df.select(*KEYS, F.col("label").alias("population"))
    return th.thresholds(p, population=pops).frame(spark).select("image_id", "marker", "status", F.round("estimate", 6).alias("estimate"), F.round("auc", 6).alias("auc"), "n_positive_pool", "n_negative_pool", "positive_populations", "negative_populations")


def population_pools(spark, d):
    """Which populations lie above and below the mean of a dimension."""
    df = ad.slide_embeddings(spark, d).df.select("image_id", F.lit("E0").alias("marker"), F.col("label").alias("population"), F.col("`cell:E0:mean`").alias("v"))
    rows = th.population_moments(df).collect()
    chosen = est.chosen_populations({r.population: est.Moments(r.n, r.mean, r.n * r.variance) for r in rows}, {"positive_z": 0.5, "negative_z": 0})
    return spark.createDataFrame([(r.population, round(r.mean, 6), r.n, r.population in chosen[True], r.population in chosen[False]) for r in rows], "label int, mean double, n long, positive boolean, negative boolean")


def threshold_coverage(spark, d):
    """Images and markers without exactly one threshold."""
    p = lines(spark, d)
    frame = th.thresholds(p).frame(spark).where("not (image_id = 'NO' and marker = 'TAX')")
    return th.coverage(p, frame)


def effective_overrides(spark, d):
    o = (Override("AF", "QTY", "because", args={"value": 2.9}), Override("AF", "QTY", "second is not used", args={"value": 1.0}))
    return th.thresholds(lines(spark, d, lineitem_config(overrides=o))).frame(spark).select("image_id", "marker", "estimate")


def _classified(spark, d, config: Config | None = None):
    p = lines(spark, d, config)
    cuts = th.thresholds(p)
    return p, cuts, cl.classify(p, cuts, quiet=True)


def marker_calls(spark, d):
    c = _classified(spark, d)[2]
    return c.calls.select(*KEYS, *(F.col(f"call_{m}").alias(f"call_{m.lower()}") for m in CUTS))


def classify_cells(spark, d):
    return _classified(spark, d)[2].df.select(*KEYS, "cell_type", "rule_id", "pending_review", "both", "excluded")


def cell_flags(spark, d):
    h = lineitem_config().hierarchy
    h = replace(h, flags={"both": Flag(all_of=("DISC", "TAX")), "any": Flag(any_of=("PRICE",), none_of=("TAX",)), "q": Flag(all_of=("QTY",))}, flag_policy={"both": "exclude", "any": "flag_only", "q": "unresolved"})
    return _classified(spark, d, lineitem_config(hierarchy=h))[2].df.select(*KEYS, "both", "any", "q", "cell_type", "excluded")


def _uncallable() -> Config:
    """TAX needs more cells than two images have."""
    c = lineitem_config()
    return replace(c, panel=(*c.panel[:3], replace(c.panel[3], support=MinSupport(min_cells=10_000_000))))


def disabled_rules(spark, d):
    off = _classified(spark, d, _uncallable())[2].disabled
    return spark.createDataFrame([tuple(r[c] for c in ("image_id", "rule_id", "label", "reason", "markers")) for r in off], "image_id string, rule_id string, label string, reason string, markers string")


def classify_uncallable(spark, d):
    return cl.summary(_classified(spark, d, _uncallable())[2].df).select("image_id", "cell_type", "n", F.round("proportion", 6).alias("proportion"))


def classification_summary(spark, d):
    return _classified(spark, d)[2].summary().select("image_id", "cell_type", "n", F.round("proportion", 6).alias("proportion"))


def fixed_threshold_calls(spark, d):
    return fixed.threshold_calls(_raw(spark, d), KEYS, {"QTY": 25.0, "PRICE": None, "DISC": 0.05}, {"QTY": True, "PRICE": True, "DISC": True}).withColumnsRenamed({m: m.lower() for m in NAMES})


def fixed_signal_calls(spark, d):
    df = ad.slide_lineitem(spark, d).df.select(*KEYS, F.col("`cell:QTY:mean`").alias("f_a"), F.col("`cytoplasm:QTY:mean`").alias("f_b"), F.lit(1.0).alias("f_c"))
    df = df.withColumn("src", F.when(F.col("f_b") >= 0, "f_b").when(F.col("f_a") < 5, "f_c").otherwise("f_a")).withColumn("sel", F.when(F.col("f_b") >= 0, F.col("f_b")).otherwise(F.col("f_a"))).withColumn("QTY", F.col("sel") / 5)
    return fixed.signal_calls(df, KEYS, ["QTY"], {"QTY": "sel"}, {"QTY": "src"}, ["f_a", "f_b", "f_c"], {"QTY": 3.0}, {"QTY": True})[0].withColumnRenamed("call_QTY", "call_qty")


def candidate_rules(spark, d):
    calls = fixed.threshold_calls(_raw(spark, d), KEYS, {"QTY": 25.0, "PRICE": 40_000.0, "DISC": None}, {"QTY": True, "PRICE": True, "DISC": True})
    rules = [fixed.Candidate("a", "High", {"QTY": ("HIGH",)}), fixed.Candidate("b", "Either", {}, {"PRICE": ("HIGH",), "QTY": ("LOW",)}), fixed.Candidate("c", "Odd", {"QTY": ("HIGH",), "PRICE": ("LOW",)}, {"DISC": ("UNAVAILABLE",)})]
    return fixed.candidate_rules(calls, KEYS, rules, "None")


def state_diagnostics(spark, d):
    df = ad.slide_lineitem(spark, d).df.select(*KEYS, F.col("`cell:QTY:mean`").alias("q"), F.when(F.col("`cell:DISC:mean`") > 0.02, F.col("`cell:DISC:mean`")).alias("disc"), F.col("`cell:TAX:mean`").alias("tax"), F.when(F.col("`cell:TAX:mean`") > 0, F.col("`cell:TAX:mean`") > 0.02).alias("parent"))
    s = fixed.DiagnosticState
    return fixed.state_diagnostics(df, KEYS, {"Q": s("q", 25.0, "parent"), "D": s("disc", 0.05, "parent", audit_missing="propagate"), "N": s("q", None, "parent"), "L": s("q", 10.0, "parent", "disc", "tax", 1.5)})


def _states(spark, d):
    p, cuts, c = _classified(spark, d, state_config())
    return p, cuts, c, states.state_calls(p, c)


def state_calls_manual(spark, d):
    s = _states(spark, d)[3].df
    return s.select(*KEYS, "marker", "parent", "in_parent", "evaluable", "score", "estimate", F.round("localization_ratio", 3).alias("localization_ratio"), "positive", "enabled")


def state_parent_crossing(spark, d):
    base = state_config()
    price = Marker("PRICE", role="state", transform="asinh", cofactor=5.0, method="parent_crossing", parents=("big",))
    h = Hierarchy((Rule(rule_id="R1", label="Both", all_of=("QTY",)),))
    config = replace(base, panel=(base.panel[0], price), parent_sets={"big": ("Both",)}, hierarchy=h, refinements=())
    p, _, c = _classified(spark, d, config)
    return states.state_calls(p, c).thresholds().select("image_id", "marker", "parent", "status", F.round("estimate", 6).alias("estimate"), F.round("auc", 6).alias("auc"), "n_positive_pool", "n_negative_pool")


def state_calls_completeness(spark, d):
    p, _, _, s = _states(spark, d)
    return states.completeness(s.df.where("score <> 0.07"), p.df, p.config).groupBy("image_id", "marker", "parent").agg(F.count(F.lit(1)).alias("missing"))


def _points(spark, d, eps: float = 20.0) -> DataFrame:
    return ad.slide_part(spark, d).df.select("image_id", F.col("cell_id").alias("id"), "x", (F.col("y") / 10).alias("y"), F.lit(eps).alias("eps"), F.col("cell_id").cast("long").alias("ord"))


def neighbour_counts(spark, d):
    return structures.neighbour_counts(_points(spark, d))


def structure_eps(spark, d):
    eps = structures.eps_by_image(_points(spark, d), 1.0, 30.0, 4)
    return spark.createDataFrame([(k, round(v, 6)) for k, v in sorted(eps.items())], "image_id string, eps double")


def structure_stats(spark, d):
    labelled = _points(spark, d).withColumn("cluster", F.floor("x") % 3)
    return structures.structure_stats(labelled).select("image_id", "cluster", "structure_id", "n_cells", F.round("centroid_x", 6).alias("centroid_x"), F.round("centroid_y", 6).alias("centroid_y"), "xmin", "xmax", "ymin", "ymax")


def spatial_structures(spark, d):
    cells = _points(spark, d).select("image_id", F.col("id").alias("cell_id"), "x", "y", F.lit(True).alias("pending_review"))
    s = structures.structures(cells, 4.0, 8.0, 4, 4)
    return s.table.select("image_id", "structure_id", "n_cells", F.round("centroid_x", 6).alias("centroid_x"), F.round("centroid_y", 6).alias("centroid_y"))


def _embedded(spark, d):
    names = [f"E{k}" for k in range(8)]
    config = Config(signal_policy(names, min_value=-1000.0), tuple(Marker(m, method="population_crossing") for m in names), {}, Hierarchy((Rule(rule_id="R", label="L", all_of=("E0",)),)))
    return prepare(ad.slide_embeddings(spark, d), config)


def pca_scores(spark, d):
    x, names = embed.embedding_input(_embedded(spark, d))
    return embed.pca_scores(x, [f"x_{m}" for m in names], 3, KEYS)[0].select(*KEYS, *r6("pc1", "pc2", "pc3"))


def embedding_populations(spark, d):
    e = embed.embed(_embedded(spark, d), grid=60, min_abs=10)
    return e.df.groupBy("population").agg(F.count(F.lit(1)).alias("n"))


GRID, BASINS = [0.0, 500.0, 1000.0, 1500.0, 2000.0], [[1, 1, 2, 2, 0], [1, 1, 2, 2, 3], [1, 4, 4, 2, 3], [4, 4, 4, 3, 3], [0, 4, 4, 3, 3]]


def basin_assign(spark, d):
    import numpy as np

    layout = ad.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 2100).cast("double").alias("u1"), (F.col("p_size") * 40).cast("double").alias("u2"))
    return embed.assign_basins(layout, np.array(GRID), np.array(GRID), np.array(BASINS), "uncertain", 300, 0.0)[0].select("id", "raw_population", "population")


def ledger_entries(spark, d) -> DataFrame:
    """A ledger made of events: every fifth undoes the entry before it, every 25th the undo before."""
    e = _events(spark, d).select(F.col("event_id").alias("order"), F.concat(F.lit("X"), F.col("event_id")).alias("entry_id"), F.col("event_type").alias("image_id"), (F.col("user_id") % 20).cast("string").alias("marker"), F.col("value").alias("new_estimate"))
    target = F.when(F.col("order") % 25 == 0, F.concat(F.lit("X"), F.col("order") - 5)).when(F.col("order") % 5 == 0, F.concat(F.lit("X"), F.col("order") - 1))
    return e.withColumn("reverts", F.when(F.col("order") > 5, target))


def active_ledger(spark, d):
    return review.active_frame(ledger_entries(spark, d)).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum("order").alias("orders"))


def effective_cuts(spark, d):
    """The last active cut of each image and marker."""
    return review.active_frame(ledger_entries(spark, d)).groupBy("image_id", "marker").agg(F.max_by("entry_id", "order").alias("entry_id"), F.max_by("new_estimate", "order").alias("estimate"))


def _boxes(n: int) -> list[dict]:
    kinds = ["EXCLUDE", "DELETE", "RESTORE"]
    return [{"image_id": ["AF", "NO", "RF"][k % 3], "order": k + 1, "cell_id": None, "structure_id": None, "xmin": 10.0 * (k % 50), "xmax": 10.0 * (k % 50) + 150, "ymin": float(k % 20), "ymax": float(k % 20) + 40, "disposition": kinds[k % 3], "decision": ["Tumor", "Benign", "Unresolved"][k % 3]} for k in range(n)]


def _cells(spark, d) -> DataFrame:
    return ad.slide_lineitem(spark, d).df.select(*KEYS, "x", "y").withColumn("structure_id", F.lit(None).cast("string"))


def dispositions(spark, d):
    out = review.decided(_cells(spark, d), _boxes(60), "disposition", "cell_id", "")
    return out.groupBy("image_id", F.coalesce("disposition", F.lit("NONE")).alias("disposition")).agg(F.count(F.lit(1)).alias("n"))


def structure_decisions(spark, d):
    out = review.decided(_cells(spark, d), _boxes(300), "decision", "structure_id", "")
    return out.groupBy("image_id", F.coalesce("decision", F.lit("none")).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


def _disposed(r: review.Review, disposition: str, box: tuple[float, ...], *who: str) -> review.Review:
    """A box without cells on these tables leaves no entry: ledgers refuse it, and it would change no cell."""
    try:
        return r.dispose("AF", disposition, *who, box=box)
    except EmptySelection:
        return r


def _review(spark, d):
    p, cuts, c, s = _states(spark, d)
    r = review.review(p, cuts, c, s)
    who = ("reviewer", "reason")
    r = r.set_cut("AF", "QTY", 2.9, *who).set_cut("NO", "PRICE", 10.0, *who).revert_last(*who)
    r = r.decide_structure("RF", "Tumor", *who, box=(0.0, 800.0, 0.0, 60.0)).decide_structure("RF", "Benign", *who, box=(0.0, 300.0, 0.0, 60.0))
    r = _disposed(_disposed(r, "EXCLUDE", (0.0, 200.0, 0.0, 100.0), *who), "RESTORE", (0.0, 100.0, 0.0, 100.0), *who)
    return r.set_state("AF", "TAX", "big", "ENABLE", *who).set_state("NO", "TAX", "big", "ENABLE", *who).set_cut("NO", "TAX", 0.06, *who, parent="big")


def replay_cells(spark, d):
    return review.replay(_review(spark, d)).cells.select(*KEYS, "cell_type", "base_cell_type", "rule_id", "pending_review", "structure_decision", "disposition_effective", "analysed")


def replay_states(spark, d):
    s = review.replay(_review(spark, d)).states
    return s.groupBy("image_id", "marker", "parent", "enabled", "estimate").agg(F.count_if("in_parent").alias("n_in_parent"), F.count_if("positive").alias("n_positive"))


def refinements(spark, d):
    """Cells that a refinement relabelled."""
    return review.replay(_review(spark, d)).cells.where("cell_type = 'Both taxed'").groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


def imported_cuts(spark, d):
    """Cuts in bulk: one ledger row for each, and the labels that follow."""
    p, cuts, c = _classified(spark, d)
    rows = [{"image_id": i, "marker": "QTY", "estimate": e} for i, e in (("AF", 2.9), ("NF", 2.9), ("NO", 1.2))]
    r = review.review(p, cuts, c).import_cuts(rows, "reviewer", "bulk import")
    return cl.summary(review.replay(r).cells).select("image_id", "cell_type", "n")


def dotplot_means(spark, d):
    p, _, c = _classified(spark, d)
    return views.dotplot(p, c).select("image_id", "marker", "cell_type", F.round("mean_score", 6).alias("mean_score"), "n_observed")


def state_histogram(spark, d):
    return views.state_histogram(_states(spark, d)[3].df, 10)


def density_view(spark, d):
    p = prepare(ad.slide_events(spark, d), one_marker("VALUE", method="manual", args={"value": 1.5}, transform="log1p"))
    image = sorted(r.image_id for r in p.support.collect())[0]
    return views.density_view(p, th.thresholds(p), "VALUE", image, 32).select("pool", "k", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"), "cut")


def map_view(spark, d):
    p, _, c = _classified(spark, d)
    return views.map_view(p.df.join(c.df.select(*KEYS, "cell_type"), KEYS), "AF")


def verify_exceptall(spark, d):
    """Rows of a changed copy that differ, both ways."""
    a = _classified(spark, d)[2].df.select(*KEYS, "cell_type")
    b = a.withColumn("cell_type", F.when(F.col("image_id") == "AF", F.lit("Changed")).otherwise(F.col("cell_type")))
    side = F.when(F.col("side") == "left", "lost").otherwise("new")
    return snapshot.differences(a, b).groupBy(side.alias("side"), "cell_type").agg(F.count(F.lit(1)).alias("n"))


def verified_export(spark, d):
    """From the raw table to a package that has verified itself: the checks that a reader makes of it."""
    folder = f"{shared_dir(spark).removeprefix('file:')}/package-{uuid.uuid4().hex}"
    snapshot.export(snapshot.lock(_review(spark, d), "reviewer"), folder)
    rows = [(c["check"], c["ok"], c["details"]) for c in snapshot.verify_export(spark, folder)]
    return spark.createDataFrame(rows, "check string, ok boolean, details string")


def source_digest(spark, d):
    from .functions.canonical import table_digest

    df = ad.slide_part(spark, d).df
    return spark.createDataFrame([(table_digest(df), table_digest(df.repartition(7)))], "digest string, repartitioned string")


def support_of_events(spark, d):
    p = prepare(ad.slide_events(spark, d), one_marker("VALUE"))
    return _support(support_table(p.df, p.config))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        signal_select, transform_scores, localization_ratio, image_filter, callability, callability_unavailable, callability_underpowered, support_of_events, frozen_apply, frozen_fit_params, correction_params, auc_rank,
        density_grid, density_modes, crossing, mixture_em_step, threshold_manual, threshold_population_pools, state_parent_pools, population_crossing, population_pools, threshold_coverage, effective_overrides, marker_calls, classify_cells, cell_flags, disabled_rules, classify_uncallable,
        classification_summary, fixed_threshold_calls, fixed_signal_calls, candidate_rules, state_diagnostics, state_calls_manual, state_parent_crossing, state_calls_completeness, neighbour_counts, structure_eps,
        structure_stats, spatial_structures, pca_scores, embedding_populations, basin_assign, active_ledger, effective_cuts, dispositions, structure_decisions, replay_cells, replay_states, refinements, imported_cuts, dotplot_means, state_histogram,
        density_view, map_view, verify_exceptall, verified_export, source_digest,
    ]
    out = {f.__name__: f for f in found}
    out |= {"correct_none": _corrected("none"), "correct_robust_z": _corrected("robust_z"), "correct_common_score": _corrected("common_score_residual"), "correct_pc1": _corrected("pc1_panel_residual")}
    out |= {"threshold_valley_pools": _pool_method("valley"), "threshold_tail_pools": _pool_method("tail", peak_fraction=0.5, min_tail_excess=1.1), "threshold_mixture_pools": _pool_method("mixture", max_iter=20, tol=0.0, max_overlap=0.9)}
    return out | {"threshold_valley": _method("valley", min_n=50), "threshold_tail": _method("tail"), "threshold_mixture": _method("mixture", max_overlap=0.5)}
