"""Operators against literal fixtures and independent computations."""

import math
import random
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytoloom import catalog, catalog_sql, errors
from cytoloom.functions.canonical import canonical, parse_double, parse_integer, sha256, table_digest, typed_rows
from cytoloom.operators import classify as cl
from cytoloom.operators import correct, embed, estimators as est, fixed, large, layout, order, review, snapshot, states, structures, views
from cytoloom.operators import thresholds as th
from cytoloom.operators.prepare import cell_table, prepare, validate_cells
from cytoloom.plans.config import Config, Flag, Hierarchy, Localization, Marker, MinSupport, Override, Refinement, Rule, json_schema, read_config, signal_policy, validate, write_config
from cytoloom.plans.methods import METHODS, catalogue
from cytoloom.sources.cellstore import read_cells, write_cells
from cytoloom.sources import folders
from cytoloom.sources.example import example_config, example_path
from cytoloom.sources.manifest import check_manifest
from cytoloom.sources.simulate import simulate
from cytoloom.sources.tsv import read_tsv, write_tsv
from cytoloom.streaming import ledger

WHO = ("reviewer", "reason")


def cells(spark, values, image=None, x=None, y=None):
    n = len(next(iter(values.values())))
    names = [k if k.count(":") == 2 else f"{k}:mean" if ":" in k else f"cell:{k}:mean" for k in values]
    rows = [((image or ["I"] * n)[i], f"c{i + 1:04d}", float((x or range(1, n + 1))[i]), float((y or [1] * n)[i]), *(None if v[i] is None else float(v[i]) for v in values.values())) for i in range(n)]
    return cell_table(spark.createDataFrame(rows, ", ".join(["image_id string", "cell_id string", "x double", "y double", *(f"`{c}` double" for c in names)])))


def config(*markers, policy=None, rules=None, **k):
    names = [m.marker for m in markers]
    return Config(policy or signal_policy(names), markers, k.pop("parent_sets", {}), Hierarchy(rules or (Rule(rule_id="r", label="L", all_of=(names[0],)),), k.pop("flags", {}), k.pop("flag_policy", {})), **k)


def column(df, name):
    return [r[name] for r in df.orderBy("image_id", "cell_id").collect()]


NONE = MinSupport(max_unavailable=1.0, min_cells=1)


def test_signal_policy_and_fallback(spark):
    table = cells(spark, {"cytoplasm:P": [10, None, -1, 5], "cell:P": [1, 2, 3, None], "cell:Q": [0, 1, -2, None]})
    p = prepare(table, config(Marker("P"), Marker("Q"), policy=signal_policy(["P", "Q"], ["cytoplasm", "cell"], fallback=["cell", None])))
    assert column(p.df, "raw_P") == [10, 2, 3, 5] and column(p.df, "src_P") == [1, 2, 2, 1]
    assert column(p.df, "raw_Q") == [0, 1, None, None] and column(p.df, "src_Q") == [1, 1, 0, 0]


def test_transforms_and_localization(spark):
    p = prepare(cells(spark, {"A": [0, 5, 50], "B": [0, 1, 9], "C": [1, 2, 3]}), config(Marker("A", transform="asinh", cofactor=5.0), Marker("B", transform="log1p"), Marker("C")))
    assert np.allclose(column(p.df, "score_A"), np.arcsinh([0, 1, 10])) and np.allclose(column(p.df, "score_B"), np.log1p([0, 1, 9]))
    m = Marker("S", localization=Localization("nucleus", "cytoplasm", 1.0))
    p = prepare(cells(spark, {"cell:S": [1, 1, 1, 1, 1], "nucleus:S": [9, 2, None, 0, 5], "cytoplasm:S": [3, 4, 1, 0, -1e-9]}), config(m))
    assert column(p.df, "located_S") == [True, True, False, True, False] and column(p.df, "ratio_S")[3] == 1 and column(p.df, "ratio_S")[2] is None


def test_callability(spark):
    rng = random.Random(1)
    log = lambda k: [math.exp(rng.gauss(0, 1)) for _ in range(k)]
    table = cells(spark, {"A": [3] * 199 + [50], "B": [None] * 60 + log(140), "C": log(15) + [-1] * 185, "D": [0] * 200, "E": log(200), "F": log(200)})
    p = prepare(table, config(Marker("A"), Marker("B"), Marker("C", support=MinSupport(max_unavailable=0.99)), Marker("D"), Marker("E"), Marker("F", role="context")))
    got = {r.marker: (r.status, r.support, r.details) for r in p.support.collect()}
    assert got["A"] == ("NOT_CALLABLE_ABSENT", "near_constant", "99.5% of cells share one value.")
    assert got["B"][:2] == ("NOT_CALLABLE_UNAVAILABLE", "mostly_unavailable") and "30.0% of cells" in got["B"][2] and "limit 20.0%" in got["B"][2]
    assert got["C"] == ("NOT_CALLABLE_UNDERPOWERED", "few_cells", "Only 15 cells with signal (minimum 20).")
    assert got["D"][1] == "constant" and got["E"][0] == "PENDING_THRESHOLD" and got["F"][0] == "NOT_GATED"


def test_no_signal_no_positive(spark):
    c = config(Marker("Z", method="manual", args={"value": 0.0}), Marker("A", method="manual", args={"value": 3.0}), rules=(Rule(rule_id="z", label="Z", all_of=("Z",)), Rule(rule_id="a", label="A", all_of=("A",), none_of=("Z",), on_uncallable="treat_as_negative")))
    p = prepare(cells(spark, {"Z": [0] * 40, "A": range(40)}), c)
    with pytest.warns(errors.DisabledRules):
        out = cl.classify(p, th.thresholds(p))
    assert set(column(out.calls, "call_Z")) == {None} and [d["rule_id"] for d in out.disabled] == ["z"]
    assert column(out.df, "cell_type") == ["Undefined"] * 3 + ["A"] * 37


def test_corrections(spark):
    values = {"A": [None, *range(1, 100), *[0] * 100], "B": list(range(1, 201))}
    p = prepare(cells(spark, values, ["1"] * 100 + ["2"] * 100), config(Marker("A", support=MinSupport(max_unavailable=0.5)), Marker("B")))
    for method in correct.METHODS:
        a = column(correct.correct(p, method)[0], "score_A")
        assert a[0] is None and all(math.isfinite(v) for v in a[1:100]) and a[100:] == [None] * 100
    z = column(correct.correct(p, "robust_z")[0], "score_A")[1:100]
    v = np.arange(1, 100)
    assert np.allclose(z, (v - 50) / (1.4826 * np.median(np.abs(v - 50))))


def test_residuals_against_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 3)) @ np.array([[1, 0.5, 0.2], [0, 1, 0.3], [0, 0, 1]]) + 10
    table = cells(spark, {m: x[:, k] for k, m in enumerate("ABC")})
    p = prepare(table, config(*(Marker(m) for m in "ABC")))
    med = np.median(x, 0)
    z = np.clip((x - med) / (1.4826 * np.median(np.abs(x - med), 0)), -5, 5)
    centred = z - z.mean(0)
    load = np.linalg.svd(centred)[2][0]
    load = load * np.sign(load[np.abs(load).argmax()])
    for method, common in (("common_score_residual", z.mean(1)), ("pc1_panel_residual", centred @ load)):
        design = np.column_stack([np.ones(150), common])
        for center in (False, True):
            r = z - design @ np.linalg.lstsq(design, z, rcond=None)[0]
            r = r - r.mean(1, keepdims=True) if center else r
            want = (r - r.mean(0)) / r.std(0, ddof=1)
            out, model = correct.correct(p, method, row_center=center)
            got = np.column_stack([column(out, f"score_{m}") for m in "ABC"])
            assert np.allclose(got, want, atol=1e-8)
            assert np.allclose(got, np.column_stack([column(correct.apply(p, model), f"score_{m}") for m in "ABC"]))


def test_frozen_models(spark):
    part = lambda names: {"median": dict.fromkeys(names, 3.0), "mad": dict.fromkeys(names, 1.0), "slope": dict.fromkeys(names, 0.0), "intercept": dict.fromkeys(names, 0.0), "center": dict.fromkeys(names, 0.0), "scale": dict.fromkeys(names, 1.0)}
    bundle = {"markers": ["A", "B", "C"], "identity": ["A", "B"], "rotation": {"A": 1, "B": 0}, "pc_center": {"A": 0, "B": 0}, "identity_space": part(["A", "B"]), "panel_space": part(["A", "B", "C"])}
    model = correct.import_frozen(bundle, b"f", correct.sha256(b"f"))
    df = spark.createDataFrame([("1", 2.0, 4.0, 5.0), ("2", 1.0, 3.0, None)], "id string, A double, B double, C double")
    rows = correct.apply_frozen(df, model, ["id"]).orderBy("id").collect()
    assert tuple(rows[0])[1:] == (-1, 1, -1, 1, 2) and tuple(rows[1])[1:] == (-1, 1, -1, 1, None)
    with pytest.raises(errors.IntegrityError):
        correct.import_frozen(bundle, b"f", "0" * 64)
    with pytest.raises(errors.IntegrityError):
        correct.apply_frozen(df, replace(model, identity=("A",)), ["id"])
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 5))
    rows = [(str(k), *(None if j == 3 and k < 25 else float(v) for j, v in enumerate(r))) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id string, " + ", ".join(f"{m} double" for m in "ABCDE"))
    model = correct.fit_frozen(df, list("ABCDE"), list("ABC"))
    a = {r.id: tuple(r) for r in correct.apply_frozen(df, model, ["id"]).collect()}
    b = {r.id: tuple(r) for r in correct.apply_frozen(df.where("id < '5'").repartition(3), model, ["id"]).collect()}
    assert all(a[k] == v for k, v in b.items()) and a["3"][-2] is None and a["30"][-2] is not None


def points(*parts):
    return est.Points.of(np.concatenate(parts))


def test_estimators():
    rng = np.random.default_rng(5)
    low, high = rng.normal(0, 0.25, 120), rng.normal(4, 0.25, 120)
    args = {m: METHODS[m].defaults for m in ("valley", "tail", "mixture")}
    for m in ("valley", "mixture"):
        e = est.ESTIMATORS[m](points(low, high), args[m])
        assert e.status == "CALLABLE" and 0.7 < e.estimate < 3.3 and e.n_positive_pool == 120 and e.auc == 1
    assert est.tail(points(rng.normal(0, 0.3, 300), rng.exponential(1, 100) + 1), args["tail"]).status == "CALLABLE"
    for m in args:
        e = est.enforce_pools(est.ESTIMATORS[m](points(rng.normal(2, 0.15, 920), rng.normal(8, 0.15, 80)), args[m]), 100)
        assert e.status == est.UNDERPOWERED and e.estimate is None and e.n_positive_pool < 100
        assert est.ESTIMATORS[m](points(np.ones(500)), args[m]).status.startswith("NOT_CALLABLE")
    close = points(rng.normal(0, 1, 8000), rng.normal(1.7, 1, 8000))
    assert est.mixture(close, args["mixture"] | {"max_overlap": 0.3}).status == "CALLABLE"
    assert est.mixture(close, args["mixture"]).status == est.NO_SEPARATION


def test_weighted_points_equal_repeated_values():
    rng = np.random.default_rng(6)
    v = rng.integers(0, 40, 400).astype(float)
    p = est.Points.of(v)
    for q in (0, 0.01, 0.25, 0.5, 0.99, 1):
        assert math.isclose(p.quantile(q), np.quantile(v, q), abs_tol=1e-12)
    assert math.isclose(p.sd, v.std(ddof=1)) and math.isclose(p.mean, v.mean())
    a, b = est.Points.of(v[:150]), est.Points.of(v[150:])
    want = np.mean([(x > y) + 0.5 * (x == y) for x in v[:150] for y in v[150:]])
    assert math.isclose(est.auc(a, b), want)


def same_rows(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for k in x:
            assert x[k] == y[k] or isinstance(x[k], float) and math.isclose(x[k], y[k], rel_tol=1e-7), (k, x, y)


def test_large_groups_have_the_results_of_small_ones(spark, monkeypatch):
    """Every method by aggregations and by a task of its own: two modes, a skewed outlier, ties, no separation, too few."""
    rng = np.random.default_rng(17)
    two = np.concatenate([rng.normal(2, 0.4, 900), rng.normal(6, 0.4, 600)])
    values = {"A": two, "B": np.concatenate([two[:-1], [5e6]]), "C": rng.normal(5, 1, 1500), "D": np.concatenate([rng.normal(3, 0.3, 1200), rng.exponential(1, 300) + 4]), "E": rng.integers(1, 9, 1500).astype(float), "F": [*two[:60], *[None] * 1440]}
    table = cells(spark, values, ["1"] * 800 + ["2"] * 700)
    for method in ("valley", "tail", "mixture"):
        c = config(*(Marker(m, method=method, args={"max_iter": 15} if method == "mixture" else None, support=NONE) for m in values))
        p = prepare(table, c)
        small = th.thresholds(p)
        with monkeypatch.context() as m:
            m.setattr(th, "POINTS", 5)
            big = th.thresholds(p)
        same_rows(small.rows, big.rows)
        assert {r["status"] for r in small.rows} >= {"CALLABLE"} and list(small.evidence) == list(big.evidence)
        for ref in list(small.evidence)[:2]:
            for name, curve in small.evidence[ref].items():
                assert np.allclose(curve, big.evidence[ref][name], rtol=1e-7, atol=1e-12)
        assert th.evidence_frame(spark, big).select("evidence_ref").distinct().count() == len(big.evidence)


def test_large_parent_pools_have_the_results_of_small_ones(spark, monkeypatch):
    rng = np.random.default_rng(18)
    identity = np.concatenate([rng.normal(1, 0.1, 500), rng.normal(9, 0.1, 500)])
    state = np.concatenate([rng.normal(2, 0.7, 500), rng.normal(4, 0.7, 500)]).round(2)
    flat = rng.integers(1, 5, 1000).astype(float)
    c = config(Marker("A", method="manual", args={"value": 5.0}), *(Marker(m, role="state", method=how, parents=("up",), support=MinSupport(min_cells=20)) for m, how in (("S", "parent_crossing"), ("T", "parent_crossing"), ("U", "valley"))), parent_sets={"up": ("L",)})
    p = prepare(cells(spark, {"A": identity, "S": state, "T": flat, "U": identity + state}), c)
    k = cl.classify(p, th.thresholds(p))
    small = states.state_calls(p, k).rows
    monkeypatch.setattr(th, "POINTS", 2)
    same_rows(small, states.state_calls(p, k).rows)
    assert {r["marker"]: r["status"] for r in small}["S"] == "CALLABLE"
    df = spark.createDataFrame([("1", "m", float(v), bool(i < 500)) for i, v in enumerate(state)], "image_id string, marker string, v double, inside boolean")
    want = est.auc(est.Points.of(state[:500]), est.Points.of(state[500:]))
    for limit in (3, 1000):
        assert math.isclose(large.rank_areas(df, limit)["1", "m"], want)


def test_a_hundred_thousand_distinct_values_with_an_outlier(spark):
    """Two modes and one value of five million: the cut is numpy's, whatever the number of values."""
    rng = np.random.default_rng(19)
    v = np.concatenate([rng.normal(2, 0.4, 60_000), rng.normal(6, 0.4, 40_000), [5e6]])
    frame = spark.createDataFrame(pd.DataFrame({"image_id": "1", "cell_id": [f"c{k}" for k in range(len(v))], "x": 1.0, "y": 1.0, "cell:A:mean": v}))
    p = prepare(cell_table(frame), config(Marker("A")))
    [row] = th.thresholds(p).rows
    want = est.valley(est.Points.of(v), METHODS["valley"].defaults)
    assert row["status"] == want.status == "CALLABLE" and math.isclose(row["estimate"], want.estimate, rel_tol=1e-9) and 3 < row["estimate"] < 5
    assert (row["n_positive_pool"], row["n_negative_pool"]) == (want.n_positive_pool, want.n_negative_pool) and math.isclose(row["negative_q99"], want.negative_q99)


def test_the_binned_density_is_near_the_exact_one():
    rng = np.random.default_rng(20)
    p = points(rng.normal(0, 1, 400), rng.normal(3, 0.5, 200))
    grid, y = est.density(p, -3, 5, 256)
    h = est.bandwidth(p)
    exact = (np.exp(-0.5 * ((grid[:, None] - p.x[None]) / h) ** 2) @ p.w) / (p.n * h * math.sqrt(2 * math.pi))
    assert np.abs(y - exact).max() < 2e-3 * exact.max()


def test_thresholds_overrides_and_coverage(spark):
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.normal(2, 0.2, 150), rng.normal(6, 0.2, 150)])
    table = cells(spark, {"A": v, "B": v}, ["1"] * 300)
    c = config(Marker("A"), Marker("B", method="population_crossing"), overrides=(Override("1", "B", "why", method="manual", args={"value": 4.5}),))
    cuts = th.thresholds(prepare(table, c))
    rows = {r["marker"]: r for r in cuts.rows}
    assert rows["A"]["status"] == "CALLABLE" and 2.6 < rows["A"]["estimate"] < 5.4 and cuts.evidence[rows["A"]["evidence_ref"]]["grid"]
    assert (rows["B"]["status"], rows["B"]["estimate"]) == ("MANUAL", 4.5)
    with pytest.raises(errors.StateError):
        th.validate_thresholds(prepare(table, c), th.Thresholds(cuts.rows[:1], {}, cuts.config_digest))
    pops = prepare(table, c).df.select("image_id", "cell_id", F.when(F.col("score_B") > 4, 2).otherwise(1).alias("population"))
    crossing = {r["marker"]: r for r in th.thresholds(prepare(table, replace(c, overrides=())), population=pops).rows}["B"]
    assert crossing["status"] == "CALLABLE" and 2 < crossing["estimate"] < 6 and (crossing["positive_populations"], crossing["negative_populations"]) == ("2", "1")


def test_fixed_calls_and_candidate_rules(spark):
    df = spark.createDataFrame([("1", 1.0, float("nan")), ("2", 3.0, None), ("3", float("inf"), 5.0)], "id string, A double, B double")
    out = [tuple(r) for r in fixed.threshold_calls(df, ["id"], {"A": 2.0, "B": 5.0}, {"A": True, "B": True}).collect()]
    assert out == [("1", "LOW", "UNAVAILABLE"), ("2", "HIGH", "UNAVAILABLE"), ("3", "UNAVAILABLE", "HIGH")]
    grid = [(f"{a}{b}", a, b) for a in fixed.STATES for b in fixed.STATES]
    calls = spark.createDataFrame(grid, "id string, A string, B string")
    rules = [fixed.Candidate("x", "X", {"A": ("HIGH",)}), fixed.Candidate("y", "Y", {"A": ("HIGH", "LOW")}, {"B": ("LOW",), "A": ("LOW",)})]
    got = {r.id: (r.label, r.rule_id, r.review_authorized) for r in fixed.candidate_rules(calls, ["id"], rules, "D").collect()}
    for key, a, b in grid:
        want = ("D", None)
        want = ("X", "x") if a == "HIGH" else want
        want = ("Y", "y") if a in ("HIGH", "LOW") and (b == "LOW" or a == "LOW") else want
        assert got[key] == (*want, False)


def test_state_diagnostics_truth_table(spark):
    rows = [("a", 2.0, True), ("b", 0.0, True), ("c", None, True), ("d", 2.0, None), ("e", 2.0, False), ("f", float("inf"), True)]
    df = spark.createDataFrame(rows, "id string, v double, p boolean")
    s = fixed.DiagnosticState
    out = {(r.id, r.state): (r.audit_positive, r.measurement_evaluable, r.nullable_positive, r.diagnostic_status.split("_")[0]) for r in fixed.state_diagnostics(df, ["id"], {"F": s("v", 1.0, "p"), "P": s("v", 1.0, "p", audit_missing="propagate"), "N": s("v", None, "p")}).collect()}
    assert out["a", "F"] == (True, True, True, "EVALUABLE") and out["b", "F"] == (False, True, False, "EVALUABLE")
    assert out["c", "F"] == (False, False, None, "UNAVAILABLE") and out["c", "P"] == (None, False, None, "UNAVAILABLE")
    assert out["d", "F"] == (None, True, None, "PARENT") and out["e", "P"] == (False, True, None, "PARENT")
    assert out["f", "F"] == (False, False, None, "UNAVAILABLE") and out["a", "N"] == (False, True, None, "UNAVAILABLE")


def test_structures_with_a_tie(spark):
    xs = [-1.3, -1.2, -1.1, -1, -0.9, -0.7, 0, 0.7, 0.9, 1, 1.1, 1.2, 1.3]
    rows = [("I", f"c{k:02d}", float(x), 0.0, True) for k, x in enumerate(xs)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "image_id string, cell_id string, x double, y double, pending_review boolean").repartition(5)
        s = structures.structures(df, 0.75, 0.75, 6, 2)
        ids = {r.cell_id: r.structure_id for r in s.cells.collect()}
        assert ids["c06"] == ids["c00"] == "E01" and ids["c12"] == "E02" and s.table.count() == 2
    none = structures.structures(df.withColumn("pending_review", F.lit(False)))
    assert none.table.count() == 0 and none.cells.where("structure_id is not null").count() == 0


def slow_eps(xy, low, high, min_pts):
    n = len(xy)
    if n < 2:
        return high
    d = np.sort(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)), axis=1)[:, min(max(1, min_pts - 1), n - 1)]
    return min(high, max(low, np.quantile(d, 0.95)))


def slow_clusters(xy, eps, min_pts):
    """Clusters of points in order, named by their first core point; -1 for none."""
    near = ((xy[:, None] - xy[None]) ** 2).sum(-1) <= eps * eps
    core, label = near.sum(1) >= min_pts, [-1] * len(xy)
    for i in range(len(xy)):
        stack = [i] if core[i] and label[i] < 0 else []
        while stack:
            p = stack.pop()
            if label[p] < 0:
                label[p] = i
                stack += [q for q in np.flatnonzero(near[p]) if core[q]]
    return [label[i] if core[i] else min((label[q] for q in np.flatnonzero(near[i]) if core[q]), default=-1) for i in range(len(xy))]


def test_structures_against_all_pairs(spark):
    """Dense spots, coincident cells, a lattice with ties, an outlier behind the quantile, and eps = 0."""
    rng = np.random.default_rng(3)
    images = {
        "eleven": np.array([[10.0 * k, 0] for k in range(10)] + [[190.0, 0]]), "far": np.array([[0.0, 0], [10, 0], [30, 0], [1030, 0]]), "same": np.zeros((30, 2)), "one": np.zeros((1, 2)), "two": np.array([[0.0, 0], [7, 0]]),
        "dense": np.vstack([rng.random((200, 2)) * 4, rng.random((60, 2)) * 200, [[12.0, 2.0]]]), "lattice": np.array([[i * 5.0, j * 5.0] for i in range(9) for j in range(9)]),
        "mix": np.vstack([rng.normal(size=(80, 2)) * 3, rng.normal(size=(80, 2)) * 3 + [14, 0], np.zeros((20, 2)) - 50, rng.random((40, 2)) * 100]),
    }
    images = {name: xy[np.lexsort((xy[:, 1], xy[:, 0]))] for name, xy in images.items()}
    rows = [(name, f"{k:04d}", float(x), float(y), 1000 * n + k) for n, (name, xy) in enumerate(images.items()) for k, (x, y) in enumerate(xy)]
    df = spark.createDataFrame(rows, "image_id string, id string, x double, y double, ord long").cache()
    for low, high, min_pts in ((1.0, 30.0, 2), (0.0, 30.0, 4), (2.0, 12.0, 3)):
        found = structures.eps_by_image(df, low, high, min_pts)
        assert all(math.isclose(found[name], slow_eps(xy, low, high, min_pts), rel_tol=1e-9, abs_tol=1e-12) for name, xy in images.items())
    assert structures.eps_by_image(df.where("image_id = 'eleven'"), 1.0, 30.0, 2) == {"eleven": 30.0}
    for eps, min_pts in ((5.0, 4), (0.0, 3), (8.0, 10)):
        got = {(r.image_id, r.id): r.cluster for r in structures.dbscan(df.withColumn("eps", F.lit(eps)), min_pts).collect()}
        want = {(name, f"{k:04d}"): 1000 * n + c for n, (name, xy) in enumerate(images.items()) for k, c in enumerate(slow_clusters(xy, eps, min_pts)) if c >= 0}
        assert got == want
    cells = df.withColumnRenamed("id", "cell_id").withColumn("pending_review", F.lit(True)).where("image_id = 'same'")
    assert structures.structures(cells, 0.0, 30.0, 10, 20).table.first().n_cells == 30


def test_dense_squares_that_only_edges_connect(spark):
    """Two dense squares near each other by one pair of members only, which the chosen members do not show."""
    rng = np.random.default_rng(8)
    left, right = rng.random((40, 2)) * 0.3, rng.random((40, 2)) * 0.3 + [1.0, 0.0]
    for gap, clusters in ((0.99, 1), (1.01, 2)):
        xy = np.vstack([left - [left[:, 0].max(), 0], right - [right[:, 0].min(), 0] + [gap, 0]])
        xy[left[:, 0].argmax(), 1] = xy[40 + right[:, 0].argmin(), 1] = 0.15
        xy = xy[np.lexsort((xy[:, 1], xy[:, 0]))]
        df = spark.createDataFrame([("I", f"{k:03d}", float(x), float(y), 1.0, k) for k, (x, y) in enumerate(xy)], "image_id string, id string, x double, y double, eps double, ord long")
        got = {int(r.id): r.cluster for r in structures.dbscan(df, 5).collect()}
        assert [got[k] for k in range(80)] == slow_clusters(xy, 1.0, 5) and len(set(got.values())) == clusters


def test_quantiles_of_groups_of_any_size(spark):
    """Every way of ``order.quantiles`` against numpy: NULL keys, empty and single values, ties, cut brackets."""
    rng = np.random.default_rng(1)
    rows = [(g, float(x), float(y) if y else None, None) for g, n in (("a", 2000), ("b", 1), ("c", 40), (None, 300)) for x, y in zip(rng.lognormal(size=n), rng.integers(0, 5, n))] + [("z", None, float("nan"), None)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double")
    probs = [0, 0.01, 0.25, 0.5, 0.95, 0.999, 1]
    for limit in (None, 50_000, 60, 7):
        out = {(r.g, r.name): (r.n, r.q) for r in order.quantiles(df, ["g"], ["x", "y", "z"], probs, limit).collect()}
        assert len(out) == 15
        for (g, c), (n, q) in out.items():
            v = [r["xyz".index(c) + 1] for r in rows if r[0] == g and r["xyz".index(c) + 1] is not None and not math.isnan(r["xyz".index(c) + 1])]
            assert n == len(v) and (np.allclose(q, np.quantile(v, probs), rtol=1e-12) if v else q == [None] * 7)
    assert order.whole_quantiles(df, ["x", "z"], [0.5]) == {"x": [float(np.median([r[1] for r in rows if r[1]]))], "z": [None]}


def test_basins(spark):
    layout = spark.createDataFrame([(0.1, 0.1), (0.2, 0.3), (1.2, 0.2), (1.5, 1.9)], "u1 double, u2 double")
    labels = np.array([[1, 0], [2, 2]])
    out, kept = embed.assign_basins(layout, np.array([0.0, 1.0]), np.array([0.0, 1.0]), labels, "uncertain", 2, 0)
    assert kept == [1, 2] and sorted((r.u1, r.population) for r in out.collect()) == [(0.1, 1), (0.2, 1), (1.2, 2), (1.5, 2)]
    out, kept = embed.assign_basins(layout.limit(3), np.array([0.0, 1.0]), np.array([0.0, 1.0]), labels, "merge", 2, 0)
    assert kept == [1] and {r.population for r in out.collect()} == {1}
    x = np.linspace(-3, 3, 41)
    z = np.exp(-((x[:, None] + 1.5) ** 2) - x[None] ** 2) + 0.8 * np.exp(-((x[:, None] - 1.5) ** 2) - x[None] ** 2)
    for found in (embed.hill_basins(z), embed.flood_basins(z, 0.03)):
        assert found.max() == 2 and found[10, 20] != found[30, 20]
    assert embed.flood_basins(z, 0.9).max() == 1


def test_umap_layout(spark):
    """Clusters stay together, places repeat with the seed, cells that are no landmarks come to lie in their cluster, and
    an embedding finds the clusters as populations."""
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(4, 5)) * 8
    x = np.vstack([rng.normal(size=(120, 5)) + c for c in centres]) + 40
    own = np.repeat(np.arange(4), 120)
    p = prepare(cells(spark, {m: x[:, k] for k, m in enumerate("ABCDE")}), config(*(Marker(m, support=NONE) for m in "ABCDE")))
    found, names = embed.embedding_input(p)
    pcs = embed.pca_scores(found, [f"x_{m}" for m in names], 5, ["image_id", "cell_id"])[0]
    places = {}
    for landmarks in (5000, 5000, 150):
        out = layout.umap(15, 0.1, 3, landmarks=landmarks)(pcs).orderBy("cell_id").toPandas()
        y = out[["u1", "u2"]].to_numpy()
        _, near = layout.nearest(y, y, 9)
        assert np.isfinite(y).all() and (own[near[:, 1:]] == own[:, None]).mean() > 0.98
        places.setdefault(landmarks, []).append(y)
    assert np.array_equal(*places[5000])
    e = embed.embed(p, grid=80, min_abs=20, floor=0.05, n_neighbors=15)
    groups = e.df.groupBy("population").agg(F.count(F.lit(1)).alias("n")).toPandas()
    labels = e.df.orderBy("cell_id").toPandas().population
    assert len(groups.population.dropna()) >= 4
    for k in labels.dropna().unique():
        assert len(set(own[(labels == k).to_numpy()])) == 1
    a, b = layout.curve(0.1)
    assert math.isclose(a, 1.577, abs_tol=2e-3) and math.isclose(b, 0.895, abs_tol=2e-3)


def analysed(spark, n=300):
    c = example_config()
    p = prepare(simulate(spark, n, seed=7), c)
    cuts = th.thresholds(p)
    k = cl.classify(p, cuts, quiet=True)
    s = states.state_calls(p, k)
    return p, cuts, k, s


def test_simulation_end_to_end(spark):
    a, b = simulate(spark, 200, seed=3), simulate(spark, 200, seed=3)
    assert table_digest(a.df.repartition(5)) == table_digest(b.df) != table_digest(simulate(spark, 200, seed=4).df)
    assert all(c["ok"] for c in validate_cells(a))
    p, cuts, k, s = analysed(spark, 2000)
    truth = p.df.select("image_id", "cell_id", "sim_population").join(k.df, ["image_id", "cell_id"])
    want = {"tumour": "Epithelium, pending", "t_cell": "T cell", "b_cell": "B cell", "macrophage": "Macrophage", "stroma": "Undefined", "contact": "Unresolved"}
    right = sum(want[r.sim_population] == r.cell_type for r in truth.collect())
    assert right >= 0.9 * 2000
    assert states.completeness(s.df, p.df, p.config).count() == 0
    assert s.rows[0]["status"] == "CALLABLE" and s.df.where("enabled").count() == 0
    total = k.summary().groupBy("image_id").agg(F.sum("proportion").alias("t")).first().t
    assert math.isclose(total, 1)
    assert views.dotplot(p, k.df).where("n_observed > 0 and mean_score is null").count() == 0


def small_review(spark):
    v = [*range(1, 13), *range(1, 13)]
    c = config(Marker("A", method="manual", args={"value": 6.5}, support=NONE), Marker("S", role="state", method="manual", args={"value": 6.5}, parents=("P",), support=NONE), rules=(Rule(rule_id="R", label="Pos", all_of=("A",), review=True, pending_label="Wait", decisions={"Tumor": "T", "Benign": "B", "Unresolved": "U"}),), parent_sets={"P": ("Wait", "T")}, refinements=(Refinement("F", "S", "P", "T", "T+"),))
    p = prepare(cells(spark, {"A": v, "S": v}, ["1"] * 12 + ["2"] * 12, x=[*range(12)] * 2), c)
    cuts = th.thresholds(p)
    k = cl.classify(p, cuts)
    return review.review(p, cuts, k, states.state_calls(p, k))


def labels(r, image="1"):
    return [x.cell_type for x in review.replay(r).cells.where(F.col("image_id") == image).orderBy("cell_id").collect()]


def test_cut_undo_redo(spark):
    r = small_review(spark)
    a = r.set_cut("1", "A", 2.5, *WHO)
    b = a.set_cut("1", "A", 9.5, *WHO)
    assert [x["old_estimate"] for x in b.ledgers["cut"]] == [6.5, 2.5]
    undone = b.revert_last(*WHO)
    redone = undone.revert_last(*WHO)
    assert labels(undone) == labels(a) and labels(redone) == labels(b) != labels(a) and labels(b, "2") == labels(r, "2")
    assert redone.ledgers["cut"][-1]["reverts"] == "CL0003" and len(r.ledgers["cut"]) == 0


def test_states_structures_dispositions(spark):
    r = small_review(spark)
    r = r.decide_structure("1", "Tumor", *WHO, box=(0, 100, 0, 10)).set_state("1", "S", "P", "ENABLE", *WHO).set_cut("1", "S", 8.5, *WHO, parent="P")
    assert labels(r) == ["Undefined"] * 6 + ["T"] * 2 + ["T+"] * 4
    assert labels(r.decide_structure("1", "Benign", *WHO, box=(0, 7, 0, 10)))[6:] == ["B"] * 2 + ["T+"] * 4
    off = r.set_state("1", "S", "P", "DISABLE", *WHO)
    assert "T+" not in labels(off) and labels(off.revert_last(*WHO)) == labels(r)
    gone = r.dispose("1", "EXCLUDE", *WHO, box=(0, 100, 0, 10)).dispose("1", "RESTORE", *WHO, cell_id="c0012")
    rows = review.replay(gone).cells.where("image_id = '1'").orderBy("cell_id").collect()
    assert [x.analysed for x in rows] == [False] * 11 + [True] and [x.cell_type for x in rows][-2:] == ["T", "T+"]
    for bad in (lambda: r.dispose("1", "EXCLUDE", *WHO, box=(900, 901, 0, 1)), lambda: r.set_cut("9", "A", 1.0, *WHO), lambda: r.set_cut("1", "A", 1.0, "a\tb", "x"), lambda: r.decide_structure("1", "Tumor", *WHO)):
        with pytest.raises(errors.InputError):
            bad()


def test_many_decisions_join_like_few(spark, monkeypatch):
    r = small_review(spark)
    for k in range(6):
        r = r.dispose("1", ["EXCLUDE", "RESTORE", "DELETE"][k % 3], *WHO, box=(k, k + 4, 0, 10))
    few = [tuple(x) for x in review.replay(r).cells.orderBy("image_id", "cell_id").collect()]
    monkeypatch.setattr(review, "CHAIN", 0)
    assert sorted(map(repr, few)) == sorted(repr(tuple(x)) for x in review.replay(r).cells.select(*review.replay(r).cells.columns).collect())


def test_checkpoint_export_and_tampering(spark, tmp_path):
    r = small_review(spark).set_cut("1", "A", 2.5, *WHO)
    revision = snapshot.save_review(r, str(tmp_path / "ck"))
    loaded, again = snapshot.load_review(small_review(spark), str(tmp_path / "ck"))
    assert loaded.ledgers == r.ledgers and again == revision
    newer = snapshot.save_review(loaded.set_cut("1", "A", 3.5, *WHO), str(tmp_path / "ck"), overwrite=True, revision=revision)
    assert newer != revision
    with pytest.raises(errors.StateError):
        snapshot.save_review(r, str(tmp_path / "ck"), overwrite=True, revision=revision)
    s = snapshot.lock(r, "reviewer")
    assert snapshot.lock(r, "reviewer").review_id == s.review_id != snapshot.lock(r, "other").review_id
    folder = tmp_path / "package"
    assert snapshot.export(s, str(folder)) == s.review_id
    assert all(c["ok"] for c in snapshot.verify_export(spark, str(folder), r, s.review_id))
    tables, meta = snapshot.read_export(spark, str(folder))
    assert meta["review_id"] == s.review_id and snapshot.differences(tables["cells_base"], r.classification.df).count() == 0
    (folder / "config.json").write_text("{}")
    assert not all(c["ok"] for c in check_manifest(folder))
    with pytest.raises(errors.IntegrityError):
        snapshot.archive(str(folder), str(tmp_path / "a.tar.gz"))


def test_a_package_gives_its_review_back(spark, tmp_path):
    """Restored from tables alone, the review replays alike and goes on; a package verifies itself; changed labels fail."""
    p, cuts, k, s = analysed(spark)
    pending = p.df.join(k.df.select("image_id", "cell_id", "pending_review"), ["image_id", "cell_id"])
    r = review.review(p, cuts, k, s, structures.structures(pending, 15, 60, 3, 3))
    image = sorted(r.images)[0]
    cell = p.df.where(F.col("image_id") == image).first().cell_id
    r = r.set_cut(image, "CD3", 1.5, *WHO).dispose(image, "EXCLUDE", *WHO, cell_id=cell)
    folder = str(tmp_path / "package")
    snapshot.export(snapshot.lock(r, "reviewer"), folder)
    assert all(c["ok"] for c in snapshot.verify_export(spark, folder)) and "replay" in {c["check"] for c in snapshot.verify_export(spark, folder)}
    again = snapshot.restore_review(spark, folder)
    assert again.ledgers == r.ledgers and table_digest(review.replay(again).cells) == table_digest(review.replay(r).cells)
    assert review.replay(again.set_cut(image, "CD3", 9.0, *WHO)).cells.count() == p.df.count()
    assert views.first_map(again).count() == views.first_map(snapshot.read_export(spark, folder)[0]).count() > 0
    with pytest.raises(errors.LedgerError):
        snapshot.lock(replace(r, ledgers=r.ledgers | {"disposition": ({**r.ledgers["disposition"][0], "cell_id": "nobody"},)}), "reviewer")


def test_results_are_bound_to_their_scores(spark):
    rng = np.random.default_rng(30)
    v = np.concatenate([rng.normal(2, 0.2, 150), rng.normal(6, 0.2, 150)])
    c = config(Marker("A"), Marker("B"))
    p, other = (prepare(cells(spark, {"A": v + d, "B": v}), c) for d in (0, 1))
    scores, model = correct.correct(p, "robust_z")
    cuts, corrected = th.thresholds(p), th.thresholds(p, scores)
    assert cl.classify(p, cuts).df.count() == cl.classify(p, corrected, scores).df.count() == 300
    for wrong in (lambda: cl.classify(other, cuts), lambda: cl.classify(p, corrected), lambda: cl.classify(p, cuts, scores), lambda: correct.apply(other, model), lambda: states.state_calls(other, cl.classify(p, cuts)), lambda: th.thresholds(other, population=embed.embed(p, grid=20, min_abs=5))):
        with pytest.raises(errors.StateError):
            wrong()
    assert table_digest(cl.classify(p, cuts).callability()) == table_digest(p.callability())


def test_changed_states_are_refused(spark):
    p, cuts, k, s = analysed(spark)
    states.validate_states(p, k, s)
    for wrong in (s.df.withColumn("positive", ~F.col("positive")), s.df.where("score > 1"), s.df.unionByName(s.df.limit(1))):
        with pytest.raises(errors.StateError):
            states.validate_states(p, k, replace(s, df=wrong))


def test_an_example_store_and_hashes_by_the_executors(spark, tmp_path, monkeypatch):
    path = example_path(spark, str(tmp_path / "slide"), 300)
    by_driver = folders.digests(folders.Folder(path), folders.Folder(path).files())
    monkeypatch.setattr(folders, "DRIVER_BYTES", -1)
    assert folders.digests(folders.Folder(path), folders.Folder(path).files()) == by_driver and len(by_driver) > 2
    assert example_path(spark, path) == path and all(c["ok"] for c in check_manifest(path))
    found = read_cells(spark, path).df
    assert found.count() == 300 and found.where("sim_structure is not null and sim_population <> 'tumour'").isEmpty()
    (tmp_path / "slide" / "link").symlink_to("/etc/hosts")
    assert not all(c["ok"] for c in check_manifest(path))


def test_cuts_from_a_file(spark, tmp_path):
    c = config(Marker("A", method="manual", args={"value": 3.0}))
    p = prepare(cells(spark, {"A": range(1, 41)}), c)
    cuts = th.thresholds(p)
    write_tsv(spark.createDataFrame([("I", "A", 7.5)], "image_id string, marker string, estimate double"), str(tmp_path / "cuts"), packed=False)
    r = review.review(p, cuts, cl.classify(p, cuts)).import_cuts(str(tmp_path / "cuts"), *WHO)
    assert [x["new_estimate"] for x in r.ledgers["cut"]] == [7.5] and review.replay(r).cells.where("cell_type = 'L'").count() == 33


def test_cell_store_and_tsv(spark, tmp_path):
    table = simulate(spark, 50, seed=2)
    for form in ("parquet", "tsv.gz"):
        write_cells(table, str(tmp_path / form), form=form)
        back = read_cells(spark, str(tmp_path / form))
        assert table_digest(back.df.select(*table.df.columns)) == table_digest(table.df) and back.features == table.features
    df = spark.createDataFrame([(0.1 + 0.2, True, "a\tb", 1), (None, None, None, None), (1e-300, False, 'q"x', -5)], "d double, b boolean, s string, i int")
    write_tsv(df, str(tmp_path / "t"))
    types = {"d": "double", "b": "boolean", "i": "int"}
    assert sorted(map(repr, read_tsv(spark, str(tmp_path / "t"), types).collect())) == sorted(map(repr, df.collect()))
    with pytest.raises(errors.NumberError):
        read_tsv(spark, str(tmp_path / "t"), {"s": "double"})


def test_configuration(tmp_path):
    c = example_config()
    write_config(c, str(tmp_path / "c.json"))
    assert read_config(str(tmp_path / "c.json")).digest() == c.digest() and all(x["ok"] for x in validate(c))
    wrong = validate(lambda: replace(c, parent_sets={}))
    assert [x["check"] for x in wrong if not x["ok"]] == ["state_parents", "refinements"][:1] or any(not x["ok"] for x in wrong)
    assert not validate(lambda: Config((), (), {}, None))[0]["ok"]
    for bad in (lambda: Marker("A", role="x"), lambda: Marker("A", transform="asinh"), lambda: Rule(rule_id="r", label="l", all_of=("A",), none_of=("A",)), lambda: Flag(none_of=("A",)), lambda: Marker("A", method="manual"), lambda: Override("i", "m", " ")):
        with pytest.raises(errors.ConfigError):
            bad()
    assert len(catalogue()) == 6


def fits(x, schema):
    """Whether a value fits the parts of JSON Schema that ``json_schema`` uses."""
    if "anyOf" in schema:
        return any(fits(x, s) for s in schema["anyOf"])
    if "enum" in schema or "const" in schema:
        return x in schema.get("enum", [schema.get("const")])
    kind = schema.get("type")
    if kind == "object":
        named = schema.get("properties")
        return isinstance(x, dict) and (set(x) == set(named) and all(fits(v, named[k]) for k, v in x.items()) if named else all(fits(v, schema["additionalProperties"]) for v in x.values()))
    if kind == "array":
        return isinstance(x, list) and all(fits(v, schema["items"]) for v in x)
    return not kind or isinstance(x, {"string": str, "boolean": bool, "integer": int, "number": (int, float), "null": type(None)}[kind])


def test_json_schema():
    d = example_config().to_dict()
    assert fits(d, json_schema())
    for change in ({"schema": "other"}, {"panel": [{**d["panel"][0], "role": "none"}]}, {"hierarchy": {}}, {"more": 1}):
        assert not fits(d | change, json_schema())


def test_canonical_json():
    assert canonical({"b": [1, 2.5, None, True], "a": "é"}) == '{"a":"é","b":[1,2.5,null,true]}'
    assert canonical(0.1 + 0.2) == "0.30000000000000004" and canonical(1e15) == "1000000000000000" and canonical(-0.0) == "0"
    for bad in (float("nan"), float("inf"), object()):
        with pytest.raises(errors.InputError):
            canonical(bad)
    assert parse_double("-1.5e3") == -1500 and parse_integer("4") == 4
    for bad in ("0x1", "", "1_0", "nan"):
        with pytest.raises(errors.NumberError):
            parse_double(bad)


def test_stream_of_cuts(spark, tmp_path):
    rows = [(k, f"X{k}", None, "I", "A" if k % 2 else "B", float(k)) for k in range(1, 9)]
    df = spark.createDataFrame(rows, ledger.ENTRY)
    for part, folder in ((df.where("order <= 4"), "a"), (df.where("order > 4"), "b")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = ledger.follow(ledger.entries(spark, str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "ck"))
        query.awaitTermination(60)
    out = {r.marker: r.new_estimate for r in spark.read.parquet(str(tmp_path / "state" / "1")).collect()}
    assert out == {"A": 7.0, "B": 8.0}


#: Queries that replay one scripted review.
REVIEWED = ["refinements", "replay_cells", "replay_states", "verified_export"]


@pytest.fixture(scope="module")
def far_lines(spark, tmp_path_factory):
    """Lines whose keys leave the boxes of the review empty."""
    folder = tmp_path_factory.mktemp("far")
    keys = {c: F.col(c) + 100_000 for c in ("l_orderkey", "l_partkey", "l_suppkey")}
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumns(keys).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize("name", REVIEWED)
def test_reviews_of_tables_whose_boxes_are_empty(spark, far_lines, name):
    duckdb = pytest.importorskip("duckdb")
    found = catalog.queries()[name](spark, far_lines)
    with duckdb.connect() as db:
        db.execute(f"create view lineitem as select * from read_parquet('{far_lines}/lineitem.parquet/*.parquet')")
        wanted = db.execute(f"select {', '.join(f'{chr(34)}{c}{chr(34)}' for c in found.columns)} from ({catalog_sql.SQL[name]})").fetchall()
    assert wanted and sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)


def largest_method(df):
    """Bytes of the largest method that Spark generates for a plan, joins as planned at first."""
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(df.select("*")._jdf.queryExecution().executedPlan())
        return max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_no_method_of_a_replay_or_digest_is_too_large_to_compile(spark):
    """The JVM interprets methods of more than 8,000 bytes for good: a replay and a package took ten times as long."""
    r = catalog._review(spark, "/root/testdata/sf0.001")
    done = review.replay(r)
    assert largest_method(done.cells) < 8000 and largest_method(done.states) < 8000
    assert largest_method(typed_rows(r.prepared.df)) < 8000


def test_table_digest_is_the_sum_of_row_digests(spark):
    import hashlib

    df = spark.createDataFrame([("a", 1.5, 1, True), ("é|;", -0.0, None, None), (None, None, 3, False), ("a", 1.5, 1, True)], "t string, d double, n int, b boolean")
    rows = ["b|boolean|4:true;d|double|3:1.5;n|int|1:1;t|string|1:a;", "b|boolean|-;d|double|3:0.0;n|int|-;t|string|4:é|;;", "b|boolean|5:false;d|double|-;n|int|1:3;t|string|-;"]
    words = [[int.from_bytes(hashlib.sha256(rows[k].encode()).digest()[i : i + 4]) for i in range(0, 32, 4)] for k in (0, 1, 2, 0)]
    kinds = [["b", "boolean"], ["d", "double"], ["n", "int"], ["t", "string"]]
    for table in (df.coalesce(1), df.repartition(7)):
        assert table_digest(table) == sha256({"columns": kinds, "sums": ["4", *(str(sum(w)) for w in zip(*words, strict=True))]})
    assert table_digest(df.limit(0)) == sha256({"columns": kinds, "sums": ["0", *["None"] * 8]})


def test_a_snapshot_that_has_changed_is_not_exported(spark, tmp_path):
    s = snapshot.lock(small_review(spark), "reviewer")
    other = replace(s, tables=s.tables | {"calls": s.tables["calls"].withColumn("call_A", F.lit(True))})
    for changed in (other, replace(s, reviewer="other"), replace(s, digests=s.digests | {"calls": "0" * 64})):
        with pytest.raises(errors.IntegrityError, match="has changed since it was locked"):
            snapshot.export(changed, str(tmp_path / "package"))
    assert not list(tmp_path.glob("*package*")) and not list(tmp_path.glob(".package*"))
