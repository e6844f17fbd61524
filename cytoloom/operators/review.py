"""Review ledgers and their replay.

Four append-only ledgers (cuts, structures, dispositions, states) are small and live on the driver; every action is a
new row, undo included, and the effective result is a function of the base objects and the rows. Replay turns the
active rows into small broadcast tables and literals over the lazy cells.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EmptySelection, InputError, LedgerError, StateError, check_text, require
from ..functions.canonical import canonical, sha256
from ..functions.columns import apart, col, in_box
from ..plans.config import DECISIONS, Config
from ..sources.tsv import read_tsv
from ..storage import small
from .classify import Classification, classify, cut_row, disabled_rules, label_names, labelled
from .components import checkpoint_ready
from .prepare import KEYS, Prepared, same_scores
from .states import StateCalls, evaluable, in_labels, min_ratio, pairs, positive, ratio_of
from .structures import Structures
from .thresholds import Thresholds, validate_thresholds

PREFIX = {"cut": "CL", "structure": "ER", "disposition": "XR", "state": "SL"}
COMMON = "sequence int, order int, entry_id string, time_utc string, reviewer string, image_id string, reason string, reverts string"
BOX = "xmin double, xmax double, ymin double, ymax double"
SCHEMAS = {
    "cut": f"{COMMON}, marker string, parent string, old_estimate double, new_estimate double, old_status string",
    "structure": f"{COMMON}, mode string, structure_id string, {BOX}, decision string, n_affected_at_creation int, cut_at_creation int",
    "disposition": f"{COMMON}, mode string, cell_id string, {BOX}, disposition string, n_affected_at_creation int",
    "state": f"{COMMON}, marker string, parent string, action string, old_estimate double, new_estimate double",
}
DISPOSITIONS, ACTIONS = ("EXCLUDE", "DELETE", "RESTORE"), ("ENABLE", "DISABLE", "SET_CUT")
Row = dict[str, Any]


def columns(name: str) -> list[str]:
    return [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]


def now_utc() -> str:
    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def reverted(ledgers: dict[str, tuple[Row, ...]]) -> set[str]:
    """Entries that are undone, from the newest back: an undo that isn't undone itself skips its target."""
    skipped: set[str] = set()
    for row in sorted((r for rows in ledgers.values() for r in rows), key=lambda r: -r["order"]):
        if row["reverts"] and row["entry_id"] not in skipped:
            skipped.add(row["reverts"])
    return skipped


def active(ledgers: dict[str, tuple[Row, ...]], name: str) -> list[Row]:
    """The rows of a ledger that count, by order: no undo rows, nothing undone."""
    skipped = reverted(ledgers)
    return sorted((r for r in ledgers[name] if not r["reverts"] and r["entry_id"] not in skipped), key=lambda r: r["order"])


def active_frame(entries: DataFrame) -> DataFrame:
    """The same for a table of entries (order, entry_id, reverts, ...) in which undo chains name single entries: an entry
    counts if the chain of undos that ends in it has an even number of links; chains are walked by joins."""
    checkpoint_ready(entries)
    undo = entries.where("reverts is not null and reverts <> ''").select(F.col("entry_id").alias("undo"), F.col("reverts").alias("target"))
    # undone(x) <=> some undo of x is itself not undone; links point to older entries, so rounds end
    live = undo.select("undo", "target", F.lit(True).alias("live"))
    while True:
        killers = live.where("live").select(F.col("target").alias("undo")).distinct().withColumn("dead", F.lit(True))
        new = undo.join(killers, "undo", "left").select("undo", "target", F.col("dead").isNull().alias("live")).checkpoint()
        if new.exceptAll(live).isEmpty():
            break
        live = new
    dead = live.where("live").select(F.col("target").alias("entry_id")).distinct()
    return entries.where("reverts is null or reverts = ''").join(dead, "entry_id", "left_anti")


def validate_keys(review: Review) -> None:
    """Every single cell and structure that a ledger names is there; one join for each ledger."""
    for name, single, there in (("disposition", "cell_id", review.prepared.df), ("structure", "structure_id", review.structures.cells if review.structures else None)):
        named = sorted({(r["image_id"], r[single]) for r in review.ledgers[name] if r[single] is not None})
        if not named:
            continue
        require(there is not None, f"{name} ledger: there are no structures", LedgerError)
        wanted = review.spark.createDataFrame(named, f"image_id string, {single} string")
        missing = wanted.join(there.select("image_id", single).distinct(), ["image_id", single], "left_anti").first()
        require(missing is None, f"{name} ledger: {missing and tuple(missing)} is unknown", LedgerError)


def validate_ledgers(review: Review) -> None:
    """Orders rise without repeats over all ledgers, ids are unique, undos name earlier rows of the same ledger, values lie
    in their domains."""
    seen: set[int] = set()
    ids: dict[str, tuple[str, int]] = {}
    for name, rows in review.ledgers.items():
        last = 0
        for r in rows:
            require(set(r) == set(columns(name)), f"{name} ledger: columns differ", LedgerError)
            require(isinstance(r["order"], int) and r["order"] > last and r["order"] not in seen and r["sequence"] == r["order"], f"{r['entry_id']}: order", LedgerError)
            require(r["entry_id"] == f"{PREFIX[name]}{r['order']:04d}" and r["entry_id"] not in ids, f"{r['entry_id']}: id", LedgerError)
            try:
                check_text(r["reviewer"], "reviewer", 200)
                check_text(r["reason"], "reason", 1000)
            except InputError as e:
                raise LedgerError(f"{r['entry_id']}: {e}") from e
            domain = {"structure": ("decision", DECISIONS), "disposition": ("disposition", DISPOSITIONS), "state": ("action", ACTIONS)}.get(name)
            require(not domain or r[domain[0]] in domain[1], f"{r['entry_id']}: value", LedgerError)
            require(r["image_id"] in review.images, f"{r['entry_id']}: unknown image", LedgerError)
            if name in ("cut", "state"):
                require(r["marker"] in (review.config.gated if name == "cut" else review.config.states), f"{r['entry_id']}: unknown marker", LedgerError)
            if r["reverts"]:
                require(ids.get(r["reverts"], ("", 0))[0] == name, f"{r['entry_id']}: undoes no earlier row of its ledger", LedgerError)
            last = r["order"]
            seen.add(last)
            ids[r["entry_id"]] = (name, last)


@dataclass(frozen=True)
class Review:
    """Base objects and ledgers; every action returns a new review."""

    prepared: Prepared
    thresholds: Thresholds
    classification: Classification
    states: StateCalls | None
    structures: Structures | None
    images: frozenset[str]
    scores: DataFrame | None = None
    ledgers: dict[str, tuple[Row, ...]] = field(default_factory=lambda: {n: () for n in PREFIX})
    clock: Callable[[], str] = now_utc

    def __repr__(self) -> str:
        return f"<Review {', '.join(f'{len(v)} {k}' for k, v in self.ledgers.items())}>"

    @property
    def config(self) -> Config:
        return self.prepared.config

    @property
    def spark(self):
        return self.prepared.df.sparkSession

    def frame(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([tuple(r[c] for c in columns(name)) for r in self.ledgers[name]], SCHEMAS[name])

    def append(self, name: str, image: str, reviewer: str, reason: str, **values: Any) -> Review:
        require(image in self.images, f"unknown image {image}")
        check_text(reviewer, "reviewer", 200)
        check_text(reason, "reason", 1000)
        order = max((r["order"] for rows in self.ledgers.values() for r in rows), default=0) + 1
        row = dict.fromkeys(columns(name)) | {"sequence": order, "order": order, "entry_id": f"{PREFIX[name]}{order:04d}", "time_utc": self.clock(), "reviewer": reviewer, "image_id": image, "reason": reason} | values
        return replace(self, ledgers=self.ledgers | {name: (*self.ledgers[name], row)})

    def effective(self, image: str, marker: str) -> tuple[float | None, str | None]:
        """Estimate and status of an identity cut as the active rows leave it."""
        row = self.thresholds.lookup(image, marker)
        mine = [r for r in active(self.ledgers, "cut") if (r["image_id"], r["marker"], r["parent"]) == (image, marker, None)]
        return (mine[-1]["new_estimate"], "MANUAL") if mine else (row["estimate"], row["status"]) if row else (None, None)

    def set_cut(self, image: str, marker: str, estimate: float, reviewer: str, reason: str, parent: str | None = None) -> Review:
        require(marker in self.config.gated or marker in self.config.states, f"unknown marker {marker}")
        require(isinstance(estimate, (int, float)) and abs(estimate) < float("inf"), "a cut must be finite")
        if marker in self.config.states:
            return self.set_state(image, marker, parent, "SET_CUT", reviewer, reason, estimate)
        old, status = self.effective(image, marker)
        return self.append("cut", image, reviewer, reason, marker=marker, parent=None, old_estimate=old, new_estimate=float(estimate), old_status=status)

    def set_state(self, image: str, marker: str, parent: str | None, action: str, reviewer: str, reason: str, estimate: float | None = None) -> Review:
        require(action in ACTIONS and (action == "SET_CUT") == (estimate is not None), f"actions are {ACTIONS}; SET_CUT has an estimate")
        require(marker in self.config.states and parent in self.config.marker(marker).parents, "unknown state marker or parent")
        base = next((r["estimate"] for r in (self.states.rows if self.states else ()) if (r["image_id"], r["marker"], r["parent"]) == (image, marker, parent)), None)
        mine = [r["new_estimate"] for r in active(self.ledgers, "state") if (r["image_id"], r["marker"], r["parent"], r["action"]) == (image, marker, parent, "SET_CUT")]
        return self.append("state", image, reviewer, reason, marker=marker, parent=parent, action=action, old_estimate=mine[-1] if mine else base, new_estimate=None if estimate is None else float(estimate))

    def _boxed(self, box: tuple[float, ...] | None) -> dict[str, float]:
        if box is None:
            return {}
        require(len(box) == 4 and all(abs(v) < float("inf") for v in box) and box[0] <= box[1] and box[2] <= box[3], "a box is xmin, xmax, ymin, ymax in order")
        return dict(zip(("xmin", "xmax", "ymin", "ymax"), map(float, box), strict=True))

    def decide_structure(self, image: str, decision: str, reviewer: str, reason: str, structure_id: str | None = None, box: tuple[float, ...] | None = None) -> Review:
        require(decision in DECISIONS, f"decisions are {DECISIONS}")
        require((structure_id is None) != (box is None), "either a structure or a box")
        edges = self._boxed(box)
        cells = self.prepared.df.where(F.col("image_id") == image)
        if structure_id is not None:
            found = self.structures.cells.where((F.col("image_id") == image) & (F.col("structure_id") == structure_id)).count() if self.structures else 0
            require(found, f"unknown structure {structure_id}")
        else:
            found = cells.where(in_box(F.col("x"), F.col("y"), tuple(edges.values()))).count()
        return self.append("structure", image, reviewer, reason, mode="STRUCTURE" if structure_id else "BBOX", structure_id=structure_id, decision=decision, n_affected_at_creation=found, cut_at_creation=len(self.ledgers["cut"]), **edges)

    def dispose(self, image: str, disposition: str, reviewer: str, reason: str, cell_id: str | None = None, box: tuple[float, ...] | None = None) -> Review:
        require(disposition in DISPOSITIONS, f"dispositions are {DISPOSITIONS}")
        require((cell_id is None) != (box is None), "either a cell or a box")
        edges = self._boxed(box)
        cells = self.prepared.df.where(F.col("image_id") == image)
        found = cells.where(F.col("cell_id") == cell_id).count() if cell_id is not None else cells.where(in_box(F.col("x"), F.col("y"), tuple(edges.values()))).count()
        require(found, "nothing is selected", EmptySelection)
        return self.append("disposition", image, reviewer, reason, mode="POINT" if cell_id is not None else "BBOX", cell_id=cell_id, disposition=disposition, n_affected_at_creation=found, **edges)

    def revert_last(self, reviewer: str, reason: str) -> Review:
        """Undoes the newest row of all ledgers; if that is an undo, redoes."""
        name, row = max(((n, r) for n, rows in self.ledgers.items() for r in rows), key=lambda x: x[1]["order"], default=(None, None))
        require(row, "there is nothing to undo", StateError)
        values = {k: v for k, v in row.items() if k not in COMMON_NAMES}
        return self.append(name, row["image_id"], reviewer, reason, reverts=row["entry_id"], **values)

    def callability(self) -> DataFrame:
        return self.prepared.support

    def import_cuts(self, rows: list[Row] | str, reviewer: str, reason: str) -> Review:
        """One ledger row for each (image_id, marker, estimate[, parent]), given as rows or as the path of a TSV."""
        if isinstance(rows, str):
            table = read_tsv(self.spark, rows, {"estimate": "double"})
            require({"image_id", "marker", "estimate"} <= set(table.columns), "a file of cuts has image_id, marker and estimate", InputError)
            rows = [r.asDict() for r in table.collect()]  # a row for each action of a person
        require(all(r["estimate"] is not None for r in rows), "a cut has no estimate", InputError)
        out = self
        for r in rows:
            out = out.set_cut(r["image_id"], r["marker"], float(r["estimate"]), reviewer, reason, r.get("parent"))
        return out

    def ledger_digest(self) -> str:
        return sha256(canonical({n: list(rows) for n, rows in self.ledgers.items()}))


COMMON_NAMES = {c.split(" ")[0] for c in COMMON.split(", ")}


def review(prepared: Prepared, thresholds: Thresholds, classification: Classification, states: StateCalls | None = None, structures: Structures | None = None, scores: DataFrame | None = None) -> Review:
    digests = {prepared.config.digest(), thresholds.config_digest, classification.config.digest(), *([states.config.digest()] if states else [])}
    require(len(digests) == 1, "inputs do not share a configuration", StateError)
    same_scores(thresholds.score_digest, prepared, scores, "thresholds")
    same_scores(classification.score_digest, prepared, classification.scores, "labels")
    images = frozenset(r.image_id for r in prepared.support.select("image_id").distinct().collect())
    return Review(prepared, thresholds, classification, states, structures, images, scores)


# --- replay ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Replayed:
    """cells: keys, x, y, cell_type, rule_id, pending_review, flags, excluded, base_cell_type, structure_id,
    structure_decision, disposition_effective, analysed. states: the effective long table or None."""

    cells: DataFrame
    states: DataFrame | None
    thresholds: Thresholds
    disabled: tuple[dict[str, str], ...]

    def __repr__(self) -> str:
        return f"<Replayed {len(self.thresholds.rows)} thresholds>"


def effective_thresholds(base: Thresholds, rows: list[Row]) -> Thresholds:
    """Cuts with the last active row of each; details name the entry."""
    out = [dict(r) for r in base.rows]
    places: dict[tuple[str, str], list[int]] = {}
    for k, t in enumerate(out):
        if t["parent"] is None:
            places.setdefault((t["image_id"], t["marker"]), []).append(k)
    for r in rows:
        hits = places.get((r["image_id"], r["marker"]), [])
        require(len(hits) == 1, "a reviewed cut must name exactly one threshold", LedgerError)
        out[hits[0]].update(estimate=r["new_estimate"], status="MANUAL", method="manual", rule="manual", args_json=canonical({"value": r["new_estimate"]}), details=f"Cut given by ledger entry {r['entry_id']}.")
    return replace(base, rows=tuple(out))


def last_decision(cells: DataFrame, rows: list[Row], value: str, hit: Callable[[Row], Column]) -> Column:
    """The value of the newest row that hits a cell, as one CASE chain, newest first; NULL without one."""
    out = None
    for r in sorted(rows, key=lambda r: -r["order"]):
        here = (F.col("image_id") == r["image_id"]) & hit(r)
        out = F.when(here, F.lit(r[value])) if out is None else out.when(here, F.lit(r[value]))
    return F.lit(None).cast("string") if out is None else out


#: Beyond this many rows decisions are joined instead of compiled into a CASE chain.
CHAIN = 200


def decided(cells: DataFrame, rows: list[Row], value: str, single: str, schema: str) -> DataFrame:
    """``cells`` with a column ``value`` of the newest active row that names the cell's ``single`` column or whose box
    holds the cell; a range join on the image with a broadcast of the ledger (a few rows for each person's action)."""
    spark = cells.sparkSession
    if len(rows) <= CHAIN:
        return cells.withColumn(value, last_decision(cells, rows, value, lambda r: F.coalesce(F.col(single) == r[single], F.lit(False)) if r[single] is not None else in_box(F.col("x"), F.col("y"), (r["xmin"], r["xmax"], r["ymin"], r["ymax"]))))
    log = spark.createDataFrame([(r["image_id"], r["order"], r[single], r["xmin"], r["xmax"], r["ymin"], r["ymax"], r[value]) for r in rows], "l_image string, l_order int, l_single string, xmin double, xmax double, ymin double, ymax double, l_value string")
    inside = F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))
    named = F.when(F.col("l_single").isNotNull(), F.col("l_single") == F.col(single)).otherwise(inside)
    hits = cells.join(small(log, len(rows)), (F.col("image_id") == F.col("l_image")) & F.coalesce(named, F.lit(False)))
    newest = hits.groupBy(*KEYS).agg(F.max_by("l_value", "l_order").alias(value))
    return cells.join(newest, KEYS, "left")


def relabelled(cells: DataFrame, config: Config, on: Callable[[str, str], Column]) -> DataFrame:
    """Refinements in their order: analysed cells with the label and an enabled positive state are relabelled."""
    label = F.col("cell_type")
    for r in config.refinements:
        label = F.when(F.coalesce(on(r.marker, r.parent), F.lit(False)) & (label == r.from_label) & F.col("analysed"), F.lit(r.to_label)).otherwise(label)
    return cells.withColumn("cell_type", label)


def refine(cells: DataFrame, config: Config) -> DataFrame:
    """Refinements by the states that the rows hold."""
    every = pairs(config)
    return relabelled(cells, config, lambda m, p: F.col(f"_on_{every.index((m, p))}") if (m, p) in every else F.lit(False))


def refine_joined(cells: DataFrame, states: DataFrame, config: Config) -> DataFrame:
    """Refinements by a long table of states, joined once for all."""
    if not config.refinements:
        return cells
    keys = list(dict.fromkeys((r.marker, r.parent) for r in config.refinements))
    on = F.col("enabled") & F.col("positive")
    wide = states.where(on).groupBy(*KEYS).agg(*(F.bool_or((F.col("marker") == m) & (F.col("parent") == p)).alias(f"_r{k}") for k, (m, p) in enumerate(keys)))
    return relabelled(cells.join(wide, KEYS, "left"), config, lambda m, p: F.col(f"_r{keys.index((m, p))}"))


def replay(r: Review) -> Replayed:
    validate_ledgers(r)
    config, h = r.config, r.config.hierarchy
    cuts = effective_thresholds(r.thresholds, active(r.ledgers, "cut"))
    cells, disabled = reclassified(r, cuts)
    cells = cells.join(r.structures.cells, KEYS, "left") if r.structures else cells.withColumn("structure_id", F.lit(None).cast("string"))
    cells = decided(cells, active(r.ledgers, "structure"), "decision", "structure_id", SCHEMAS["structure"]).withColumnRenamed("decision", "structure_decision")
    label, pending = F.col("cell_type"), F.col("pending_review")
    for rule in h.rules:
        if rule.review:
            here = (F.col("rule_id") == rule.rule_id) & F.col("structure_decision").isNotNull()
            new_label = F.lit(None).cast("string")
            for d, text in rule.decisions.items():
                new_label = F.when(F.col("structure_decision") == d, F.lit(text)).otherwise(new_label)
            label, pending = F.when(F.coalesce(here, F.lit(False)), new_label).otherwise(label), F.when(F.coalesce(here, F.lit(False)), F.lit(False)).otherwise(pending)
    cells = cells.withColumns({"cell_type": label, "pending_review": pending})
    cells = decided(cells, active(r.ledgers, "disposition"), "disposition", "cell_id", SCHEMAS["disposition"])
    effective = F.when(F.col("disposition") == "RESTORE", F.lit("NONE")).otherwise(F.coalesce("disposition", F.lit("NONE")))
    cells = cells.withColumn("disposition_effective", effective).drop("disposition").withColumn("analysed", ~F.col("excluded") & (F.col("disposition_effective") == "NONE"))
    states = None
    if r.states:
        if r.states.scores is r.scores:
            cells = with_states(r, cells)
            states = cells.select(*KEYS, F.inline("_states"))
            cells = refine(cells, config)
        else:
            states = effective_states(r, cells)
            cells = refine_joined(cells, states, config)
    return Replayed(cells.select(*KEYS, "x", "y", *label_names(config), "base_cell_type", "structure_id", "structure_decision", "disposition_effective", "analysed"), states, cuts, disabled)


def reclassified(r: Review, cuts: Thresholds) -> tuple[DataFrame, tuple[Row, ...]]:
    """All prepared columns with the labels of the effective cuts and base_cell_type. The base classification brings its
    rows along, so both labels come from one row; only a classification of other scores is joined by key."""
    config = r.config
    if r.classification.scores is not r.scores:
        new = classify(r.prepared, cuts, r.scores, quiet=True)
        return new.full.join(r.classification.df.select(*KEYS, F.col("cell_type").alias("base_cell_type")), KEYS), new.disabled
    require(cuts.config_digest == config.digest(), "thresholds belong to another configuration", StateError)
    validate_thresholds(r.prepared, cuts, r.scores)
    by_image = cut_row(r.prepared, cuts)
    off = disabled_rules(config, by_image)
    made = {f"{kind}_{m}" for kind in ("cut", "call") for m in config.gated} | {f"on_{k}" for k in range(len(config.hierarchy.rules))} | set(label_names(config))
    base = r.classification.full
    kept = [col(c) for c in base.columns if c not in made]
    return labelled(apart(base.select(*kept, F.col("cell_type").alias("base_cell_type")), "image_id"), config, by_image, off), tuple(off)


def state_decisions(r: Review) -> dict[tuple[str, str, str], dict[str, Any]]:
    """(image, marker, parent) -> enabled and cut (None: the base one), of the active rows."""
    last: dict[tuple[str, str, str], dict[str, Any]] = {}
    for row in active(r.ledgers, "state"):
        slot = last.setdefault((row["image_id"], row["marker"], row["parent"]), {"enabled": False, "cut": None})
        if row["action"] == "SET_CUT":
            slot["cut"] = row["new_estimate"]
        else:
            slot["enabled"] = row["action"] == "ENABLE"
    return last


def with_states(r: Review, cells: DataFrame) -> DataFrame:
    """``cells`` with _states, an array of the effective states of each state marker and parent: in_parent and positive from
    effective labels and cuts; evaluability is the row's own, so a manual cut cannot create support. _on_<number of the pair>:
    whether its state is enabled and positive."""
    config = r.config
    every = pairs(config)
    decisions = state_decisions(r)
    base = {(t["image_id"], t["marker"], t["parent"]): t["estimate"] for t in r.states.rows}
    rows = []
    for image in sorted(r.images):
        slots = [decisions.get((image, m, p), {"enabled": False, "cut": None}) for m, p in every]
        rows.append((image, *(s["cut"] if s["cut"] is not None else base.get((image, m, p)) for s, (m, p) in zip(slots, every, strict=True)), *(s["enabled"] for s in slots)))
    schema = ", ".join(["_image string", *(f"_estimate_{k} double" for k in range(len(every))), *(f"_enabled_{k} boolean" for k in range(len(every)))])
    joined = apart(cells, "image_id").join(small(r.spark.createDataFrame(rows, schema), len(rows)), F.col("image_id") == F.col("_image"), "left")
    parts, on = [], {}
    for k, (marker, parent) in enumerate(every):
        inside, fit, score, ratio = in_labels(F.col("cell_type"), config, [parent]), evaluable(config, marker), col(f"score_{marker}"), ratio_of(config, marker)
        cut, enabled = F.col(f"_estimate_{k}"), F.coalesce(F.col(f"_enabled_{k}"), F.lit(False))
        up = F.coalesce(fit & inside & (ratio >= F.lit(min_ratio(config, marker))) & cut.isNotNull() & (score >= cut), F.lit(False))
        parts.append(F.struct(F.lit(marker).alias("marker"), F.lit(parent).alias("parent"), inside.alias("in_parent"), fit.alias("evaluable"), score.alias("score"), cut.alias("estimate"), ratio.alias("localization_ratio"), up.alias("positive"), enabled.alias("enabled")))
        on[f"_on_{k}"] = enabled & up
    return joined.withColumns({"_states": F.array(*parts)} | on)


def effective_states(r: Review, cells: DataFrame) -> DataFrame:
    """in_parent and positive from effective labels and base estimates; enablement and cuts from the active rows. Base
    evaluability stays, so a manual cut cannot create support."""
    config = r.config
    last = state_decisions(r)
    table = small(cells.sparkSession.createDataFrame([(*k, v["enabled"], v["cut"]) for k, v in last.items()], "image_id string, marker string, parent string, l_enabled boolean, l_cut double"), len(last))
    base = r.states.df.drop("in_parent", "positive", "enabled").join(cells.select(*KEYS, "cell_type"), KEYS).join(table, ["image_id", "marker", "parent"], "left")
    inside, ratio = F.lit(False), F.lit(0.0)
    for parent in config.parent_sets:
        inside = F.when(F.col("parent") == parent, in_labels(F.col("cell_type"), config, [parent])).otherwise(inside)
    for m in config.states:
        ratio = F.when(F.col("marker") == m, F.lit(min_ratio(config, m))).otherwise(ratio)
    joined = base.withColumn("in_parent", inside).withColumn("min_ratio", ratio).withColumn("estimate", F.coalesce("l_cut", "estimate"))
    return joined.select(*KEYS, "marker", "parent", "in_parent", "evaluable", "score", "estimate", "localization_ratio", positive(F.col("estimate")).alias("positive"), F.coalesce("l_enabled", F.lit(False)).alias("enabled"))
