"""Checkpoints of reviews, and locked packages: content-addressed, self-verified, replayed again when verified."""

from __future__ import annotations

import json
import os
import socket
import tarfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IntegrityError, LockError, StateError, check_text, require
from ..functions.canonical import canonical, fingerprint, sha256, table_digest
from ..plans.config import Config
from ..sources.folders import Folder
from ..sources.manifest import check_manifest, locked, published, verify_manifest
from ..storage import stored
from .classify import classify
from .prepare import Prepared, score_digest
from .review import PREFIX, SCHEMAS, Review, Row, columns, now_utc, replay, review, validate_keys, validate_ledgers
from .states import StateCalls
from .structures import Structures
from .thresholds import Thresholds

STATUSES = ("PENDING", "REVIEWED")
CHANGED = "the snapshot has changed since it was locked"


# --- checkpoints ----------------------------------------------------------------------------------------------------


def base_digest(r: Review) -> str:
    """What ledgers belong to: configuration and base thresholds."""
    return sha256({"config": r.config.digest(), "thresholds": [dict(t) for t in r.thresholds.rows], "images": sorted(r.images)})


def _owner() -> dict[str, Any]:
    return {"pid": os.getpid(), "host": socket.gethostname(), "time_utc": now_utc()}


def _owner_file(folder: str | Path) -> Path:
    target = Path(folder).absolute()
    return target.with_name(f".{target.name}.owner")


def owned(folder: str | Path) -> bool:
    path = _owner_file(folder)
    if not path.exists():
        return False
    who = json.loads(path.read_text())
    return (who["pid"], who["host"]) == (os.getpid(), socket.gethostname())


def acquire(folder: str | Path, takeover: bool = False) -> None:
    path = _owner_file(folder)
    if path.exists() and not owned(folder) and not takeover:
        raise LockError(f"{folder} is owned by {path.read_text().strip()}")
    path.write_text(canonical(_owner()) + "\n")


def save_review(r: Review, folder: str, overwrite: bool = False, revision: str | None = None) -> str:
    """Writes ledgers, configuration and digests; returns the revision. ``revision`` is the one that the caller read: a
    folder that has moved on meanwhile isn't overwritten."""
    validate_ledgers(r)
    with locked(folder):
        target = Path(folder)
        if target.exists():
            require(overwrite, f"{folder} exists", StateError)
            if not owned(folder):
                acquire(folder)
            now = json.loads((target / "review.json").read_text())["revision"]
            require(revision is None or now == revision, "the checkpoint has changed since it was read", StateError)
        else:
            target.parent.mkdir(parents=True, exist_ok=True)
            acquire(folder)
        ledgers = {n: list(rows) for n, rows in r.ledgers.items()}
        meta = {"base": base_digest(r), "config": r.config.digest(), "ledgers": sha256(canonical(ledgers)), "revision": sha256(canonical({"base": base_digest(r), "ledgers": ledgers}))}
        with published(folder, overwrite=True) as staged:
            (staged / "config.json").write_text(canonical(r.config.to_dict()) + "\n")
            (staged / "ledgers.json").write_text(canonical(ledgers) + "\n")
            (staged / "review.json").write_text(canonical(meta) + "\n")
        return meta["revision"]


def _ledgers_of(data: dict[str, list[Row]]) -> dict[str, tuple[Row, ...]]:
    doubles = {n: {c.split(" ")[0] for c in SCHEMAS[n].split(", ") if c.endswith(" double")} for n in PREFIX}
    return {n: tuple({c: float(v) if c in doubles[n] and v is not None else v for c, v in row.items()} for row in data[n]) for n in PREFIX}


def load_review(r: Review, folder: str, takeover: bool = False) -> tuple[Review, str]:
    """The base review ``r`` with the checkpoint's ledgers, and the revision; takes ownership."""
    with locked(folder):
        out, revision = read_checkpoint(r, folder)
        acquire(folder, takeover)
    return out, revision


def read_checkpoint(r: Review, folder: str) -> tuple[Review, str]:
    verify_manifest(folder)
    root = Path(folder)
    meta, ledgers = json.loads((root / "review.json").read_text()), json.loads((root / "ledgers.json").read_text())
    require(sha256(canonical(ledgers)) == meta["ledgers"], "the ledgers differ from their digest", IntegrityError)
    require(Config.from_dict(json.loads((root / "config.json").read_text())).digest() == meta["config"], "the configuration differs from its digest", IntegrityError)
    require(meta["base"] == base_digest(r), "the checkpoint belongs to another base", StateError)
    out = replace(r, ledgers=_ledgers_of(ledgers))
    validate_ledgers(out)
    return out, meta["revision"]


def replace_ledgers(r: Review, folder: str, backup: str, scope: tuple[str, ...] = tuple(PREFIX), confirm: bool = False) -> Review:
    """Takes some ledgers from a checkpoint of the same base; the present review is saved to ``backup`` first."""
    require(confirm, "replacing ledgers must be confirmed", StateError)
    require(set(scope) <= set(PREFIX), f"ledgers are {tuple(PREFIX)}")
    other, _ = read_checkpoint(r, folder)
    save_review(r, backup)
    out = replace(r, ledgers={n: (other if n in scope else r).ledgers[n] for n in PREFIX})
    validate_ledgers(out)
    return out


# --- packages -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Snapshot:
    review: Review
    tables: dict[str, DataFrame]
    digests: dict[str, str]
    reviewer: str
    status: str
    created_utc: str
    review_id: str

    def __repr__(self) -> str:
        return f"<Snapshot {self.review_id} {self.status}, {len(self.tables)} tables>"


def each(tables: dict[str, DataFrame], work: Callable[[str, DataFrame], Any]) -> dict[str, Any]:
    """``work`` on every table, some at a time: their jobs are small and independent."""
    with ThreadPoolExecutor(6) as pool:
        return dict(zip(tables, pool.map(lambda n: work(n, tables[n]), tables), strict=True))


def digests_of(tables: dict[str, DataFrame]) -> dict[str, str]:
    return each(tables, lambda _, t: table_digest(t))


def export_tables(r: Review) -> dict[str, DataFrame]:
    """Everything a package holds: base and effective tables, thresholds, disabled rules, the four ledgers."""
    done, spark = replay(r), r.spark
    off = [tuple(x[c] for c in ("image_id", "rule_id", "label", "reason", "markers")) for x in done.disabled]
    out = {
        "cells_base": r.classification.df, "cells_effective": done.cells, "calls": r.classification.calls, "support": r.prepared.support, "prepared": r.prepared.df,
        "thresholds_base": r.thresholds.frame(spark), "thresholds_effective": done.thresholds.frame(spark),
        "disabled_rules": spark.createDataFrame(off, "image_id string, rule_id string, label string, reason string, markers string"),
    }
    if r.scores is not None:
        out["scores"] = r.scores
    if r.states:
        out |= {"states_base": r.states.df, "states_effective": done.states, "state_thresholds": r.states.thresholds()}
    if r.structures:
        out |= {"structures": r.structures.table, "cell_structures": r.structures.cells}
    return out | {f"ledger_{n}": r.frame(n) for n in PREFIX}


def identity(r: Review, digests: dict[str, str], reviewer: str, status: str) -> str:
    return "ct-" + sha256({"config": r.config.digest(), "ledgers": r.ledger_digest(), "tables": digests, "reviewer": reviewer, "status": status})[:16]


def lock(r: Review, reviewer: str, status: str = "PENDING") -> Snapshot:
    """Validates, replays, and binds the digests of all tables into an id."""
    check_text(reviewer, "reviewer", 200)
    require(status in STATUSES, f"statuses are {STATUSES}")
    validate_ledgers(r)
    validate_keys(r)
    # locked as they are now: stored once, then hashed, written and compared from there
    tables = each(export_tables(r), lambda n, t: stored(t, f"locked-{n}"))
    digests = digests_of(tables)
    return Snapshot(r, tables, digests, reviewer, status, now_utc(), identity(r, digests, reviewer, status))


def export(s: Snapshot, folder: str, overwrite: bool = False) -> str:
    """Writes the package, verifies it in its staging folder, and publishes it. A snapshot whose content no longer gives
    its id is refused: what was written of its tables is hashed, so they are not read once more for that."""
    require(identity(s.review, s.digests, s.reviewer, s.status) == s.review_id, CHANGED, IntegrityError)
    with published(folder, overwrite) as staged:
        each(s.tables, lambda name, table: table.write.parquet(f"{staged}/{name}"))
        meta = {"review_id": s.review_id, "reviewer": s.reviewer, "status": s.status, "created_utc": s.created_utc, "digests": s.digests, "columns": {n: t.dtypes for n, t in s.tables.items()}, "ledgers": {n: list(rows) for n, rows in s.review.ledgers.items()}}
        (staged / "package.json").write_text(canonical(meta) + "\n")
        (staged / "config.json").write_text(canonical(s.review.config.to_dict()) + "\n")
        failed = [c for c in _content_checks(s.review.spark, staged, s.review) if not c["ok"]]
        require("tables" not in {c["check"] for c in failed}, CHANGED, IntegrityError)
        require(not failed, "; ".join(f"{c['check']}: {c['details']}" for c in failed), IntegrityError)
    return s.review_id


def read_export(spark: SparkSession, folder: str, verify: bool = True, expected_id: str | None = None) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    if verify:
        verify_manifest(folder)
    root = Folder(folder)
    meta = json.loads((root / "package.json").read_text())
    require(expected_id is None or meta["review_id"] == expected_id, "the package has another id", IntegrityError)
    schema = lambda n: ", ".join(f"`{c}` {k}" for c, k in meta["columns"][n])
    return {n: spark.read.schema(schema(n)).parquet(f"{root}/{n}") for n in meta["digests"]}, meta


def restore_review(spark: SparkSession, folder: str, verify: bool = True, expected_id: str | None = None) -> Review:
    """The review that a package was made of, from its tables alone: prepared cells, base cuts, scores, states, structures
    and ledgers. Labels are worked out anew from them and must be the package's."""
    tables, meta = read_export(spark, folder, verify, expected_id)
    return _restored(tables, meta, Config.from_dict(json.loads((Folder(folder) / "config.json").read_text())))


def _restored(tables: dict[str, DataFrame], meta: dict[str, Any], config: Config) -> Review:
    prepared = Prepared(tables["prepared"], config, tables["support"], fingerprint(tables["prepared"]))
    scores = tables.get("scores")
    rows = lambda name: tuple(r.asDict() for r in tables[name].collect())
    cuts = Thresholds(rows("thresholds_base"), {}, config.digest(), score_digest(prepared, scores))
    labels = classify(prepared, cuts, scores, quiet=True)
    require(table_digest(labels.df) == meta["digests"]["cells_base"], "the package's labels do not follow from its cuts", IntegrityError)
    called = StateCalls(tables["states_base"], rows("state_thresholds"), config, scores) if "states_base" in tables else None
    found = Structures(tables["structures"], tables["cell_structures"], {}) if "structures" in tables else None
    out = replace(review(prepared, cuts, labels, called, found, scores), ledgers=_ledgers_of(meta["ledgers"]))
    validate_ledgers(out)
    validate_keys(out)
    return out


def _content_checks(spark: SparkSession, folder: Folder, base: Review | None) -> list[dict[str, Any]]:
    tables, meta = read_export(spark, str(folder), verify=False)
    config = Config.from_dict(json.loads((folder / "config.json").read_text()))
    row = lambda name, wrong: {"check": name, "ok": not wrong, "details": ", ".join(wrong)}
    digests = digests_of(tables)
    ledgers = _ledgers_of(meta["ledgers"])
    stub = sha256({"config": config.digest(), "ledgers": sha256(canonical({n: list(rows) for n, rows in ledgers.items()})), "tables": digests, "reviewer": meta["reviewer"], "status": meta["status"]})
    out = [
        row("tables", [n for n, d in digests.items() if d != meta["digests"][n]]),
        row("identity", [] if meta["review_id"] == f"ct-{stub[:16]}" else [meta["review_id"]]),
        row("status", [] if meta["status"] in STATUSES else [meta["status"]]),
        row("ledgers", [n for n in PREFIX if tables[f"ledger_{n}"].count() != len(ledgers[n])]),
        row("deleted_not_analysed", [] if tables["cells_effective"].where("disposition_effective <> 'NONE' and analysed").isEmpty() else ["cells_effective"]),
    ]
    if all(c["ok"] for c in out):
        # without the base review the package's own tables are replayed
        try:
            again = replay(replace(base, ledgers=ledgers) if base is not None else _restored(tables, meta, config))
        except IntegrityError as e:
            return [*out, row("replay", [str(e)])]
        pairs = {"cells_effective": again.cells, "thresholds_effective": again.thresholds.frame(spark)} | ({"states_effective": again.states} if again.states is not None else {})
        out.append(row("replay", [n for n, t in pairs.items() if table_digest(t) != digests.get(n)]))
    return out


def verify_export(spark: SparkSession, folder: str, base: Review | None = None, expected_id: str | None = None) -> list[dict[str, Any]]:
    """Check rows of a package: files against the manifest, tables against their digests and the id, and the effective
    tables against a new replay of the base review, or of the review restored from the package."""
    checks = check_manifest(folder)
    if all(c["ok"] for c in checks):
        checks += _content_checks(spark, Folder(folder), base)
        if expected_id is not None:
            meta = json.loads((Folder(folder) / "package.json").read_text())
            checks.append({"check": "expected_id", "ok": meta["review_id"] == expected_id, "details": meta["review_id"]})
    return checks


def archive(folder: str, file: str) -> str:
    """A gzipped tar of a package."""
    verify_manifest(folder)
    with tarfile.open(file, "w:gz") as tar:
        tar.add(folder, arcname=Path(folder).name)
    return file


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, repeats counted, with the side they are on."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


__all__ = ["Snapshot", "acquire", "archive", "columns", "differences", "export", "load_review", "lock", "read_export", "replace_ledgers", "restore_review", "save_review", "verify_export"]
