"""Folders that are published whole: staged, listed in a manifest of SHA-256 digests, renamed into place.

Folders may lie on any store that the driver and the executors share (``folders``); tables in them are written by Spark,
and large ones are hashed by it. Locks are for folders of one machine.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from ..errors import IntegrityError, LockError, PathError, require
from .folders import Folder, digests

MANIFEST, DONE = "MANIFEST.sha256", "DONE"


def listed_files(folder: Folder) -> dict[str, int]:
    """Sizes of all files but the manifest, its mark, and checksum files of the writers, by relative path."""
    return {n: size for n, size in sorted(folder.files().items()) if n not in (MANIFEST, DONE) and not n.endswith(".crc")}


def safe(name: str) -> bool:
    return bool(name) and not name.startswith("/") and "\\" not in name and all(p not in ("", ".", "..") for p in name.split("/"))


def write_manifest(folder: Folder) -> str:
    found = digests(folder, listed_files(folder))
    text = "".join(f"{found[n]}  {n}\n" for n in sorted(found))
    (folder / MANIFEST).write_text(text)
    digest = hashlib.sha256(text.encode()).hexdigest()
    (folder / DONE).write_text(digest + "\n")
    return digest


def check_manifest(folder: str | Path | Folder) -> list[dict[str, Any]]:
    """Check rows (check, ok, details): manifest present, sealed, safe paths, nothing missing, changed or added."""
    folder = Folder(folder)
    manifest, done = folder / MANIFEST, folder / DONE
    if not manifest.is_file() or not done.is_file():
        return [{"check": "manifest", "ok": False, "details": "manifest or its mark is missing"}]
    text = manifest.read_text()
    rows = [line.split("  ", 1) for line in text.splitlines()]
    row = lambda name, wrong: {"check": name, "ok": not wrong, "details": ", ".join(sorted(wrong)[:5])}
    malformed = [r[0] for r in rows if len(r) != 2 or len(r[0]) != 64]
    named = {r[1]: r[0] for r in rows if len(r) == 2}
    unsafe = [n for n in named if not safe(n)]
    out = [row("manifest", malformed), row("sealed", [] if done.read_text().strip() == hashlib.sha256(text.encode()).hexdigest() else [DONE]), row("paths", unsafe), row("unique", [n for n, k in Counter(r[-1] for r in rows).items() if k > 1])]
    if unsafe or malformed:
        return out
    try:
        there = listed_files(folder)
    except PathError as e:
        return [*out, row("links", [str(e)])]
    out += [row("missing", set(named) - set(there)), row("added", set(there) - set(named))]
    found = digests(folder, {n: size for n, size in there.items() if n in named})
    return [*out, row("content", [n for n, digest in found.items() if digest != named[n]])]


def verify_manifest(folder: str | Path | Folder) -> None:
    failed = [c for c in check_manifest(folder) if not c["ok"]]
    require(not failed, "; ".join(f"{c['check']}: {c['details']}" for c in failed), IntegrityError)


@contextlib.contextmanager
def published(folder: str | Path, overwrite: bool = False) -> Iterator[Folder]:
    """A staging folder beside ``folder``; on success it gets a manifest and takes its place, on failure it goes. A folder
    that is replaced comes back if the rename fails."""
    target = Folder(folder)
    require(target.root.strip("/") != "", "the root can't be written", PathError)
    require(overwrite or not target.exists(), f"{target} exists", PathError)
    staged = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    staged.make()
    try:
        yield staged
        write_manifest(staged)
        old = target.with_name(f".{target.name}.old.{uuid.uuid4().hex}")
        if target.exists():
            target.move(old)
        try:
            staged.move(target)
        except OSError:
            if old.exists():
                old.move(target)
            raise
        old.remove()
    finally:
        staged.remove()


@contextlib.contextmanager
def locked(folder: str | Path) -> Iterator[None]:
    """An advisory lock on a file beside ``folder``; does not wait."""
    import fcntl

    target = Path(folder).absolute()
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.with_name(f".{target.name}.lock").open("w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise LockError(f"another process works on {target}") from e
        yield
