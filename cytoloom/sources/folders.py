"""Folders on any file system that Spark and pyarrow share: local disks of a single machine, HDFS, object stores.

A path without a scheme means what it means to Spark: a path of the session's default file system.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

from ..errors import PathError, require
from ..session import ready

#: Files of more bytes together are hashed by a Spark job, a file a row, instead of by the driver.
DRIVER_BYTES = 64 << 20
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


def open_store(uri: str):
    """The pyarrow file system of a path or uri, and the path within it."""
    from pyarrow import fs

    if SCHEME.match(uri):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return fs.LocalFileSystem(), uri


def qualified(path: str) -> str:
    """``path`` with the scheme of the session's default file system, where that isn't the local one."""
    spark = SparkSession.getActiveSession()
    if SCHEME.match(path) or spark is None:
        return path
    default = spark._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark._jsc.hadoopConfiguration()).toString().rstrip("/")
    return str(Path(path).absolute()) if default.startswith("file:") else f"{default}/{path.lstrip('/')}"


class Folder:
    """A file or folder; ``str`` gives the path for Spark."""

    def __init__(self, path: str | Path | Folder):
        self.uri = path.uri if isinstance(path, Folder) else qualified(str(path)).rstrip("/")
        self.store, self.root = open_store(self.uri)

    def __str__(self) -> str:
        return self.uri

    def __truediv__(self, name: str) -> Folder:
        return Folder(f"{self.uri}/{name}")

    @property
    def name(self) -> str:
        return self.uri.rsplit("/", 1)[-1]

    def with_name(self, name: str) -> Folder:
        return Folder(f"{self.uri.rsplit('/', 1)[0]}/{name}")

    @property
    def local(self) -> bool:
        return type(self.store).__name__ == "LocalFileSystem"

    def _kind(self):
        return self.store.get_file_info(self.root).type.name

    def exists(self) -> bool:
        return self._kind() != "NotFound"

    def is_file(self) -> bool:
        return self._kind() == "File"

    def make(self) -> None:
        self.store.create_dir(self.root, recursive=True)

    def write_text(self, text: str) -> None:
        with self.store.open_output_stream(self.root, compression=None) as f:
            f.write(text.encode())

    def read_text(self) -> str:
        with self.store.open_input_stream(self.root, compression=None) as f:
            return f.read().decode()

    def move(self, to: Folder) -> None:
        self.store.move(self.root, to.root)

    def remove(self) -> None:
        kind = self._kind()
        if kind == "Directory":
            self.store.delete_dir(self.root)
        elif kind != "NotFound":
            self.store.delete_file(self.root)

    def files(self) -> dict[str, int]:
        """Sizes of all files by relative path; links are errors."""
        from pyarrow import fs

        if self.local:
            for path in Path(self.root).rglob("*"):
                require(not path.is_symlink(), f"{path} is a link", PathError)
        if not self.exists():
            return {}
        found = self.store.get_file_info(fs.FileSelector(self.root, recursive=True))
        start = len(self.root.rstrip("/")) + 1
        return {i.path[start:]: i.size for i in found if i.is_file}


def _digest(uri: str) -> str:
    store, path = open_store(uri)
    digest = hashlib.sha256()
    with store.open_input_stream(path, compression=None) as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def digests(folder: Folder, sizes: dict[str, int]) -> dict[str, str]:
    """SHA-256 of files by relative path; many or large ones by the executors."""
    spark = SparkSession.getActiveSession()
    if spark is None or sum(sizes.values()) <= DRIVER_BYTES:
        return {name: _digest(f"{folder}/{name}") for name in sizes}
    ready(spark)
    base = str(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([_digest(f"{base}/{n}") for n in names])], names=["name", "digest"])

    rows = spark.createDataFrame([(n,) for n in sizes], "name string").repartition(min(len(sizes), 1000))
    return {r.name: r.digest for r in rows.mapInArrow(run, "name string, digest string").collect()}
