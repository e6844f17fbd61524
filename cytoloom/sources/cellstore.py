"""Cell tables on disk: a table (Parquet by image, or TSV), a sidecar with its schema, a manifest."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..errors import StructureError, require
from ..functions.canonical import canonical
from ..operators.prepare import CellTable, cell_table, validate_cells
from .folders import Folder
from .manifest import published, verify_manifest
from .tsv import read_tsv, write_tsv

FORMATS, VERSION = ("parquet", "tsv", "tsv.gz"), "1.0.0"


def write_cells(cells: CellTable, folder: str, overwrite: bool = False, form: str = "parquet") -> None:
    require(form in FORMATS, f"formats are {FORMATS}")
    failed = [c for c in validate_cells(cells) if not c["ok"]]
    require(not failed, "; ".join(f"{c['check']}: {c['details']}" for c in failed), StructureError)
    with published(folder, overwrite) as staged:
        if form == "parquet":
            # one folder for each image, so that an image filter reads only its files
            cells.df.write.partitionBy("image_id").parquet(f"{staged}/cells")
        else:
            write_tsv(cells.df, f"{staged}/cells", form.endswith("gz"))
        side = {"version": VERSION, "format": form, "features": sorted(cells.features.values()), "types": dict(cells.df.dtypes), "provenance": cells.provenance}
        (staged / "cells.json").write_text(canonical(side) + "\n")
        if cells.images is not None:
            cells.images.write.parquet(f"{staged}/images")


def read_cells(spark: SparkSession, folder: str, verify: bool = True) -> CellTable:
    if verify:
        verify_manifest(folder)
    root = Folder(folder)
    side = json.loads((root / "cells.json").read_text())
    require(side["version"].split(".")[0] == VERSION.split(".")[0], "unknown version", StructureError)
    types = side["types"]
    if side["format"] == "parquet":
        schema = ", ".join(f"`{n}` {k}" for n, k in types.items())
        df = spark.read.schema(schema).parquet(f"{root}/cells").select(*(f"`{n}`" for n in types))
    else:
        df = read_tsv(spark, f"{root}/cells", types, check=verify)
    images = spark.read.parquet(f"{root}/images") if (root / "images").exists() else None
    found = cell_table(df, images, side["features"])
    return CellTable(found.df, found.features, images, side["provenance"])
