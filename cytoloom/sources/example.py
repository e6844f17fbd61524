"""An example configuration for the simulated slide."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..plans.config import Config, Flag, Hierarchy, Localization, Marker, Refinement, Rule, signal_policy
from .cellstore import write_cells
from .folders import Folder
from .simulate import simulate

DECISIONS = {"Tumor": "Tumour", "Benign": "Benign epithelium", "Unresolved": "Epithelium, unresolved"}


def example_config() -> Config:
    """Five identity markers, one state marker with a nuclear localization rule, a conflict flag and a review rule."""
    gated = [Marker(m, transform="asinh", cofactor=5.0) for m in ("PanCK", "CD45", "CD3", "CD20", "CD68")]
    ki67 = Marker("Ki67", role="state", transform="asinh", cofactor=5.0, method="parent_crossing", parents=("epithelium",), localization=Localization("nucleus", "cytoplasm", 1.0))
    rules = (
        Rule(rule_id="epithelium", label="Epithelium", all_of=("PanCK",), none_of=("CD45",), review=True, pending_label="Epithelium, pending", decisions=DECISIONS),
        Rule(rule_id="t_cell", label="T cell", all_of=("CD45", "CD3"), none_of=("CD20",)),
        Rule(rule_id="b_cell", label="B cell", all_of=("CD45", "CD20"), none_of=("CD3",)),
        Rule(rule_id="macrophage", label="Macrophage", all_of=("CD45", "CD68")),
        Rule(rule_id="leukocyte", label="Leukocyte", all_of=("CD45",)),
    )
    return Config(
        signal_policy([m.marker for m in gated] + ["Ki67", "DAPI"]),
        (*gated, ki67, Marker("DAPI", role="context")),
        {"epithelium": ("Epithelium, pending", *DECISIONS.values())},
        Hierarchy(rules, {"conflict": Flag(all_of=("PanCK", "CD45"))}, {"conflict": "unresolved"}),
        refinements=(Refinement("proliferating", "Ki67", "epithelium", "Tumour", "Tumour, proliferating"),),
    ).checked()


def example_path(spark: SparkSession, folder: str, n: int = 8000) -> str:
    """The path of a cell store with a simulated slide for ``example_config``, written if it isn't there."""
    if not Folder(folder).exists():
        write_cells(simulate(spark, n), folder)
    return folder
