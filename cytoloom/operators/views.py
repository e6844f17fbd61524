"""The tables behind the plots; drawing is left to whoever wants it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import require
from ..functions.columns import col
from .classify import Classification
from .embed import Embedding
from .prepare import KEYS, Prepared, available, with_support
from .review import Review, replay
from .snapshot import Snapshot
from .thresholds import Thresholds, density_table, evidence_frame


def density_view(prepared: Prepared, cuts: Thresholds, marker: str, image: str, n: int = 256) -> DataFrame:
    """(pool, k, x, density, cut): curves of all cells and of the pools on both sides of the cut."""
    cut = cuts.cut(image, marker)
    base = prepared.df.where(F.col("image_id") == image).select(col(f"score_{marker}").alias("v")).where("v is not null")
    pooled = base.withColumn("pool", F.lit("pooled"))
    if cut is not None:
        pooled = pooled.unionByName(base.withColumn("pool", F.when(F.col("v") > cut, "positive").otherwise("negative")))
    return density_table(pooled, "pool", "v", n).withColumn("cut", F.lit(cut).cast("double"))


def embedding_view(embedding: Embedding, cells: DataFrame, colour: str = "cell_type") -> DataFrame:
    return embedding.df.select(*KEYS, "u1", "u2", "population").join(cells.select(*KEYS, F.col(colour).alias("colour")), KEYS)


def map_view(cells: DataFrame, image: str, label: str = "cell_type", structures: DataFrame | None = None) -> DataFrame:
    """keys, x, y, label of one image, and the structure where given."""
    out = cells.where(F.col("image_id") == image).select(*KEYS, "x", "y", F.col(label).alias("label"))
    return out.join(structures.select(*KEYS, "structure_id"), KEYS, "left") if structures is not None else out


def dotplot(prepared: Prepared, cells: DataFrame | Classification, markers: list[str] | None = None) -> DataFrame:
    """(image_id, marker, cell_type, mean_score, n_observed): one aggregation, every group kept, mean NULL where nothing
    was observed. A classification of the prepared scores brings its labels along; a table of labels is joined by key."""
    markers = markers or prepared.config.gated
    if isinstance(cells, Classification):
        joined = cells.full if cells.scores is None else with_support(prepared).join(cells.df.select(*KEYS, "cell_type"), KEYS)
    else:
        joined = with_support(prepared).join(cells.select(*KEYS, "cell_type"), KEYS)
    seen = {m: F.when(available(m), col(f"score_{m}")) for m in markers}
    wide = joined.groupBy("image_id", "cell_type").agg(*(F.struct(F.avg(c).alias("mean_score"), F.count(c).alias("n_observed")).alias(f"s_{m}") for m, c in seen.items()))
    rows = F.array(*(F.struct(F.lit(m).alias("marker"), col(f"s_{m}").getField("mean_score").alias("mean_score"), col(f"s_{m}").getField("n_observed").alias("n_observed")) for m in markers))
    return wide.select("image_id", "cell_type", F.inline(rows)).select("image_id", "marker", "cell_type", "mean_score", "n_observed")


def thresholds_view(spark, cuts: Thresholds, image: str | None = None) -> DataFrame:
    out = cuts.frame(spark).select("image_id", "marker", "estimate", "status")
    return out.where(F.col("image_id") == image) if image else out


def state_histogram(states: DataFrame, bins: int = 40, image: str | None = None) -> DataFrame:
    """(marker, parent, positive, bin, n) of the scores in equal bins over each marker's range; 1 is the lowest bin."""
    base = (states.where(F.col("image_id") == image) if image else states).where("score is not null")
    ranges = base.groupBy("marker").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins), F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int") + 1)).otherwise(1)
    return base.join(F.broadcast(ranges), "marker").groupBy("marker", "parent", "positive", place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def overview(cells: DataFrame, image: str, structures: DataFrame | None = None) -> dict[str, DataFrame]:
    """Maps by label and, where present, by disposition."""
    out = {"cell_type": map_view(cells, image, "cell_type", structures)}
    if "disposition_effective" in cells.columns:
        out["disposition"] = map_view(cells, image, "disposition_effective")
    require(out, "nothing to show")
    return out


def first_map(x: Review | Snapshot | dict[str, DataFrame]) -> DataFrame:
    """The effective labels of the first image of a review, a snapshot or an export's tables."""
    cells = replay(x).cells if isinstance(x, Review) else (x.tables if isinstance(x, Snapshot) else x)["cells_effective"]
    image = cells.agg(F.min("image_id")).first()[0]
    require(image is not None, "there are no cells")
    return map_view(cells, image)


def ledger_view(frame: DataFrame, limit: int = 1000) -> DataFrame:
    """The newest entries of a ledger, for display."""
    return frame.orderBy(F.desc("order")).limit(limit)


__all__ = ["density_view", "dotplot", "embedding_view", "evidence_frame", "first_map", "ledger_view", "map_view", "overview", "state_histogram", "thresholds_view"]
