"""Simulated slides with known populations. Every value is a function of seed, cell and marker, so the result does not
depend on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import require
from ..operators.prepare import CellTable, cell_table

#: Population -> markers it expresses, and its share.
POPULATIONS = {"tumour": ({"PanCK", "Ki67"}, 0.35), "t_cell": ({"CD45", "CD3"}, 0.25), "b_cell": ({"CD45", "CD20"}, 0.15), "macrophage": ({"CD45", "CD68"}, 0.15), "stroma": (set(), 0.10)}
MARKERS = ("PanCK", "CD45", "CD3", "CD20", "CD68", "Ki67", "DAPI")


def uniform(seed: int, *parts: Column | str) -> Column:
    """In (0, 1), from a hash."""
    h = F.xxhash64(F.lit(seed), *(F.lit(p) if isinstance(p, str) else p for p in parts))
    return (F.pmod(h, F.lit(1 << 53)).cast("double") + 0.5) / F.lit(float(1 << 53))


def normal(seed: int, *parts: Column | str) -> Column:
    u, v = uniform(seed, *parts, "u"), uniform(seed, *parts, "v")
    return F.sqrt(-2 * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)


def simulate(spark: SparkSession, n: int = 1000, markers: tuple[str, ...] = MARKERS, absent: tuple[str, ...] = (), shuffled: tuple[str, ...] = (), rare_fraction: float = 0.0, separation: float = 3.0, image_id: str = "sim-01", seed: int = 1, contact_fraction: float = 0.01, artefact_fraction: float = 0.06) -> CellTable:
    """n cells on a square; tumour cells lie in round nests (sim_structure). ``absent`` markers are constant, ``shuffled``
    ones unrelated to the population; ``rare_fraction`` of the cells are plasma cells, which express CD45 alone and strongly,
    ``contact_fraction`` leukocytes on the rim of a nest, whose outline takes in PanCK; in ``artefact_fraction`` of the
    tumour cells Ki67 is bright outside the nucleus."""
    require(n >= 1 and rare_fraction >= 0 and contact_fraction >= 0 and rare_fraction + contact_fraction < 1 and 0 <= artefact_fraction <= 1 and separation >= 0, "n, a fraction or separation out of range")
    id_ = F.col("id")
    u = uniform(seed, id_, "population")
    special = rare_fraction + contact_fraction
    at, population = special, F.when(u < rare_fraction, "plasma").when(u < special, "contact")
    for name, (_, share) in POPULATIONS.items():
        at += share * (1 - special)
        population = population.when(u < at, name)
    population = population.otherwise("stroma")
    side = math.sqrt(n) * 10
    nest = (F.floor(uniform(seed, id_, "nest") * 5)).cast("int")
    inside, rim = F.col("sim_population") == "tumour", F.col("sim_population") == "contact"
    angle, radius = uniform(seed, id_, "angle") * 2 * math.pi, F.when(rim, 1.0).otherwise(F.sqrt(uniform(seed, id_, "radius"))) * side / 10
    base = spark.range(n).withColumn("sim_population", population).withColumn("sim_structure", F.when(inside, F.concat(F.lit("nest-"), nest + 1)))
    place = lambda c, f: F.when(inside | rim, uniform(seed, nest.cast("string"), c) * side * 0.8 + side * 0.1 + radius * f(angle)).otherwise(uniform(seed, id_, c) * side)
    brightness = F.lit(1.0) + 0.1 * normal(seed, id_, "brightness")
    # which populations express a marker besides those that are listed
    more = {"CD45": ["plasma", "contact"], "PanCK": ["contact"]}
    smeared = inside & (uniform(seed, id_, "artefact") < artefact_fraction)
    columns = []
    for m in markers:
        on = F.col("sim_population").isin(*[p for p, (has, _) in POPULATIONS.items() if m in has] + more.get(m, [])) if m not in shuffled else uniform(seed, id_, m, "shuffled") < 0.3
        level = F.when(on, F.lit(1.0 + separation)).otherwise(F.lit(1.0)) if m != "DAPI" else F.lit(2.0)
        value = F.lit(0.0) if m in absent else F.greatest(F.lit(0.0), F.exp(level + 0.4 * normal(seed, id_, m)) * brightness)
        inner = F.when(smeared, 0.9).otherwise(1.2) if m == "Ki67" else F.lit(1.2 if m == "DAPI" else 0.8)
        columns += [value.alias(f"cell:{m}:mean"), (value * inner).alias(f"nucleus:{m}:mean"), (value * (2 - inner)).alias(f"cytoplasm:{m}:mean")]
    df = base.select(F.lit(image_id).alias("image_id"), F.format_string("c%06d", id_ + 1).alias("cell_id"), place("x", F.cos).alias("x"), place("y", F.sin).alias("y"), (50 + 10 * normal(seed, id_, "area")).alias("area"), "sim_population", "sim_structure", *columns)
    return cell_table(df, spark.createDataFrame([(image_id, image_id, 0.5)], "image_id string, sample_id string, pixel_size double"))
