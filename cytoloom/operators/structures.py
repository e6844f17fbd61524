"""Spatial structures: density clusters (DBSCAN) of pending cells on each image.

Cells are dealt into squares of eps / sqrt(2), whose members are all within eps of each other. A square with min_pts
members is dense: they are core as a whole, of one cluster, and never paired among themselves. Everyone else has less
than min_pts fellows in the square, so the pairs that are looked at grow with the cells, however dense a spot is, also where
many coincide. Clusters are components of squares with core cells. Two dense squares are connected by chosen members
(one for each part of a grid of PARTS x PARTS) where these show it, and by all members of the parts that could be near enough where
not. Components are found by alternating star steps on checkpointed tables; nothing of an image is gathered in one task.
A border cell joins the cluster whose first core cell, in the order of x, y and key, comes first, as a scan in that order
assigns it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import require
from ..functions.columns import finite
from ..storage import small, stored
from .components import checkpoint_ready, connected

KEYS, SQUARE, PARTS = ["image_id", "cell_id"], ["image_id", "bx", "by"], 8


@dataclass(frozen=True)
class Structures:
    """table: a row for each structure; cells: keys and structure_id (NULL: none); eps: by image."""

    table: DataFrame
    cells: DataFrame
    eps: dict[str, float]

    def __repr__(self) -> str:
        return f"<Structures on {len(self.eps)} images>"


def in_squares(points: DataFrame) -> DataFrame:
    """``points`` with the square (bx, by) of each. With eps = 0 a square is a place."""
    # a little less than eps / sqrt(2), so that rounding puts no two members further apart
    width = F.col("eps") * F.lit(math.sqrt(0.5) * (1 - 1e-9))
    place = lambda c: F.when(F.col("eps") > 0, F.floor(F.col(c) / width)).otherwise(F.xxhash64(F.col(c) + F.lit(0.0)))
    return points.withColumn("bx", place("x")).withColumn("by", place("y"))


def around(rows: DataFrame) -> DataFrame:
    """``rows`` (bx, by, eps, ...) sent to all squares that may hold neighbours: two steps each way; with eps = 0 their own."""
    steps = F.when(F.col("eps") > 0, F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if abs(i * j) < 4))).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))
    sent = rows.withColumn("_step", F.explode(steps))
    return sent.withColumn("bx", F.col("bx") + F.col("_step.i")).withColumn("by", F.col("by") + F.col("_step.j")).drop("_step")


def square_distance(ax: str, ay: str, bx: str, by: str) -> Column:
    return (F.col(ax) - F.col(bx)) * (F.col(ax) - F.col(bx)) + (F.col(ay) - F.col(by)) * (F.col(ay) - F.col(by))


def neighbour_pairs(some: DataFrame, points: DataFrame) -> DataFrame:
    """(image_id, a, b, d2) of ``some`` and all ``points`` (both with squares) within eps, themselves included."""
    a = around(some).select(*SQUARE, F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "eps")
    b = points.select(*SQUARE, F.col("id").alias("b"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    d2 = square_distance("ax", "ay", "cx", "cy")
    return a.join(b, SQUARE).withColumn("d2", d2).where(F.col("d2") <= F.col("eps") * F.col("eps")).select("image_id", "a", "b", "d2")


def neighbour_counts(points: DataFrame) -> DataFrame:
    """(image_id, id, n): points (image_id, id, x, y, eps) within eps, itself included."""
    placed = in_squares(points)
    return neighbour_pairs(placed, placed).groupBy("image_id", F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def core_points(points: DataFrame, min_pts: int) -> DataFrame:
    """The points with at least min_pts within eps, themselves included, with their squares and dense (whether the
    square is)."""
    placed = in_squares(points)
    sizes = placed.groupBy(*SQUARE).agg((F.count(F.lit(1)) >= min_pts).alias("dense"))
    placed = placed.join(sizes, SQUARE)
    thin = placed.where(~F.col("dense"))
    enough = neighbour_pairs(thin, placed).groupBy("image_id", F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pts).select("image_id", "id")
    return placed.where("dense").unionByName(thin.join(enough, ["image_id", "id"], "left_semi"))


def kth_distances(some: DataFrame, points: DataFrame, k: DataFrame) -> DataFrame:
    """(image_id, id, d): the distance of each of ``some`` to its k-th neighbour (``k``: image_id, k), where it is within eps."""
    pairs = neighbour_pairs(in_squares(some), in_squares(points)).where("a <> b")
    ranked = pairs.selectExpr("image_id", "a as id", "sqrt(d2) as d", "row_number() over (partition by image_id, a order by d2) as place")
    return ranked.join(k, "image_id").where("place = k").select("image_id", "id", "d")


def eps_by_image(points: DataFrame, eps_min: float, eps_max: float, min_pts: int) -> dict[str, float]:
    """The 95 % quantile of distances to the k-th neighbour (k = min_pts - 1, at most n - 1), between the bounds.

    How many distances lie within a radius is counted by squares, without pairs of dense spots. Radii are halved from
    eps_max down, and doubled beyond it, until the two order statistics around the quantile lie between two of them; only cells
    whose distance lies there are measured. Images whose quantile is beyond a bound are settled by counts alone.
    """
    sizes = {r.image_id: r.n for r in points.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = {i: float(eps_max) for i, n in sizes.items() if n < 2}
    spark = points.sparkSession
    points = points.select("image_id", "id", "x", "y")
    # images by k: fewer cells than min_pts make it smaller
    open_images = {i: n for i, n in sizes.items() if n > 1}
    k_of = {i: min(max(1, min_pts - 1), n - 1) for i, n in open_images.items()}
    k_table = lambda images: small(spark.createDataFrame([(i, k_of[i]) for i in images], "image_id string, k int"), len(images))

    def within(images: list[str], radius: float) -> dict[str, DataFrame]:
        """By k, the cells of the images whose k-th neighbour is within the radius."""
        found = {}
        for k in sorted({k_of[i] for i in images}):
            names = [i for i in images if k_of[i] == k]
            chosen = points.join(small(spark.createDataFrame([(i,) for i in names], "image_id string"), len(names)), "image_id", "left_semi")
            found[k] = core_points(chosen.withColumn("eps", F.lit(float(radius))), k + 1).select("image_id", "id", "x", "y")
        return found

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def counts(cells: DataFrame) -> dict[str, int]:
        return {r.image_id: r.n for r in cells.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).collect()}

    place = {i: 0.95 * (n - 1) for i, n in open_images.items()}
    low = {i: math.floor(v) for i, v in place.items()}
    if open_images:
        near = stored(union(list(within(list(open_images), eps_min).values())), "near")
        n_near = counts(near)
        for i in list(open_images):
            if n_near.get(i, 0) >= min(low[i] + 2, open_images[i]):
                out[i] = float(eps_min)
                del open_images[i]
    values: dict[tuple[str, int], float] = {}  # (image, rank) -> distance
    if open_images:
        upper, radius = stored(union(list(within(list(open_images), eps_max).values())), "within"), float(eps_max)
        n_upper = counts(upper)
        outside = {i: n_upper.get(i, 0) for i in open_images}
        for i in list(open_images):
            if n_upper.get(i, 0) <= low[i]:
                out[i] = float(eps_max)
                del open_images[i]
    # ranks within eps_max, from the outer rings inwards
    waiting = {(i, r) for i in open_images for r in (low[i], low[i] + 1) if r < min(outside[i], open_images[i])} if open_images else set()
    while waiting:
        images = sorted({i for i, _ in waiting})
        # coincident cells have distance 0; below the smallest positive number there is nothing else
        inner_radius = radius / 2 if radius > 1e-300 else 0.0
        inner = stored(union(list(within(images, inner_radius).values())), "within")
        n_inner = counts(inner)
        here = {(i, r) for i, r in waiting if r >= n_inner.get(i, 0)} if radius > 0 else waiting
        if here:
            names = sorted({i for i, _ in here})
            if radius > 0:
                ring = upper.join(small(spark.createDataFrame([(i,) for i in names], "image_id string"), len(names)), "image_id", "left_semi").join(inner, ["image_id", "id"], "left_anti").withColumn("eps", F.lit(radius))
                measured = stored(kth_distances(ring, points.withColumn("eps", F.lit(radius)), k_table(names)), "measured")
                ranks = spark.createDataFrame([(i, r - n_inner.get(i, 0), r) for i, r in here], "image_id string, at long, rank long")
                for row in _at_ranks(measured, ranks).collect():
                    values[row.image_id, row.rank] = row.d
            else:
                values |= dict.fromkeys(here, 0.0)
        waiting -= here
        upper, radius = inner, inner_radius
    # the next rank beyond eps_max counts where the quantile lies between two
    beyond = {i for i, n in open_images.items() if low[i] + 1 < n and outside[i] == low[i] + 1 and place[i] > low[i]}
    radius = float(eps_max)
    while beyond:
        names = sorted(beyond)
        chosen = points.join(small(spark.createDataFrame([(i,) for i in names], "image_id string"), len(names)), "image_id", "left_semi")
        far = chosen.join(union(list(within(names, eps_max).values())), ["image_id", "id"], "left_anti")
        radius *= 2
        measured = kth_distances(far.withColumn("eps", F.lit(radius)), chosen.withColumn("eps", F.lit(radius)), k_table(names))
        for row in measured.groupBy("image_id").agg(F.min("d").alias("d")).collect():
            values[row.image_id, low[row.image_id] + 1] = row.d
            beyond.discard(row.image_id)
        for i in list(beyond):  # beyond this radius the quantile is beyond eps_max whatever the distance
            a = values[i, low[i]]
            if a + (place[i] - low[i]) * (radius - a) >= eps_max:
                values[i, low[i] + 1] = radius
                beyond.discard(i)
    for i in open_images:
        a = values[i, low[i]]
        b = values.get((i, low[i] + 1), a)
        out[i] = min(float(eps_max), max(float(eps_min), a + (place[i] - low[i]) * (b - a)))
    return out


def _at_ranks(measured: DataFrame, ranks: DataFrame) -> DataFrame:
    """(image_id, rank, d): of each image the distance at position ``at``. Distances are counted by value; a running sum
    over ranges of values and one within the ranges that hold a wanted position keep an image out of one task."""
    counted = measured.groupBy("image_id", "d").agg(F.count(F.lit(1)).alias("n"))
    spans = counted.groupBy("image_id").agg(F.min("d").alias("d0"), F.max("d").alias("d1"))
    parts = counted.join(spans, "image_id").withColumn("part", F.when(F.col("d1") > F.col("d0"), F.floor((F.col("d") - F.col("d0")) / (F.col("d1") - F.col("d0")) * 1024)).otherwise(0))
    sums = parts.groupBy("image_id", "part").agg(F.sum("n").alias("m")).selectExpr("*", "sum(m) over (partition by image_id order by part) as upto")
    wanted = sums.join(ranks, "image_id").where("upto > at and upto - m <= at").selectExpr("image_id", "part", "rank", "at - (upto - m) as at")
    inside = parts.selectExpr("image_id", "part", "d", "sum(n) over (partition by image_id, part order by d) as upto")
    return inside.join(wanted, ["image_id", "part"]).where("upto > at").groupBy("image_id", "rank").agg(F.min("d").alias("d"))


def structure_stats(labelled: DataFrame) -> DataFrame:
    """(image_id, cluster, structure_id, n_cells, centroid_x, centroid_y, box) of (image_id, cluster, x, y); ids follow
    falling size, then the centre."""
    stats = labelled.groupBy("image_id", "cluster").agg(F.count(F.lit(1)).alias("n_cells"), F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"), F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))
    ranked = stats.selectExpr("*", "row_number() over (partition by image_id order by n_cells desc, centroid_x, centroid_y, cluster) as _k")
    return ranked.select("image_id", "cluster", F.format_string("E%02d", "_k").alias("structure_id"), "n_cells", "centroid_x", "centroid_y", "xmin", "xmax", "ymin", "ymax")


def square_links(core: DataFrame) -> DataFrame:
    """(a, b), a < b: squares (by the smallest ord of their core points, ``node``) that hold core points within eps of each
    other. ``core`` has squares, dense, node and ord."""
    thin = core.where(~F.col("dense"))
    near = F.col("d2") <= F.col("eps") * F.col("eps")
    d2 = square_distance("ax", "ay", "x", "y")
    mine = lambda df: around(df).select(*SQUARE, F.col("node").alias("other"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    ordered = lambda df: df.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).where("a < b").distinct()
    # less than min_pts members of a thin square meet the members of the squares around
    direct = ordered(mine(thin).join(core, SQUARE).where("node <> other").withColumn("d2", d2).where(near))
    # dense squares: one member for each part first
    width = F.col("eps") * F.lit(math.sqrt(0.5) * (1 - 1e-9) / PARTS)
    part = lambda c, b: F.when(F.col("eps") > 0, F.greatest(F.lit(0), F.least(F.lit(PARTS - 1), F.floor((F.col(c) - F.col(b) * width * PARTS) / width)))).otherwise(0)
    dense = core.where("dense").withColumn("px", part("x", "bx")).withColumn("py", part("y", "by"))
    parts = dense.groupBy(*SQUARE, "node", "eps", "px", "py").agg(F.min(F.struct("ord", "x", "y")).alias("one")).select(*SQUARE, "node", "eps", "px", "py", "one.x", "one.y")
    sent = around(parts).select(*SQUARE, F.col("node").alias("other"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    met = parts.join(sent, SQUARE).where("node < other").withColumn("d2", d2)
    chosen = met.groupBy("node", "other").agg(F.max(near).alias("linked"))
    open_pairs = chosen.where("not linked").select("node", "other")
    linked = chosen.where("linked").selectExpr("node as a", "other as b")
    # the rest: parts whose edges are near enough, with all their members
    gap = lambda c, p, b, oc, op, ob: F.greatest(F.lit(0.0), F.abs((F.col(b) * PARTS + F.col(p)) - (F.col(ob) * PARTS + F.col(op))) - 1) * width
    boxes = parts.select("image_id", "node", "eps", "bx", "by", "px", "py")
    other = boxes.select("image_id", F.col("node").alias("other"), F.col("bx").alias("obx"), F.col("by").alias("oby"), F.col("px").alias("opx"), F.col("py").alias("opy"))
    close = boxes.join(open_pairs, "node").join(other, ["image_id", "other"])
    reach = gap("x", "px", "bx", "x", "opx", "obx") * gap("x", "px", "bx", "x", "opx", "obx") + gap("y", "py", "by", "y", "opy", "oby") * gap("y", "py", "by", "y", "opy", "oby")
    close = close.where(reach <= F.col("eps") * F.col("eps") * (1 + 1e-6)).select("node", "other", "px", "py", "opx", "opy")
    left = dense.select("node", "px", "py", "eps", F.col("x").alias("ax"), F.col("y").alias("ay"))
    right = dense.select(F.col("node").alias("other"), F.col("px").alias("opx"), F.col("py").alias("opy"), "x", "y")
    rest = close.join(left, ["node", "px", "py"]).join(right, ["other", "opx", "opy"]).withColumn("d2", d2).where(near).selectExpr("node as a", "other as b").distinct()
    return direct.unionByName(linked).unionByName(rest).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def dbscan(points: DataFrame, min_pts: int) -> DataFrame:
    """(image_id, id, cluster) of clustered points (image_id, id, x, y, eps, ord); cluster is the smallest ord of its core
    points. ``ord`` is a long that orders points and is unique over all images."""
    checkpoint_ready(points)
    core = core_points(points, min_pts)
    nodes = core.groupBy(*SQUARE).agg(F.min("ord").alias("node"))
    core = core.join(nodes, SQUARE).checkpoint()
    labels = connected(square_links(core))
    cores = core.join(labels, core.node == labels.node, "left").select(core.image_id, "id", *SQUARE[1:], "x", "y", "eps", F.coalesce("label", core.node).alias("cluster"))
    rest = in_squares(points).join(core.select("image_id", "id"), ["image_id", "id"], "left_anti")
    sent = around(rest).select(*SQUARE, F.col("id").alias("b"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    border = sent.join(cores, SQUARE).where(square_distance("ax", "ay", "x", "y") <= F.col("eps") * F.col("eps")).groupBy("image_id", F.col("b").alias("id")).agg(F.min("cluster").alias("cluster"))
    return cores.select("image_id", "id", "cluster").unionByName(border)


def structures(cells: DataFrame, eps_min: float = 15.0, eps_max: float = 30.0, min_pts: int = 10, min_cells: int = 20) -> Structures:
    """Structures of the pending cells of ``cells`` (image_id, cell_id, x, y, pending_review)."""
    require(0 <= eps_min <= eps_max and eps_max > 0 and min_pts >= 2 and min_cells >= 1, "eps_min, eps_max, min_pts or min_cells out of range")
    checkpoint_ready(cells)
    pending = cells.where("pending_review").where(finite(F.col("x")) & finite(F.col("y")))
    # a range partitioning by the order makes row numbers without one large sort task
    ordered = pending.select(*KEYS, "x", "y").repartitionByRange("image_id", "x", "y", "cell_id").sortWithinPartitions("image_id", "x", "y", "cell_id")
    points = ordered.withColumn("ord", F.monotonically_increasing_id()).withColumnRenamed("cell_id", "id").checkpoint()
    eps = eps_by_image(points, eps_min, eps_max, min_pts)
    spark = cells.sparkSession
    table = spark.createDataFrame(sorted(eps.items()), "image_id string, eps double")
    found = dbscan(points.join(small(table, len(eps)), "image_id"), min_pts).checkpoint()
    labelled = found.join(points.select("image_id", "id", "x", "y"), ["image_id", "id"])
    large = found.groupBy("image_id", "cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_cells).drop("n")
    stats = structure_stats(labelled.join(large, ["image_id", "cluster"], "left_semi")).checkpoint()
    ids = found.join(stats.select("image_id", "cluster", "structure_id"), ["image_id", "cluster"]).select("image_id", F.col("id").alias("cell_id"), "structure_id")
    out = cells.select(*KEYS).join(ids, KEYS, "left")
    return Structures(stats.drop("cluster").withColumn("decision", F.lit(None).cast("string")), out, eps | {r.image_id: eps_max for r in cells.select("image_id").distinct().collect() if r.image_id not in eps})


