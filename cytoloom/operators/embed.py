"""Embedding and populations: principal components, a two-dimensional density on a grid, basins, and labels.

The layout is UMAP's (``layout``) unless the first two components or another function from component table to (u1, u2) are
asked for. Covariances, ranges and grid counts are aggregations; besides landmarks only the grid (at most grid x grid numbers) is
worked on by the driver. Cells are smoothed as grid counts with linear weights, so the density costs grid cells, not cells.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InputError, require
from ..functions.columns import col
from ..storage import stored
from .correct import principal
from .layout import umap
from .order import whole_quantiles
from .prepare import KEYS, Prepared, available, score_digest, with_support


@dataclass(frozen=True)
class Embedding:
    """df: keys, pc1.., u1, u2, raw_population, population. Grid arrays live on the driver."""

    df: DataFrame
    markers: tuple[str, ...]
    loadings: np.ndarray
    grid_x: np.ndarray
    grid_y: np.ndarray
    density: np.ndarray
    basins: np.ndarray
    kept: tuple[int, ...]
    score_digest: str = ""

    def __repr__(self) -> str:
        return f"<Embedding {len(self.markers)} markers, {len(self.kept)} populations>"


def embedding_input(prepared: Prepared, scores: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """keys and x_<marker> of the usable identity markers, gaps filled with the median."""
    base = with_support(prepared if scores is None else Prepared(scores, prepared.config, prepared.support))
    names = prepared.config.gated
    seen = base.select(*KEYS, *(F.when(available(m), col(f"score_{m}")).alias(f"x_{m}") for m in names))
    seen = stored(seen, "observed")
    fill = {m: q for m, (q,) in zip(names, whole_quantiles(seen, [f"x_{m}" for m in names], [0.5]).values(), strict=True)}
    usable = [m for m in names if fill[m] is not None]
    require(usable, "no identity marker can be embedded", InputError)
    return seen.select(*KEYS, *(F.coalesce(col(f"x_{m}"), F.lit(fill[m])).alias(f"x_{m}") for m in usable)), usable


def pca_scores(df: DataFrame, columns: list[str], n: int, keep: list[str]) -> tuple[DataFrame, np.ndarray]:
    """keep, pc1..pcn: centred projections on the first components (largest loading positive), and the loadings."""
    _, center, vectors = principal(df, columns)
    n = min(n, len(columns))
    parts = []
    for k in range(n):
        total = F.lit(0.0)
        for j, c in enumerate(columns):
            total = total + (col(c) - F.lit(center[c])) * F.lit(float(vectors[j, k]))
        parts.append(total.alias(f"pc{k + 1}"))
    return df.select(*keep, *parts), vectors[:, :n]


def normal_reference(sd: float, q1: float, q3: float, n: int) -> float:
    """4 * 1.06 * min(sd, IQR / 1.34) * n ** -0.2."""
    return 4 * 1.06 * min(sd, (q3 - q1) / 1.34) * n**-0.2


def grid_density(layout: DataFrame, grid: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, density): normal kernel density of (u1, u2) on a grid over its range, scaled to a maximum of 1, values
    below ``floor`` set to 0. Cells are dealt linearly to the four grid points around them before smoothing."""
    layout = stored(layout.select("u1", "u2"), "layout")
    row = layout.agg(F.count(F.lit(1)), *(f(c) for c in ("u1", "u2") for f in (F.min, F.max, F.stddev_samp))).first()
    quartiles = whole_quantiles(layout, ["u1", "u2"], [0.25, 0.75])
    n, axes, steps, widths = row[0], [], [], []
    for k in range(2):
        low, high, sd = row[1 + 3 * k : 4 + 3 * k]
        if high <= low:
            low, high = low - 0.5, high + 0.5
        axes.append(np.linspace(low, high, grid))
        steps.append((high - low) / (grid - 1))
        h = normal_reference(sd or 0.0, *quartiles[f"u{k + 1}"], n)
        widths.append(h / 4 if np.isfinite(h) and h > 0 else 0.25)
    at = [(F.col(c) - F.lit(float(axes[k][0]))) / F.lit(steps[k]) for k, c in enumerate(("u1", "u2"))]
    cell = [F.least(F.lit(grid - 2), F.floor(a)).cast("int") for a in at]
    part = [a - c for a, c in zip(at, cell, strict=True)]
    corners = F.array(*(F.struct((cell[0] + i).alias("i"), (cell[1] + j).alias("j"), ((part[0] if i else 1 - part[0]) * (part[1] if j else 1 - part[1])).alias("w")) for i in (0, 1) for j in (0, 1)))
    counts = np.zeros((grid, grid))
    for r in layout.select(F.inline(corners)).groupBy("i", "j").agg(F.sum("w").alias("w")).collect():  # grid x grid rows at most
        counts[r.i, r.j] = r.w
    kernels = [np.exp(-0.5 * ((a[:, None] - a[None, :]) / w) ** 2) for a, w in zip(axes, widths, strict=True)]
    z = kernels[0] @ counts @ kernels[1].T
    z = z / z.max() if z.max() > 0 else z * 0
    z[z < floor] = 0
    return axes[0], axes[1], z


def hill_basins(density: np.ndarray) -> np.ndarray:
    """Labels 1.. of the local maximum that steepest ascent over eight neighbours reaches, 0 where the density is 0.
    Labels follow the first place, column by column, that reaches a maximum."""
    nx, ny = density.shape
    padded = np.full((nx + 2, ny + 2), -np.inf)
    padded[1:-1, 1:-1] = density
    # neighbours in column-major order, so that the first of equals is the one with the smallest column, then row
    shifts = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    around = np.stack([padded[1 + dx : nx + 1 + dx, 1 + dy : ny + 1 + dy] for dx, dy in shifts])
    best = around.argmax(axis=0)
    up = around.max(axis=0) > density
    ix, iy = np.indices(density.shape)
    dx, dy = np.array(shifts).T
    to = np.where(up, (ix + dx[best]) * ny + iy + dy[best], ix * ny + iy).ravel()
    while not np.array_equal(to, to[to]):
        to = to[to]
    tops = to.reshape(nx, ny)
    labels, names = np.zeros(density.shape, int), {}
    for j in range(ny):
        for i in np.flatnonzero(density[:, j] > 0):
            labels[i, j] = names.setdefault(int(tops[i, j]), len(names) + 1)
    return labels


def flood_basins(density: np.ndarray, tolerance: float) -> np.ndarray:
    """Watershed by flooding from the top: places join the neighbour basin; two basins that meet are one if the lower
    peak stands less than ``tolerance`` above the meeting place."""
    nx, ny = density.shape
    labels = np.zeros(density.shape, int)
    parent, peak = [0], [0.0]

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for flat in np.argsort(-density.ravel(order="F"), kind="stable"):
        j, i = divmod(int(flat), nx)
        height = density[i, j]
        if height <= 0:
            break
        near = {root(int(k)) for k in labels[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2].ravel() if k}
        if not near:
            parent.append(len(parent))
            peak.append(height)
            labels[i, j] = len(parent) - 1
            continue
        first, *others = sorted(near, key=lambda k: (-peak[k], k))
        labels[i, j] = first
        for k in others:
            if peak[k] - height < tolerance:
                parent[k] = first
    names: dict[int, int] = {}
    for j in range(ny):
        for i in range(nx):
            if labels[i, j]:
                labels[i, j] = names.setdefault(root(int(labels[i, j])), len(names) + 1)
    return labels


def assign_basins(layout: DataFrame, x: np.ndarray, y: np.ndarray, labels: np.ndarray, small: str = "uncertain", min_abs: int = 30, min_frac: float = 0.002) -> tuple[DataFrame, list[int]]:
    """``layout`` (u1, u2, ...) with raw_population and population; and the basins that were kept, renumbered from 1.

    Basins with fewer cells than max(min_abs, ceil(min_frac * n)) are dropped (NULL) or merged into the nearest kept
    centre; if all are small the largest is kept.
    """
    require(small in ("uncertain", "merge"), "small basins are uncertain or merged")
    spark = layout.sparkSession
    # the place at or below: equal steps, but for grids given with other ones
    axis = lambda c, g: F.greatest(F.lit(0), F.least(F.lit(len(g) - 1), F.array_size(F.filter(F.lit(g.tolist()), lambda v: v <= c)) - 1)) if not _even(g) else F.greatest(F.lit(0), F.least(F.lit(len(g) - 1), F.floor((c - F.lit(float(g[0]))) / F.lit(float(g[1] - g[0])))))
    table = spark.createDataFrame([(int(i), int(j), int(labels[i, j])) for i, j in zip(*np.nonzero(labels > 0), strict=True)], "i int, j int, raw_population int")
    raw = layout.withColumn("i", axis(F.col("u1"), x).cast("int")).withColumn("j", axis(F.col("u2"), y).cast("int")).join(F.broadcast(table), ["i", "j"], "left").drop("i", "j")
    stats = raw.groupBy("raw_population").agg(F.count(F.lit(1)).alias("n"), F.avg("u1").alias("cx"), F.avg("u2").alias("cy")).collect()
    total = sum(r.n for r in stats)
    found = sorted((r for r in stats if r.raw_population is not None), key=lambda r: r.raw_population)
    least = max(min_abs, int(np.ceil(min_frac * total)))
    keep = [r for r in found if r.n >= least] or ([max(found, key=lambda r: (r.n, -r.raw_population))] if found else [])
    population = F.lit(None).cast("int")
    if small == "merge" and keep:
        distance = [((F.col("u1") - F.lit(r.cx)) ** 2 + (F.col("u2") - F.lit(r.cy)) ** 2) for r in keep]
        nearest = F.array_position(F.array(*distance), F.array_min(F.array(*distance)))
        population = F.when(F.col("raw_population").isNotNull(), nearest.cast("int"))
    for k, r in enumerate(keep, 1):
        population = F.when(F.col("raw_population") == r.raw_population, F.lit(k)).otherwise(population)
    return raw.withColumn("population", population), [r.raw_population for r in keep]


def _even(g: np.ndarray) -> bool:
    return len(g) > 1 and np.allclose(np.diff(g), g[1] - g[0])


def embed(prepared: Prepared, scores: DataFrame | None = None, n_pcs: int = 10, grid: int = 400, floor: float = 0.03, basins: str = "hillclimb", tolerance: float = 0.03, small: str = "uncertain", min_abs: int = 30, min_frac: float = 0.002, layout: str | Callable[[DataFrame], DataFrame] = "umap", n_neighbors: int = 20, min_dist: float = 0.15, seed: int = 1) -> Embedding:
    """``layout``: "umap" (with n_neighbors, min_dist and seed), "pca" for the first two components (0 where there is only
    one), or a function that takes keys and components and adds u1 and u2."""
    require(layout in ("umap", "pca") or callable(layout), "layouts are umap, pca or a function")
    require(basins in ("hillclimb", "flood") and grid >= 10 and n_pcs >= 1, "basins, grid or n_pcs out of range")
    x, names = embedding_input(prepared, scores)
    pcs, loadings = pca_scores(x, [f"x_{m}" for m in names], n_pcs, KEYS)
    if layout == "umap":
        layout = umap(n_neighbors, min_dist, seed)
    placed = stored(layout(pcs), "placed") if callable(layout) else pcs.withColumn("u1", F.col("pc1")).withColumn("u2", F.col("pc2") if loadings.shape[1] > 1 else F.lit(0.0))
    gx, gy, density = grid_density(placed, grid, floor)
    labels = hill_basins(density) if basins == "hillclimb" else flood_basins(density, tolerance)
    out, kept = assign_basins(placed, gx, gy, labels, small, min_abs, min_frac)
    return Embedding(out, tuple(names), loadings, gx, gy, density, labels, tuple(kept), score_digest(prepared, scores))
