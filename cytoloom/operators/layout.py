"""A UMAP layout (McInnes, Healy, Melville 2018) of principal components.

Up to LANDMARKS cells are laid out together: nearest neighbours, a fuzzy graph, and stochastic attraction and repulsion from
the first two components on. Of more cells a sample by hash of the key, LANDMARKS of them in expectation, is laid out (a
setting of the method, like n_neighbors), and every cell is placed among its nearest landmarks with the graph's weights, in
Arrow batches. So work and memory of the layout are bounded, and the rest grows with the cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..errors import InputError, require
from ..functions.canonical import cell_key
from ..session import ready
from ..storage import stored

LANDMARKS, NEGATIVES, PARTS = 5000, 5, 8


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b for which 1 / (1 + a x ** (2 b)) is nearest to 1 up to min_dist and exp(-(x - min_dist) / spread) beyond."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p = np.zeros(2)  # logarithms of a and b
    damping, last = 1e-2, math.inf
    for _ in range(200):
        a, b = np.exp(p)
        power = x ** (2 * b)
        f = 1 / (1 + a * power)
        slopes = np.column_stack([-a * power * f * f, -a * power * 2 * b * np.log(x) * f * f])
        step = np.linalg.solve(slopes.T @ slopes + damping * np.eye(2), slopes.T @ (y - f))
        trial = np.exp(p + step)
        error = float(((y - 1 / (1 + trial[0] * x ** (2 * trial[1]))) ** 2).sum())
        if error < last:
            p, damping = p + step, damping / 3
            if last - error < 1e-14:
                break
            last = error
        else:
            damping *= 4
    return float(math.exp(p[0])), float(math.exp(p[1]))


def nearest(points: np.ndarray, to: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and numbers of the k nearest rows of ``to``, the nearest first."""
    squares = (to * to).sum(1)
    d, at = np.empty((len(points), k)), np.empty((len(points), k), int)
    for lo in range(0, len(points), 512):
        part = points[lo : lo + 512]
        d2 = np.maximum((part * part).sum(1)[:, None] + squares - 2 * part @ to.T, 0)
        some = np.argpartition(d2, k - 1, axis=1)[:, :k] if k < len(to) else np.tile(np.arange(len(to)), (len(part), 1))
        near = np.take_along_axis(d2, some, axis=1)
        order = np.lexsort((some, near), axis=1)
        at[lo : lo + 512] = np.take_along_axis(some, order, axis=1)
        d[lo : lo + 512] = np.sqrt(np.take_along_axis(near, order, axis=1))
    return d, at


def memberships(d: np.ndarray) -> np.ndarray:
    """Weights of neighbours at distances ``d`` (rows sorted): 1 for the nearest that isn't at 0, falling so that a row's
    weights sum to log2 of its neighbours."""
    target = math.log2(d.shape[1])
    positive = np.where(d > 0, d, np.inf).min(axis=1)
    rho = np.where(np.isfinite(positive), positive, 0.0)
    low, high, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    gap = np.maximum(d - rho[:, None], 0)
    for _ in range(64):
        total = np.exp(-gap / sigma[:, None]).sum(1)
        above = total > target
        high, low = np.where(above, sigma, high), np.where(above, low, sigma)
        sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
    sigma = np.maximum(sigma, 1e-3 * np.maximum(d.mean(axis=1), 1e-12))
    return np.exp(-gap / sigma[:, None])


def graph(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges i < j of the fuzzy union of everyone's neighbours, and their weights."""
    d, at = nearest(x, x, min(k, len(x)))
    w = memberships(d)
    i, j, w = np.repeat(np.arange(len(x)), d.shape[1]), at.ravel(), w.ravel()
    keep = i != j
    code = np.minimum(i, j)[keep] * len(x) + np.maximum(i, j)[keep]
    edges, place, times = np.unique(code, return_inverse=True, return_counts=True)
    total, product = np.bincount(place, w[keep]), np.exp(np.bincount(place, np.log(np.maximum(w[keep], 1e-300))))
    return edges // len(x), edges % len(x), np.where(times > 1, total - product, total)


def optimise(x: np.ndarray, k: int, min_dist: float, epochs: int, seed: int) -> np.ndarray:
    """Two coordinates for each row of ``x``."""
    rng = np.random.default_rng(seed)
    start = x[:, :2] if x.shape[1] > 1 else np.column_stack([x[:, 0], rng.normal(0, 1e-4, len(x))])
    y = 10 * (start - start.mean(0)) / max(float(np.abs(start - start.mean(0)).max()), 1e-12) + rng.normal(0, 1e-4, (len(x), 2))
    i, j, w = graph(x, k)
    if not len(w):
        return y
    a, b = curve(min_dist)
    share = w / w.max()
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        for part in np.array_split(rng.permutation(np.flatnonzero(rng.random(len(w)) < share)), PARTS):
            p, q = i[part], j[part]
            away = y[p] - y[q]
            d2 = (away * away).sum(1)
            pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * d2**b), 0)
            move = np.clip(pull[:, None] * away, -4, 4) * rate
            np.add.at(y, p, move)
            np.add.at(y, q, -move)
            for own in (p, q):
                mine, other = np.repeat(own, NEGATIVES), rng.integers(0, len(x), NEGATIVES * len(own))
                away = y[mine] - y[other]
                d2 = (away * away).sum(1)
                push = np.where(mine != other, 2 * b / ((0.001 + d2) * (1 + a * d2**b)), 0)
                np.add.at(y, mine, np.clip(push[:, None] * away, -4, 4) * rate / 2)
    return y


def umap(n_neighbors: int = 20, min_dist: float = 0.15, seed: int = 1, epochs: int | None = None, landmarks: int = LANDMARKS) -> Callable[[DataFrame], DataFrame]:
    """A layout for ``embed``: adds u1 and u2 to a table of keys and components pc1, pc2, ..."""
    require(n_neighbors >= 2 and 0 <= min_dist < 3 and landmarks >= 4, "n_neighbors, min_dist or landmarks out of range")

    def layout(pcs: DataFrame) -> DataFrame:
        ready(pcs.sparkSession)
        pcs = stored(pcs, "components")
        names = [c for c in pcs.columns if c.startswith("pc")]
        n = pcs.count()
        if n < 4:
            raise InputError("an embedding needs four cells at least")
        mark = F.xxhash64(F.lit(seed), cell_key())
        # a row of few numbers for each landmark
        chosen = pcs if n <= landmarks else pcs.where(F.pmod(mark, F.lit(1 << 30)) < F.lit(int((1 << 30) * landmarks / n)))
        x = np.array([tuple(r) for r in chosen.orderBy(mark, "image_id", "cell_id").select(*names).collect()], float)
        y = optimise(x, n_neighbors, min_dist, epochs or (500 if len(x) <= 10_000 else 200), seed)
        k = min(n_neighbors, len(x))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
                d, at = nearest(rows, x, k)
                w = memberships(d)
                here = (w[:, :, None] * y[at]).sum(1) / w.sum(1)[:, None]
                # a landmark stands at its own place
                same = d[:, 0] <= 1e-12 * np.maximum(1.0, np.abs(rows).max(axis=1))
                here[same] = y[at[same, 0]]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(here[:, 0]), pa.array(here[:, 1])], names=[*batch.schema.names, "u1", "u2"])

        return pcs.mapInArrow(place, StructType([*pcs.schema.fields, StructField("u1", DoubleType()), StructField("u2", DoubleType())]))

    return layout
