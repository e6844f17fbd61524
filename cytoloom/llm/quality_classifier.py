"""Quality classifier as a sparse rule ensemble (after Friedman and Popescu's RuleFit).

Statistics of a text are Spark columns. On a bounded sample of labelled rows (SAMPLE of them, those with the smallest
hash of the id, a documented parameter of ``fit``) gradient-boosted small trees are grown; each path from a root to a
node is a conjunctive rule over statistics. A logistic regression with an L1 penalty keeps few rules, and those become
one Spark expression, so scoring is a projection over the whole table without Python.

Nulls: a null text has the statistics of the empty text and is scored like it; rows without label are never learned
from; of several labels of an id the lower counts, and of several texts the one with the smallest hash. A table without
usable labels gives the score 0.5; with one label only, that label's smoothed share. Texts are measured whole. Repeated
rows and extra columns of any name pass through ``score``; score and predicted get underscores where they clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACES, UPPER, fresh, stored, text_of

SAMPLE, TREES, DEPTH, BINS, LEAF, SHRINK, PENALTY, ROUNDS = 20_000, 24, 3, 32, 20, 0.3, 2e-3, 400
THRESHOLD = 0.3

#: Statistic -> SQL over _t (text), _words, _lines, _n (words), _chars (characters in words).
STATISTICS = {
    "log_words": "ln(1D + _n)",
    "log_chars": "ln(1D + char_length(_t))",
    "mean_word": "_chars / greatest(_n, 1D)",
    "upper_share": f"char_length(translate(_t, '{LOWER}', '')) / greatest(char_length(_t), 1D)",
    "capital_share": f"(char_length(_t) - char_length(translate(_t, '{UPPER}', ''))) / greatest(_chars, 1D)",
    "symbols_per_word": "(char_length(_t) - char_length(translate(_t, '#*$%&|<>@^~', ''))) / greatest(_n, 1D)",
    "shouts_per_word": "(char_length(_t) - char_length(translate(_t, '!?', ''))) / greatest(_n, 1D)",
    "stops_per_word": "(char_length(_t) - char_length(translate(_t, '.,;:', ''))) / greatest(_n, 1D)",
    "digit_share": "(char_length(_t) - char_length(translate(_t, '0123456789', ''))) / greatest(_chars, 1D)",
    "distinct_words": "size(array_distinct(_words)) / greatest(_n, 1D)",
    "echoes": "size(filter(_words, (w, i) -> w = get(_words, i + 1))) / greatest(_n, 1D)",
    "repeated_lines": "(size(_lines) - size(array_distinct(_lines))) / greatest(size(_lines), 1D)",
    "words_per_line": "_n / greatest(size(_lines), 1D)",
}


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with its columns as c0, c1, ... in their order, and one double column s_<name> for each statistic."""
    kept = [f"c{k}" for k in range(len(df.columns))]
    base = (
        df.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(df.columns, kept, strict=True)), text_of(text).alias("_t"))
        .withColumn("_words", F.expr(r"regexp_extract_all(_t, '[^\\x20\\x09-\\x0D]+', 0)"))
        .withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
        .withColumn("_n", F.size("_words").cast("double"))
        .withColumn("_chars", F.char_length(F.translate("_t", SPACES, "")).cast("double"))
    )
    return base.select(*kept, *(F.expr(f"cast({sql} as double)").alias(f"s_{name}") for name, sql in STATISTICS.items()))


Rule = tuple[tuple[str, bool, float], ...]  # (statistic, whether it must exceed, bound), all of them


def rule_holds(rule: Rule, table: dict[str, np.ndarray]) -> np.ndarray:
    out = True
    for name, above, bound in rule:
        out = out & ((table[name] > bound) if above else (table[name] <= bound))
    return out


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The score as a Spark expression over the s_<name> columns."""
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            holds = F.lit(True)
            for name, above, bound in rule:
                c = F.col(f"s_{name}")
                holds = holds & ((c > F.lit(bound)) if above else (c <= F.lit(bound)))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, table: dict[str, np.ndarray]) -> np.ndarray:
        total = np.full(len(next(iter(table.values()))), float(self.bias))
        for rule, weight in self.rules:
            total += np.where(rule_holds(rule, table), weight, 0.0)
        return 1 / (1 + np.exp(-total))


def _tree(codes: np.ndarray, edges: list[np.ndarray], names: list[str], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: list[Rule], step: np.ndarray) -> None:
    """Grows a tree on binned statistics; notes the path to each node and the leaves' steps."""
    if path:
        rules.append(path)
    best = (1e-6, None, None)
    if depth and len(rows) >= 2 * LEAF:
        g, h = grad[rows], hess[rows]
        total = g.sum() ** 2 / (h.sum() + 1)
        for j in range(len(names)):
            c = codes[rows, j]
            n = np.cumsum(np.bincount(c, minlength=BINS))[:-1]
            gl, hl = np.cumsum(np.bincount(c, g, BINS))[:-1], np.cumsum(np.bincount(c, h, BINS))[:-1]
            gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - total
            gain[(n < LEAF) | (n > len(rows) - LEAF)] = 0
            k = int(gain.argmax())
            if k < len(edges[j]) and gain[k] > best[0]:
                best = (gain[k], j, k)
    if best[1] is None:
        step[rows] = grad[rows].sum() / (hess[rows].sum() + 1)
        return
    _, j, k = best
    low = codes[rows, j] <= k
    for side, chosen in ((False, rows[low]), (True, rows[~low])):
        _tree(codes, edges, names, grad, hess, chosen, depth - 1, (*path, (names[j], side, float(edges[j][k]))), rules, step)


def fit_table(table: dict[str, np.ndarray], y: np.ndarray) -> Ensemble:
    """Trees, their paths as rules, and an L1 logistic regression over the rules by accelerated proximal steps."""
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    bias = float(np.log(share / (1 - share)))
    if n < 2 * LEAF or y.min() == y.max():
        return Ensemble(bias, ())
    names = list(table)
    edges, codes = [], np.zeros((n, len(names)), dtype=np.int64)
    for j, name in enumerate(names):
        cuts = np.unique(np.quantile(table[name], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        edges.append(cuts)
        codes[:, j] = np.searchsorted(cuts, table[name], side="left")
    margin, rules = np.full(n, bias), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(n)
        _tree(codes, edges, names, y - p, p * (1 - p), np.arange(n), DEPTH, (), rules, step)
        margin += SHRINK * step
    # the complement of a first split adds nothing
    rules = [r for r in dict.fromkeys(rules) if len(r) > 1 or r[0][1]]
    if not rules:
        return Ensemble(bias, ())
    x = np.column_stack([rule_holds(r, table) for r in rules]).astype(float)
    w, b = np.zeros(len(rules)), bias
    look_w, look_b, t = w.copy(), b, 1.0
    rate = 4 / (np.linalg.norm(x, 2) ** 2 / n + 1)
    for _ in range(ROUNDS):
        d = (1 / (1 + np.exp(-(x @ look_w + look_b))) - y) / n
        new = look_w - rate * (x.T @ d)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * PENALTY, 0)
        new_b = look_b - rate * d.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look_w, look_b = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return Ensemble(float(b), tuple((r, float(v)) for r, v in zip(rules, w, strict=True) if v))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    """Learns from labelled rows that aren't held out, ``sample`` of them at most, chosen by hash of the id."""
    ident, label = F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("_y")
    usable = labels.select(ident, label).where(F.col("doc_id").isNotNull() & F.col("_y").isin(0.0, 1.0) & ~held_out()).groupBy("doc_id").agg(F.min("_y").alias("_y"))
    n = usable.count()
    part = usable
    if n > sample:
        part = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * sample / n)))
    # the bound holds whatever the hashes; it is reached where they are far from even only
    part = stored(part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample), "labelled")
    # at most 2 * sample rows of two numbers, and one text for each
    texts = docs.select(ident, F.col("text").cast("string").alias("text")).join(F.broadcast(part), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("_y").alias("_y"))
    rows = statistics(texts.select("text", "_y")).drop("c0").withColumnRenamed("c1", "_y").toPandas().sort_values([*(f"s_{s}" for s in STATISTICS), "_y"])
    return fit_table({s: rows[f"s_{s}"].to_numpy(float) for s in STATISTICS}, rows["_y"].to_numpy(float))


def score(docs: DataFrame, ensemble: Ensemble, text: str = "text") -> DataFrame:
    """``docs`` with score double and predicted int."""
    names = fresh(docs, "score", "predicted")
    scored = statistics(docs, text).select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)), ensemble.column().alias(names[0]))
    return scored.withColumn(names[1], (F.col(names[0]) >= THRESHOLD).cast("int"))


def op2_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
