"""SimHash near-duplicates by pigeonhole blocks.

Fingerprint: lower-cased (A-Z) words, 3-word shingles with repeats, XXH64 (seed 42) of each, and a bit for every
position set in over half of the hashes. Two fingerprints link at MAX_BITS = 2 or fewer differing bits.

Search works on distinct fingerprints, so exact copies cost nothing. 64 bits are cut into PIECES = 5; two differing
bits touch two pieces at most, so a linked pair agrees on three pieces, about 38 bits, and meets in one of ten blocks.
Blocks of up to BLOCK_PAIRS fingerprints are joined with themselves and verified by Hamming distance. Larger blocks
(families of near copies) never form pairs: each of their fingerprints is sent to itself and to itself with one bit
flipped, for the bits that vary within its large blocks. Fingerprints that meet at such a centre are each within one
bit of it, hence linked, and fingerprints at distance two meet at the centre between them, so this is exact, with 65
rows for a fingerprint at most and groups of 65 at most. Linking the members of a centre as a star leaves the
components as they are.

Components: alternating large-star and small-star steps (Kiveris et al. 2014) on written tables.

Nulls: a null or empty text has fingerprint zero; a null doc_id takes part and is never chosen as component_id while
the component has another id. Repeated rows come out as often as they come in. Extra columns are ignored. An empty
table gives no rows. Fingerprints of many copies (hot keys) are dealt over parts when rows meet their component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ready
from .common import bounded, fresh, join_by_class, release, stored

SHINGLE, SEED, MAX_BITS, PIECES, BLOCK_PAIRS = 3, 42, 2, 5, 32
CHUNK = 1 << 18


def fingerprint(text: bytes) -> int:
    """The fingerprint as an unsigned number; works through long texts in chunks of CHUNK shingles."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(SHINGLE, n)
    total = n - width + 1
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, CHUNK):
        to = min(total, at + CHUNK)
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist(), strict=True)]
        octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        prints = np.fromiter((fingerprint(x.as_py() or b"") for x in texts), dtype=np.uint64, count=len(texts))
        rest = [n for n in batch.schema.names if n not in ("text", "doc_id")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64)), *(batch.column(n) for n in rest)], names=["doc_id", "fp", *rest])


def fingerprints(docs: DataFrame, *extra: str) -> DataFrame:
    """(doc_id long, fp long, extra...), one row for each row of ``docs``; fp holds the 64 bits as a signed number."""
    ready(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    return narrow.mapInArrow(_fingerprints, "doc_id long, fp long" + "".join(f", {c} long" for c in extra))


def _masks(pieces: int = PIECES) -> list[int]:
    """Signed masks of all choices of pieces - MAX_BITS of the pieces."""
    from itertools import combinations

    bounds = [round(64 * k / pieces) for k in range(pieces + 1)]
    parts = [(1 << bounds[k + 1]) - (1 << bounds[k]) for k in range(pieces)]
    masks = [sum(chosen) for chosen in combinations(parts, pieces - MAX_BITS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints that leave the components of all links as they are.

    ``prints`` has one distinct column fp.
    """
    keys = F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for k, m in enumerate(_masks())))
    blocks = prints.select("fp", F.inline(keys))
    # size, and the bits that vary among the members
    sizes = blocks.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n"), F.bit_or("fp").alias("any"), F.bit_and("fp").alias("all")).where("n > 1")
    full = stored(blocks.join(sizes, ["k", "part"]).selectExpr("k", "part", "fp", "n", "any & ~all as vary"), "simhash-blocks")
    small = full.where(F.col("n") <= BLOCK_PAIRS)
    left, right = small.selectExpr("k", "part", "fp as a"), small.selectExpr("k", "part", "fp as b")
    pairs = left.join(right, ["k", "part"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.expr("a ^ b")) <= MAX_BITS)).select("a", "b")
    large = full.where(F.col("n") > BLOCK_PAIRS).groupBy("fp").agg(F.bit_or("vary").alias("vary"))
    flips = F.expr("concat(array(fp), transform(filter(sequence(0, 63), i -> (shiftright(vary, i) & 1L) = 1L), i -> fp ^ shiftleft(1L, i)))")
    centres = large.select("fp", F.explode(flips).alias("centre")).groupBy("centre").agg(F.collect_set("fp").alias("near")).where(F.size("near") > 1)
    stars = centres.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a < b")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the component of every node of ``edges`` (a, b)."""
    edges = stored(edges.where("a <> b").select("a", "b"), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("m").alias("a"), "b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()
        before, edges = edges, stored(small, "stars")
        release(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    tips = edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return tips.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))


def near_duplicates(docs: DataFrame, similar: bool = False) -> DataFrame:
    """(doc_id, mark, fp, comp, component_id), one row for each row of ``docs``; mark is a hash of the text, comp the
    smallest fingerprint of the component. With ``similar``, near copies by word similarity (``near_copies``) link too,
    however many bits they differ in."""
    from . import near_copies

    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    prints = stored(near_copies.described(narrow, "mark") if similar else fingerprints(narrow, "mark"), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    edges = links(classes.select("fp"))
    if similar:
        # a set of shingles stands at the smallest of its fingerprints
        keyed = stored(prints.select("key", "fp").distinct(), "keys")
        least = keyed.groupBy("key").agg(F.min("fp").alias("least"))
        near = near_copies.links(prints, narrow, "mark")
        pairs = near.join(least.selectExpr("key as a", "least as fa"), "a").join(least.selectExpr("key as b", "least as fb"), "b")
        edges = edges.unionByName(pairs.selectExpr("fa as a", "fb as b")).unionByName(keyed.join(least, "key").selectExpr("least as a", "fp as b")).where("a <> b")
    labels = components(edges)
    linked = classes.join(labels, classes.fp == labels.node, "left").select("fp", "first", "n", F.coalesce("label", "fp").alias("label"))
    ids = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    by_print = stored(linked.join(ids, "label").select("fp", F.col("label").alias("comp"), "component_id", "n"), "components")
    return join_by_class(prints, by_print, "fp", F.xxhash64("doc_id", "mark")).select("doc_id", "mark", "fp", "comp", "component_id")


def op1_simhash(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, similar: bool = False) -> DataFrame:
    """One row of each component of ``docs``, all its columns kept: that of the smallest doc_id, and among texts that
    share it that of the smallest text hash. Rows without doc_id stay only where a component has no other; of repeated
    rows one stays."""
    found = near_duplicates(docs, similar)
    rows = found.groupBy("comp", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    best = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark", "n")).alias("b"))
    chosen, mark, times = fresh(docs, "chosen", "mark", "times")
    keep = stored(best.select(F.col("b.doc_id").alias(chosen), F.col("b.mark").alias(mark), F.col("b.n").alias(times)), "kept-ids")
    same = docs["doc_id"].cast("long").eqNullSafe(keep[chosen]) & (F.xxhash64(docs["text"].cast("string")) == keep[mark])
    single = docs.join(bounded(keep.where(F.col(times) == 1)), same, "left_semi")
    repeated = keep.where(F.col(times) > 1)
    if repeated.isEmpty():
        return single
    again = docs.join(bounded(repeated), same).dropDuplicates([chosen, mark]).select(*(F.col(f"`{c}`") for c in docs.columns))
    return single.unionByName(again)
