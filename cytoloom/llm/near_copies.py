"""Near copies by word similarity: pairs of texts whose sets of SHINGLE-word shingles have a Jaccard similarity of
SIMILAR or more.

A SimHash radius that reaches 0.8 is of no use as a search: such pairs differ in about ten bits of 64, often more, and
blocks that promise a meeting at that distance hold a few bits each. So candidates come from MinHash: BANDS bands of
ROWS minima, and a pair that shares a band is compared exactly on its shingles (64-bit hashes). A pair at 0.8 shares none
with a probability of 0.672 ** 30, about 1 in 150,000; more similar pairs are missed more rarely still.

A band's members never form all their pairs at once. First each meets its band's centre, the member that shares bands with
most others. Bands of one family have the same few centres, texts near its original, so a large family costs a few
comparisons for a member. Then, in bands whose members are not all of one
component, those outside the most frequent component meet the others: all of them in bands of FEW members. In larger ones
(texts around one original, of which the outer are near nobody, or texts that share a long passage) the search goes by
prefixes and positions (Bayardo, Ma, Srikant 2007; Xiao et al. 2008), which is exact: with shingles in the order of their frequency, two
similar texts have their first common one so early in both that enough can follow. What a text shares with nobody
comes first, so an outer text meets no one, and a passage that many share comes last.
Before the exact comparison pairs go that cannot be similar by their numbers of shingles, or whose minima agree in less
than ROUGH of BANDS * ROWS places (six deviations below 0.8).

Words are those of the fingerprints. A text with fewer words than SHINGLE is one shingle, and one without words has none;
texts of equal sets are similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ready
from . import simhash
from .common import bounded, stored

SHINGLE, SIMILAR, BANDS, ROWS, ROUGH, FEW = 5, (4, 5), 30, 5, 0.6, 32
CHUNK = 512
_DEALT = np.random.default_rng(42).integers(0, 1 << 64, size=(2, BANDS * ROWS, 1), dtype=np.uint64)
ADDED, FACTORS = _DEALT[0], _DEALT[1] | np.uint64(1)


def members(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    width = min(SHINGLE, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    last = len(words) - width + 1
    return np.unique(np.fromiter((digest(joined[s:e], simhash.SEED) for s, e in zip(starts[:last].tolist(), ends[width - 1 :].tolist(), strict=True)), dtype=np.uint64, count=last))


def minima(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), CHUNK):
        np.minimum(least, ((found[None, at : at + CHUNK] ^ ADDED) * FACTORS).min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> list[int]:
    """A hash of each band of minima, as signed numbers; the band's number is part of the hash."""
    octets, width = least.astype("<u8").tobytes(), 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(octets[k * width : (k + 1) * width], k) for k in range(BANDS)], dtype=np.uint64).view(np.int64).tolist()


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, keys, signs = [], [], []
        for x in batch.column("text").cast(pa.binary()):
            text = x.as_py() or b""
            found = members(text)
            prints.append(simhash.fingerprint(text))
            keys.append(xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), simhash.SEED))
            signs.append(bands(minima(found)))
        rest = [n for n in batch.schema.names if n not in ("text", "doc_id")]
        columns = [batch.column("doc_id"), _signed(prints), _signed(keys), pa.array(signs, pa.list_(pa.int64())), *(batch.column(n) for n in rest)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "key", "bands", *rest])


SETS = "key long, n int, sketch array<smallint>, members array<long>"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [members(x.as_py() or b"") for x in batch.column("text").cast(pa.binary())]
        # of each minimum 15 bits
        sketches = [(minima(x) & np.uint64(0x7FFF)).astype(np.int16) for x in found]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(map(len, found), pa.int32()), pa.array(sketches, pa.list_(pa.int16())), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], names=["key", "n", "sketch", "members"])


def described(docs: DataFrame, *extra: str) -> DataFrame:
    """(doc_id, fp, key, bands, extra...), one row for each row of ``docs``; key stands for the set of shingles."""
    ready(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    return narrow.mapInArrow(_described, "doc_id long, fp long, key long, bands array<long>" + "".join(f", {c} long" for c in extra))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    least, of = SIMILAR
    rough = pairs.join(sets.selectExpr("key as a", "n as na", "sketch as ka"), "a").join(sets.selectExpr("key as b", "n as nb", "sketch as kb"), "b")
    agree = F.expr(f"size(filter(zip_with(ka, kb, (x, y) -> x = y), z -> z)) >= {round(ROUGH * BANDS * ROWS)}")
    rough = rough.where((F.least("na", "nb") * of >= F.greatest("na", "nb") * least) & agree).select("a", "b")
    near = rough.join(sets.selectExpr("key as a", "members as ma"), "a").join(sets.selectExpr("key as b", "members as mb"), "b")
    shared = near.select("a", "b", F.expr("size(ma) + size(mb)").alias("both"), F.expr("size(array_intersect(ma, mb))").alias("same"))
    return shared.where(F.col("same") * of >= (F.col("both") - F.col("same")) * least).select("a", "b")


def _mixed(groups: DataFrame) -> DataFrame:
    """``groups`` (part, key, label, ...) of which not all members have one label, with minor (whether the label isn't the
    part's most frequent) and members (how many the part has)."""
    tallies = groups.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"))
    major = tallies.groupBy("part").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("members")).where("labels > 1").drop("labels")
    return groups.join(major, "part").withColumn("minor", F.col("label") != F.col("major")).drop("major")


def _across(mixed: DataFrame, possible: str = "true") -> DataFrame:
    """Pairs (a, b), a < b, of members of a part with different labels: each minor member with all others for which
    ``possible`` holds, SQL over the columns of x and y."""
    named = lambda df, side: df.select("part", *(F.col(c).alias(f"{c}_{side}") for c in df.columns if c not in ("part", "minor", "members")))
    pairs = named(mixed.where("minor"), "x").join(named(mixed, "y"), "part").where(f"label_x <> label_y and {possible}")
    return pairs.select(F.least("key_x", "key_y").alias("a"), F.greatest("key_x", "key_y").alias("b")).distinct()


def _rarest(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """(part, key, label, n, place): the rarest shingles of each of ``crowd`` (key, label) that others have too, with their
    places in the order of frequency, up to the last place at which a similar text's first common shingle can be."""
    least, of = SIMILAR
    spread = crowd.join(sets.select("key", "n", "members"), "key").select("key", "label", "n", F.explode("members").alias("part"))
    counts = spread.groupBy("part").agg(F.count(F.lit(1)).alias("times"))
    ranked = spread.join(counts, "part").selectExpr("*", "row_number() over (partition by key order by times, part) as place")
    return ranked.where(f"place <= n - (({least} * n + {of - 1}) div {of}) + 1 and times > 1").select("part", "key", "label", "n", "place")


#: Over n and place of two texts: whether what follows their common shingle can make them similar.
IN_TIME = f"(1 + least(n_x - place_x, n_y - place_y)) * {sum(SIMILAR)} >= {SIMILAR[0]} * (n_x + n_y)"


def links(table: DataFrame, docs: DataFrame, mark: str) -> DataFrame:
    """(a, b), a < b: links between keys that leave the components of all similar pairs as they are. ``table``: the stored
    result of ``described`` with the column ``mark`` carried along; ``docs``: its rows (doc_id, text, mark).

    Sets of shingles are made again for the texts that share a band with another, one text for each key; no others are kept
    or moved.
    """
    # one row for each key, so that a text with many copies counts once from here on
    distinct = stored(table.groupBy("key").agg(F.first("bands").alias("bands"), F.min(F.struct("doc_id", mark)).alias("one")), "near-distinct")
    spread = distinct.select("key", F.explode("bands").alias("part"))
    sizes = stored(spread.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-sizes")
    shared = stored(spread.join(bounded(sizes), "part"), "near-shared")
    weighed = shared.join(shared.groupBy("key").agg(F.sum("n").alias("met")), "key").select("part", "key", "met")
    centres = weighed.groupBy("part").agg(F.max(F.struct("met", "key")).alias("c")).select("part", F.col("c.key").alias("centre"))
    full = stored(shared.join(bounded(stored(centres, "near-centres")), "part").select("part", "key", "centre"), "near-bands")
    one = distinct.join(bounded(stored(full.select("key").distinct(), "near-keys")), "key", "left_semi")
    one = stored(one.select("key", F.col("one.doc_id").alias("_id"), F.col(f"one.{mark}").alias("_text_hash")), "near-ones")
    texts = docs.join(bounded(one), docs["doc_id"].eqNullSafe(F.col("_id")) & (docs[mark] == F.col("_text_hash"))).select("key", "text")
    # repeated rows have the same set
    sets = stored(texts.mapInArrow(_sets, SETS).groupBy("key").agg(*(F.first(c).alias(c) for c in ("n", "sketch", "members"))), "near-sets")
    stars = full.where("key <> centre").select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")).distinct()
    first = stored(_similar(stars, sets), "near-stars")
    labels = simhash.components(first)
    placed = full.where("key <> centre").join(labels, full.key == labels.node, "left").select("part", "key", F.coalesce("label", "key").alias("label"))
    mixed = stored(_mixed(placed), "near-mixed")
    pairs = _across(mixed.where(F.col("members") <= FEW))
    crowd = mixed.where(F.col("members") > FEW).select("key", "label").distinct()
    if not crowd.isEmpty():
        pairs = pairs.unionByName(_across(stored(_mixed(_rarest(crowd, sets)), "near-rarest"), IN_TIME)).distinct()
    return first.unionByName(_similar(pairs, sets))
