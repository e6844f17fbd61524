import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cytoloom.llm import common, simhash

SCHEMA = "doc_id long, text string, fp string"


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprint_against_definition(monkeypatch):
    texts = ["", "a", "A b", "Ä ä x\x0by z", "x y z " * 50, " \t\n"] + [" ".join(random.Random(k).choices("ab cd ef".split(), k=k)) for k in range(40)]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [slow_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert [simhash.fingerprint(t.encode()) for t in texts] == [slow_fingerprint(t) for t in texts]


@pytest.mark.parametrize("bound", [2, 32])
def test_links_and_components_against_brute_force(spark, monkeypatch, bound):
    """A dense family of near fingerprints with chains, below and above the bound on pairs in a block."""
    monkeypatch.setattr(simhash, "BLOCK_PAIRS", bound)
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(30)]
    for base in prints[:3]:
        for _ in range(40):
            base ^= 1 << rng.randrange(20)
            base ^= (1 << rng.randrange(64)) if rng.random() < 0.6 else 0
            prints.append(base)
    prints = sorted(set(prints))
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r.node: r.label for r in simhash.components(simhash.links(df)).collect()}
    groups = {}
    for x, c in zip(signed, slow_components(prints), strict=True):
        groups.setdefault(c, set()).add(x)
    for members in groups.values():
        assert {found.get(x, x) for x in members} == {min(members)}


def test_query_with_nulls_copies_and_extra_columns(spark):
    rows = [(7, "one two three four", "x"), (3, "ONE two three four", "x"), (5, None, "x"), (9, "", "x"), (None, "one two three four", "x"), (3, "ONE two three four", "x"), (4, "q", "x")]
    out = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.op1_simhash(spark.createDataFrame(rows, SCHEMA)).collect())
    one, q = f"{slow_fingerprint(rows[0][1]):016x}", f"{slow_fingerprint('q'):016x}"
    assert out == [(False, 3, one, 3), (False, 3, one, 3), (False, 4, q, 4), (False, 5, "0" * 16, 5), (False, 7, one, 3), (False, 9, "0" * 16, 5), (True, 0, one, 3)]


def test_empty_table(spark):
    assert simhash.op1_simhash(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_of_each_keeps_one_row_with_all_columns(spark):
    rows = [(7, "one two three four", "a"), (3, "ONE two three four", "b"), (3, "ONE two three four", "b"), (5, "quite other words here", "c"), (5, "something else entirely now", "d"), (None, "quite other words here", "e"), (None, "alone in the world", "f")]
    out = simhash.one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "fp"]
    assert sorted(r.fp for r in out.collect()) == ["b", "c", "d", "f"]


def test_columns_with_the_names_of_helpers_pass(spark):
    df = spark.createDataFrame([(1, "a b c d", 5, 6, 7, 8, 9), (1, "a b c d", 5, 6, 7, 8, 9), (2, "A b c d", 1, 1, 1, 1, 1)], "doc_id long, text string, _mark int, _keep int, chosen int, times int, mark int")
    [row] = simhash.one_of_each(df).collect()
    assert tuple(row) == (1, "a b c d", 5, 6, 7, 8, 9)


def test_rows_of_hot_keys_meet_their_class_once(spark):
    """A key with a third of the rows is dealt over parts; nothing is lost or doubled."""
    rows = spark.range(4000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"))
    classes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("least"))
    out = common.join_by_class(rows, classes, "key", F.xxhash64("row"))
    assert sorted(out.columns) == ["key", "least", "row"]
    assert sorted(tuple(r) for r in out.select("row", "key", "least").collect()) == [(k, 0 if k % 3 == 0 else k, 0 if k % 3 == 0 else k) for k in range(4000)]
