"""The stages against a plain version of each decision."""

import hashlib

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline
from cytoloom.llm import pii
from tests.llm.test_decontaminate import slow as slow_leaks
from tests.llm.test_near_copies import similar
from tests.llm.test_quality_rules import slow as slow_quality
from tests.llm.test_sentencepiece import LIBRARY
from tests.llm.test_simhash import slow_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def word(seed, k):
    return "".join("abcdefghijklmnop"[int(c, 16)] for c in hashlib.md5(f"{seed} {k}".encode()).hexdigest()[: 2 + k % 7])


def text(seed, n=80):
    return " ".join(word(seed, k) for k in range(n))


def test_pipeline(spark, tmp_path):
    leak = text("item", 30)
    rows = [(k, text(k), "en", "s", 0) for k in range(40)]
    rows += [(100, text(3), "en", "s", 0), (101, text(4) + " eop.99@mail9.example.com 4944339490429605", "en", "s", 0), (102, text(200) + " " + leak, "en", "s", 0)]
    rows += [(103, "short", "en", "s", 0), (104, "again and again " * 40, "en", "s", 0), (105, text(300).replace(" ", "### "), "en", "s", 0), (106, None, None, None, None), (107, text(301) + " call +1 (386) 555-3733", None, None, 5)]
    rows += [(108, text(400) + " eop.99@mail9.example.com 4944339490429605", "en", "s", 0), (109, text(4, 40) + " " + text(500, 40), "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = [r for r in rows if not slow_quality(r[1])[-1] and r[0] != 105]
    prints = [slow_fingerprint(r[1]) for r in left]
    label = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 or similar(left[i][1], left[j][1]):
                label = [label[j] if x == label[i] else x for x in label]
    first = {}
    for r, c in sorted(zip(left, label, strict=True), key=lambda x: x[0][0]):
        first.setdefault(c, r)
    clean = [r for r, s in zip(first.values(), slow_leaks(list(first.values()), [(1, leak)]), strict=True) if not s[-1]]
    assert sorted(out) == sorted(r[0] for r in clean) and not {100, 101, 102, 105} & set(out) and {108, 109} <= set(out)
    for r in clean:
        changed = pii.Pseudonyms().apply(r[1])[0]
        got = out[r[0]]
        assert got.ids == LIBRARY.encode(changed) and got.n_tokens == len(got.ids) and got.n_chars == len(changed) and got.round_trip
    assert "386" not in LIBRARY.decode(out[107].ids)
