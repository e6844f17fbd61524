import hashlib
import random
import re

from cytoloom.llm import decontaminate

DOCS, ITEMS = "doc_id long, text string, mark string, window int", "item_id long, text string, start string"


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower().decode())


def slow(docs, items):
    out = []
    for doc_id, text, *_ in docs:
        w, hit, named = split(text), set(), set()
        for item_id, item, *_ in items:
            v = split(item)
            n = min(10, len(v))
            for g in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else ():
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) == g:
                        hit |= set(range(i, i + n))
                        named.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return out


def key(rows):
    return sorted(map(repr, rows))


def test_against_brute_force(spark):
    rng = random.Random(5)
    voc = ["a", "B", "cé", "d2", "e", "f-g"]
    items = [(k, " ".join(rng.choices(voc, k=rng.choice([1, 2, 3, 9, 10, 11, 25]))), "x") for k in range(12)] + [(99, None, "x"), (98, " - ", "x"), (97, "a B", "x"), (96, "a B", "x")]
    docs = []
    for k in range(60):
        text = " ".join(rng.choices(voc, k=rng.randrange(0, 60)))
        if k % 3 == 0:
            text += ", " + items[k % 12][1].upper() + " . " + items[(k + 5) % 12][1]
        docs.append((k, text, "m", 1))
    docs += [docs[3], (None, docs[0][1], "m", 1), (61, None, "m", 1), (62, "", "m", 1), (63, "a b " * 3000, "m", 1), (5, docs[0][1], "m", 1)]
    found = [tuple(r) for r in decontaminate.op6_decontamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()]
    assert key(found) == key(slow(docs, items))
    kept = decontaminate.clean(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert kept.columns == ["doc_id", "text", "mark", "window"]
    assert key(r.doc_id for r in kept.collect()) == key(d[0] for d, s in zip(docs, slow(docs, items), strict=True) if not s[5])


def test_shuffled_test_side_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    items = [(1, "alpha beta gamma delta eps zeta eta theta iota kappa lam", "x")]
    docs = [(1, "so alpha beta gamma delta eps zeta eta theta iota kappa lam no", "", 0), (2, "beta alpha", "", 0)]
    found = [tuple(r) for r in decontaminate.op6_decontamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()]
    assert key(found) == key(slow(docs, items))


def test_proximity(spark):
    items = spark.createDataFrame([(1, "red green blue", "")], ITEMS)
    docs = spark.createDataFrame([(1, "red x green blue", "", 0), (2, "blue green red", "", 0), (3, "red a b c d e green blue", "", 0)], DOCS)
    assert {r.doc_id for r in decontaminate.proximity(docs, items, 1).collect()} == {1}
    assert {r.doc_id for r in decontaminate.proximity(docs, items, 4).collect()} == {1, 2}


def test_empty_tables(spark):
    none, nothing = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert decontaminate.op6_decontamination(none, nothing).collect() == []
    [row] = decontaminate.op6_decontamination(spark.createDataFrame([(1, "a b", "", 0)], DOCS), nothing).collect()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)


def test_clean_keeps_columns_with_the_names_of_helpers(spark):
    docs = spark.createDataFrame([(1, "a b c", 3, 4, 5), (2, "x y z", 3, 4, 5)], "doc_id long, text string, _mark int, _doc int, ident int")
    out = decontaminate.clean(docs, spark.createDataFrame([(1, "x y")], "item_id long, text string"))
    assert [tuple(r) for r in out.collect()] == [(1, "a b c", 3, 4, 5)]
