import os
import random
import zlib

import numpy as np
import pytest

from cytoloom.llm import quality_classifier as qc
from cytoloom.llm.common import table

SCHEMA, LABELS = "doc_id long, text string, score string", "doc_id long, quality int, toxic int"


def corpus(n=600):
    rng = random.Random(3)
    voc = ["".join(rng.choices("abcdefghijklmno", k=rng.randrange(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for k in range(n):
        words = rng.choices(voc, k=rng.randrange(30, 120))
        good = k % 4 != 0
        if not good:
            words = [w + "###" for w in words] if k % 8 else words[:3] * 30
        docs.append((k, " ".join(words), "x"))
        labels.append((k, int(good), 0))
    return docs, labels


def test_held_out_accuracy_rows_and_nulls(spark):
    docs, labels = corpus()
    docs += [(1000, None, "x"), (1001, "", "x"), (None, "a b", "x"), docs[0]]
    labels += [(1000, 0, 0), (2000, 1, 0), (None, 1, 0), (3, None, 0)]
    out = qc.op2_quality_classifier(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(docs)
    truth = dict((a, b) for a, b, _ in corpus()[1])
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held) and len(held) > 80
    empty = {r.score for r in out if r.doc_id in (1000, 1001)}
    assert len(empty) == 1


def test_column_is_the_ensemble(spark):
    docs, labels = corpus(400)
    df = spark.createDataFrame(docs, SCHEMA)
    ensemble = qc.fit(df, spark.createDataFrame(labels, LABELS))
    assert 0 < len(ensemble.rules) < 60
    stats = qc.statistics(df).toPandas()
    want = dict(zip(stats.c0, ensemble.predict({s: stats[f"s_{s}"].to_numpy() for s in qc.STATISTICS}), strict=True))
    got = qc.score(df, ensemble)
    assert got.columns == ["doc_id", "text", "score", "_score", "predicted"]
    assert all(np.isclose(r["_score"], want[r.doc_id], atol=1e-12) for r in got.collect())


def test_without_labels(spark):
    docs, nothing = spark.createDataFrame([(1, "a", "")], SCHEMA), spark.createDataFrame([], LABELS)
    [row] = qc.op2_quality_classifier(docs, nothing).collect()
    assert row.score == 0.5 and row.predicted == 1
    assert qc.op2_quality_classifier(docs.limit(0), nothing).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_accuracy_on_the_tables(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rows = qc.op2_quality_classifier(docs, labels).where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").toPandas()
    assert (rows.predicted == rows.quality).mean() >= 0.98
    good, bad = rows.score[rows.quality == 1].to_numpy(), rows.score[rows.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() >= 0.99


def test_columns_of_any_name_pass_and_repeated_ids_are_learned_once(spark):
    docs, labels = corpus(300)
    df = spark.createDataFrame([(*d[:2], 7, 8, 9, 10) for d in docs], "doc_id long, text string, _n int, _t int, _words int, s_log_words int")
    plain = qc.fit(df, spark.createDataFrame(labels, LABELS))
    again = qc.fit(df.unionByName(df).unionByName(df), spark.createDataFrame(labels * 2, LABELS))
    assert again == plain
    out = qc.score(df, plain)
    assert out.columns == [*df.columns, "score", "predicted"]
    assert {tuple(r)[2:6] for r in out.collect()} == {(7, 8, 9, 10)}


def test_weights_meet_the_conditions_of_the_l1_optimum():
    """At the optimum the gradient of the log-loss is -PENALTY * sign(w) where w is not 0, and within PENALTY else."""
    rng = np.random.default_rng(4)
    table = {f"f{k}": rng.normal(size=900) for k in range(4)}
    y = (rng.random(900) < 1 / (1 + np.exp(-2 * table["f0"] + (table["f1"] > 0.5)))).astype(float)
    ensemble = qc.fit_table(table, y)
    p = ensemble.predict(table)
    for rule, weight in ensemble.rules:
        slope = float((qc.rule_holds(rule, table) * (p - y)).mean())
        assert abs(slope + np.sign(weight) * qc.PENALTY) < 2e-4
    assert abs(float((p - y).mean())) < 2e-4 and 0 < len(ensemble.rules) < 100


def test_trees_split_where_the_gain_is_highest():
    """The first split against all splits, tried one by one."""
    rng = np.random.default_rng(5)
    x = {"a": rng.integers(0, 9, 300).astype(float), "b": rng.normal(size=300)}
    y = (x["a"] > 4).astype(float)
    y[:20] = 1 - y[:20]
    rules = [r for r, _ in qc.fit_table(x, y).rules]
    gain = lambda m: (y[m] - y.mean()).sum() ** 2 / (m.sum() * y.var() + 1) + (y[~m] - y.mean()).sum() ** 2 / ((~m).sum() * y.var() + 1)
    best = max(((n, c) for n, v in x.items() for c in np.unique(v)[:-1] if min((v <= c).sum(), (v > c).sum()) >= qc.LEAF), key=lambda k: gain(x[k[0]] <= k[1]))
    assert best[0] == "a" and any(r[0][0] == "a" and r[0][2] == best[1] for r in rules)
