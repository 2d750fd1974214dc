"""The classifier: held-out accuracy, defined edge cases, and the solver against its own optimality conditions."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from recscope.llm import common, nbsvm
from recscope.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op5_quality_classifier"](spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2 and i in got]
    assert all(got[i]["held_out"] for i in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    scores, truth = np.array([got[i]["score"] for i in held]), np.array([labels[i] for i in held])
    ranks = np.argsort(np.argsort(scores)) + 1
    ones = truth.sum()
    auc = (ranks[truth == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(truth) - ones))
    assert auc > 0.9
    assert np.mean((scores >= 0.5) == truth) > 0.85


def test_descent_meets_its_conditions():
    draw = np.random.default_rng(0)
    rows = [np.sort(draw.choice(60, 8, replace=False)) for _ in range(80)]
    labels = np.where(np.array([r.sum() for r in rows]) > 240, 1.0, -1.0)
    ratio = np.zeros(nbsvm.SIZE)
    ratio[:60] = draw.normal(size=60)
    weights = nbsvm.descend(rows, labels, ratio, cost=1.0, passes=2000)
    x = [np.append(ratio[r], 1.0) for r in rows]
    x = [v / np.linalg.norm(v) for v in x]
    dense = np.zeros((80, 61))
    for k, (r, v) in enumerate(zip(rows, x, strict=True)):
        dense[k, r], dense[k, 60] = v[:-1], v[-1]
    w = np.append(weights[:60], weights[nbsvm.SIZE])
    objective = lambda w: 0.5 * w @ w + np.maximum(0, 1 - labels * (dense @ w)).sum()
    assert all(objective(w) <= objective(w + draw.normal(size=61) * s) + 1e-3 for s in (0.3, 0.1, 0.01) for _ in range(200))


def test_features_ignore_blocks(monkeypatch):
    text = " ".join(f"W{k % 37}ord{k % 11}, " + "x " * (k % 4) for k in range(500))
    whole = nbsvm.features(text)
    for block in (64, 3, 1):
        monkeypatch.setattr(nbsvm, "BLOCK", block)
        assert np.array_equal(nbsvm.features(text), whole)
    monkeypatch.setattr(nbsvm, "cut", lambda t: common.cut(t, 100))
    assert np.array_equal(nbsvm.features(text), whole)
    assert np.array_equal(nbsvm._unpacked(nbsvm._packed(whole)), whole)
    assert len(nbsvm.features("")) == 0


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (2, "", "s"), (None, "words here", "s")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, label int")
    got = nbsvm.score(docs, nbsvm.fit(docs, labels)).collect()
    assert [r["score"] for r in got] == [0.5] * 4
    assert nbsvm.score(docs.limit(0), nbsvm.fit(docs, labels)).count() == 0


def test_labels_are_bounded_and_repeated_rows_count_once(spark):
    docs = spark.createDataFrame([(k, f"good fine {k}" if k % 2 else f"bad poor {k}") for k in range(200)] * 2, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id bigint, label int")
    once = nbsvm.fit(docs.dropDuplicates(), labels, most=100)
    twice = nbsvm.fit(docs, labels, most=100)
    assert np.array_equal(once.ratio, twice.ratio)
    assert twice.score("good fine 7") > 0.7 > 0.3 > twice.score("bad poor 7")


def test_repeated_labels_count_once(spark):
    """A label row that is repeated a hundred times takes one place of those that the model is fitted on."""
    docs = spark.createDataFrame([(k, f"good fine {k}" if k % 2 else f"bad poor {k}") for k in range(200)], "doc_id bigint, text string")
    rows = [(k, k % 2) for k in range(200)]
    plain = nbsvm.fit(docs, spark.createDataFrame(rows, "doc_id bigint, label int"), most=60)
    least = docs.orderBy(F.xxhash64("doc_id")).first()[0]
    repeated = nbsvm.fit(docs, spark.createDataFrame(rows + [(least, least % 2)] * 100, "doc_id bigint, label int"), most=60)
    assert np.array_equal(plain.ratio, repeated.ratio) and np.array_equal(plain.weights, repeated.weights)
    assert repeated.score("good fine 7") > 0.7 > 0.3 > repeated.score("bad poor 7")


def test_very_long_text(spark):
    assert 0 <= nbsvm.Model(np.zeros(nbsvm.SIZE), np.zeros(nbsvm.SIZE + 1), 1.0, 0.0).score("word other " * 500_000) <= 1
