"""The exact step's joins grow with the texts, not with the square of a group that has much in common."""

from __future__ import annotations

import random

import numpy as np
from test_near_duplicates import found, joined, similar_pairs

from recscope.llm import simhash_ball


def changed(n: int, least: int, most: int) -> dict[int, str]:
    """One text, with changes in ``least`` to ``most`` places: a similarity of about 0.6 for three each."""
    draw = random.Random(7)
    texts = {}
    for k in range(n):
        words = [f"b{j}" for j in range(120)]
        for part in draw.sample(range(12), draw.randrange(least, most + 1)):
            words[10 * part + 5] = f"x{k}y{part}"
        texts[k] = " ".join(words)
    return texts


def most_joined(spark, after: int) -> int:
    """The most rows that a join of an execution after the first ``after`` ones made."""
    store = spark._jsparkSession.sharedState().statusStore()
    most, every = 0, store.executionsList()
    for k in range(after, every.size()):
        execution = every.apply(k).executionId()
        nodes, values = store.planGraph(execution).allNodes(), store.executionMetrics(execution)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size())) if "Join" in node.name() else ():
                value = values.get(metric.accumulatorId())
                if metric.name() == "number of output rows" and value.isDefined():
                    most = max(most, int(value.get().replace(",", "")))
    return most


def test_texts_with_much_in_common_are_not_met_in_all_pairs(spark):
    before = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    texts = changed(200, 3, 3) | {k + 1000: t for k, t in changed(30, 0, 5).items()}
    assert found(spark, texts) == joined(texts, similar_pairs(texts, 5))
    assert 0 < most_joined(spark, before) < 100 * len(texts)


def test_places_in_prefixes_lose_no_similar_pair():
    texts = changed(80, 0, 3)
    own = {i: simhash_ball.shingles(t, 5) for i, t in texts.items()}
    first = {i: simhash_ball.prefix(o, np.zeros(0, np.uint64), np.zeros(0, np.int8)).tolist() for i, o in own.items()}
    pairs = similar_pairs(texts, 5)
    assert pairs
    for a, b in pairs:
        met = next(h for h in first[a] if h in first[b])
        left = min(len(own[a]) - first[a].index(met), len(own[b]) - first[b].index(met))
        assert 18 * left >= 8 * (len(own[a]) + len(own[b]))
