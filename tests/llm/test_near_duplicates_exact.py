"""No similar pair is left in two components, however far its fingerprints are."""

from __future__ import annotations

import numpy as np
import pytest
from test_near_duplicates import found, joined, made, plain_shingles, similar_pairs

from recscope.llm import simhash_ball


def at_the_threshold() -> dict[int, str]:
    """Pairs of a similarity of 0.815, whose fingerprints are far apart for one in five."""
    texts = {}
    for k in range(60):
        words = [f"d{k}w{j}" for j in range(200)]
        texts[2 * k] = " ".join(words)
        for at in (20, 70, 120, 170):
            words[at] = "other"
        texts[2 * k + 1] = " ".join(words)
    return texts


def test_pairs_far_in_all_fingerprints_are_found(spark):
    got = found(spark, at_the_threshold())
    assert got == {i: i // 2 * 2 for i in got}


@pytest.mark.parametrize("seed", [1, 5])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(simhash_ball, "TOGETHER", 7)  # hashes of many sets are dealt
    texts = made(seed, 250)
    assert found(spark, texts) == joined(texts, similar_pairs(texts, 5))


def test_prefixes_of_similar_sets_meet():
    texts = made(3, 200)
    own = {i: simhash_ball.shingles(t, 5) for i, t in texts.items()}
    assert all(len(own[i]) == len(plain_shingles(t, 5)) for i, t in texts.items())
    every, n = np.unique(np.concatenate(list(own.values())), return_counts=True)
    for common in (every[:0], every[n > 5]):
        first = {i: set(simhash_ball.prefix(o, common, np.ceil(np.log2(n[n > 5] + 1)).astype(np.int8)).tolist()) for i, o in own.items()}
        assert all(first[a] & first[b] for a, b in similar_pairs(texts, 5) if len(own[a]))
        assert sum(map(len, first.values())) < 0.3 * sum(map(len, own.values()))
