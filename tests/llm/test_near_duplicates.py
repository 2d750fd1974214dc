"""Near-duplicates by verified balls against the exact similarity of all pairs: no false link, and the recall measured."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from recscope.llm import simhash_ball


def plain_shingles(text: str | None, words: int) -> frozenset:
    parts = (text or "").lower().split()
    return frozenset(tuple(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))) if parts else frozenset()


def similar_pairs(texts: dict[int, str], words: int) -> list[tuple[int, int]]:
    sets = {i: plain_shingles(t, words) for i, t in texts.items()}
    lists = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    common = Counter((a, b) for own in lists.values() for a in own for b in own if a < b)
    out = [(a, b) for (a, b), c in common.items() if 10 * c >= 8 * (len(sets[a]) + len(sets[b]) - c)]
    empty = sorted(i for i, s in sets.items() if not s)
    return out + list(zip(empty, empty[1:], strict=False))


def joined(nodes, pairs) -> dict[int, int]:
    root = {i: i for i in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in nodes}


def made(seed: int, n: int) -> dict[int, str]:
    """Texts with near copies at every distance, some of them under a long common part."""
    draw = random.Random(seed)
    texts: list[str] = ["", "One", "one", "a b c d e f", ""]
    foot = [f"foot{k}" for k in range(60)]
    while len(texts) < n:
        words = [draw.choice("abcdefghij") + str(draw.randrange(300)) for _ in range(draw.randrange(4, 150))]
        words += draw.choice([[], foot])
        for _ in range(draw.randrange(1, 6)):
            own = [draw.choice(["x", "y", w]) if draw.random() < draw.choice([0, 0.01, 0.03]) else w for w in words]
            texts.append(" ".join(own))
    return dict(enumerate(texts))


def found(spark, texts) -> dict[int, int]:
    rows = simhash_ball.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert len(rows) == len(texts)
    return {r["doc_id"]: r["component_id"] for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_and_no_false_links(spark, seed):
    texts = made(seed, 250)
    pairs = similar_pairs(texts, 5)
    exact, got = joined(texts, pairs), found(spark, texts)
    assert all(exact[i] == exact[c] for i, c in got.items())  # never more than the exact components
    assert np.mean([got[a] == got[b] for a, b in pairs]) >= 0.95
    assert got[0] == got[4] == 0 and got[1] == got[2] == 1


def test_recall_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    pairs = similar_pairs(texts, 5)
    exact, got = joined(texts, pairs), found(spark, texts)
    assert all(exact[i] == exact[c] for i, c in got.items())
    assert np.mean([got[a] == got[b] for a, b in pairs]) >= 0.97


def test_copies_that_differ_in_many_bits(spark):
    """Pairs of a similarity of 0.815: one fingerprint of 64 bits within six finds 13 of 100."""
    texts = {}
    for k in range(60):
        words = [f"d{k}w{j}" for j in range(200)]
        texts[2 * k] = " ".join(words)
        for at in (20, 70, 120, 170):
            words[at] = "other"
        texts[2 * k + 1] = " ".join(words)
    got = found(spark, texts)
    assert {got[2 * k] for k in range(60)} == {2 * k for k in range(60)}
    assert np.mean([got[2 * k + 1] == 2 * k for k in range(60)]) >= 0.75


def test_table_prints_are_majorities():
    draw = np.random.default_rng(5)
    for n in (1, 2, 254, 255, 256, 1000):
        own = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
        prints = simhash_ball.table_prints(own)
        for t in (0, simhash_ball.TABLES - 1):
            salt = np.uint64((t + 1) * 0x5851F42D4C957F2D % (1 << 64))
            x = (own ^ salt) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            bits = [int(((x >> np.uint64(b)) & np.uint64(1)).sum()) * 2 > len(own) for b in range(simhash_ball.WIDTH)]
            assert int(prints[t]) == sum(1 << b for b, on in enumerate(bits) if on) + (t << simhash_ball.WIDTH)


def test_shingles_ignore_slices(monkeypatch):
    text = " ".join(f"W{k % 50} x{k % 7}" for k in range(400))
    whole, own = simhash_ball.shingles(text, 5), simhash_ball.fingerprint(text, 4)
    monkeypatch.setattr(simhash_ball, "LONG", 20)
    assert np.array_equal(simhash_ball.shingles(text, 5), whole) and simhash_ball.fingerprint(text, 4) == own
    assert len(whole) == len(plain_shingles(text, 5))


def test_very_long_text_and_nulls(spark):
    long = " ".join(f"w{k}" for k in range(400_000))
    rows = [(None, "same words here"), (None, "same words here"), (4, "same words here"), (7, None), (5, ""), (9, long), (8, long + " end")]
    got = {(r["doc_id"], r["component_id"]) for r in simhash_ball.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(None, 4), (4, 4), (7, 5), (5, 5), (9, 8), (8, 8)}
    assert simhash_ball.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string, set string")).count() == 0
