"""Fingerprints and components against brute force over all pairs."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest
import xxhash

from recscope.llm import simhash_ball
from recscope.llm.queries import QUERIES


def plain_fingerprint(text: str, words: int) -> int:
    parts = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for white in "\t\n\x0b\x0c\r":
        parts = parts.replace(white, " ")
    parts = [w for w in parts.split(" ") if w]
    if not parts:
        return 0
    shingles = [" ".join(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows: list[tuple[int, int]], radius: int) -> dict[int, int]:
    root = {p: p for _, p in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(list(root), 2):
        if (a ^ b).bit_count() <= radius:
            root[top(a)] = top(b)
    least: dict[int, int] = {}
    for i, p in rows:
        least[top(p)] = min(least.get(top(p), i), i)
    return {p: least[top(p)] for p in root}


@pytest.mark.parametrize("words", [4, 5])
def test_fingerprint(words):
    draw = random.Random(1)
    texts = ["", "  \n", "One", "a b c", "A b c d\te\x0bf", "É x Y z É x Y z É x Y z"]
    texts += [" ".join(draw.choices(["The", "cat", "sat", "Äh", "on", "1"], k=draw.randrange(1, 60))) for _ in range(60)]
    for t in texts:
        assert simhash_ball.fingerprint(t, words) % (1 << 64) == plain_fingerprint(t, words)


def near(draw: random.Random, n: int) -> list[int]:
    """Fingerprints in chains and clusters: some within the radius of each other, some just outside."""
    out = [draw.getrandbits(64) for _ in range(n // 3)]
    while len(out) < n:
        x = draw.choice(out)
        for b in draw.sample(range(64), draw.choice([1, 2, 3, 4, 4, 5, 6])):
            x ^= 1 << b
        out.append(x)
    return out + [0, 1, (1 << 64) - 1, 1 << 63]


@pytest.mark.parametrize(("n", "seed", "bucket", "hot", "radius"), [(150, 1, 1000, 2, 4), (400, 2, 4, 2, 4), (300, 3, 2, 1, 4), (60, 4, 16, 1, 6)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, n, seed, bucket, hot, radius):
    monkeypatch.setattr(simhash_ball, "PER_BUCKET", bucket)
    monkeypatch.setattr(simhash_ball, "HOT", hot)
    draw = random.Random(seed)
    rows = list(enumerate(near(draw, n)))
    rows += [(1000 + k, draw.choice(rows)[1]) for k in range(20)]
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in rows]
    got = simhash_ball.components(spark.createDataFrame(signed, "doc_id bigint, fingerprint bigint"), radius).collect()
    expected = plain_components(rows, radius)
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((i, expected[p]) for i, p in rows)


def test_query_over_odd_rows(spark, tmp_path):
    long = " ".join(f"word{k}" for k in range(3000))
    rows = [(5, None), (3, ""), (7, "one two"), (8, "ONE\ttwo"), (9, long), (10, long + " more"), (10, long + " more"), (11, "completely different words are here now")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op9_simhash_near_dedup"](spark, str(tmp_path)).collect()
    prints = [(i, plain_fingerprint(t or "", 4)) for i, t in rows]
    least = plain_components(prints, 4)
    assert Counter(map(tuple, got)) == Counter((i, f"{p:016x}", least[p]) for i, p in prints)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, fingerprint bigint")
    assert simhash_ball.components(df).count() == 0


def test_null_id_names_a_component_only_alone(spark):
    df = spark.createDataFrame([(None, 5), (4, 7), (None, -1)], "doc_id bigint, fingerprint bigint")
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash_ball.components(df).collect()}
    assert got == {(None, 5): 4, (4, 7): 4, (None, -1): None}


@pytest.mark.parametrize("kept_bits", [3, 9, 20])
def test_variants_that_share_a_hash_lose_no_link(monkeypatch, kept_bits):
    """With hashes of a few bits most chains run through strangers."""
    import numpy as np

    monkeypatch.setattr(simhash_ball, "_MIX", np.uint64((1 << (64 - kept_bits)) | 0) if kept_bits < 64 else np.uint64(1))
    monkeypatch.setattr(simhash_ball, "SLICE", 50_000)
    draw = random.Random(9)
    prints = np.unique(np.array([p & 0xFFFF for p in near(draw, 60)], np.uint64))
    a, b = simhash_ball._meet(prints, np.zeros(len(prints), np.int8), 16, 2, 4)
    got = plain_components(list(enumerate(prints.tolist())), 4)
    root = dict(zip(a.tolist(), b.tolist(), strict=True))
    ends = {p: root.get(p, p) for p in prints.tolist()}
    groups = lambda of: Counter(frozenset(p for p in of if of[p] == r) for r in set(of.values()))
    assert groups(ends) == groups(got)
