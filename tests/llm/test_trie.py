"""The prefix trie against SQL and against a trie built by hand, with and without collisions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest
from compare import same

from recscope.llm import prefix_trie
from recscope.llm.queries import ORACLES, QUERIES

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert same(QUERIES["op11_conversation_trie"](spark, sf), ORACLES["op11_conversation_trie"], sf) > 300


def brute(rows):
    convs: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            order = [int(digest[k : k + 16], 16) - ((int(digest[k], 16) >= 8) << 64) for k in range(0, 64, 16)]
            convs.setdefault(c, []).append((turn is not None, turn or 0, role, order, text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in convs.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    made = {c: own.get(c - int(math.fmod(c, 20)), [])[: h[c]] + own[c][h[c] :] for c in own}
    members: dict = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    out = []
    for node, own_members in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in below)]
        saved = sum((len(members[m]) - 1) * words(m[-1][1]) for m in below if m)
        ends = ",".join(map(str, sorted(c for c in own_members if len(made[c]) == len(node))))
        out.append((min(own_members), len(node), min(members[node[:-1]]) if node else None, len(own_members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made_rows():
    draw = random.Random(3)
    rows = []
    for c in [*range(0, 70), 400, 407, -3, 100_000_000_019]:
        for k in range(draw.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, draw.choice([None, k, k, 1]), draw.choice(["user", "bot", None]), draw.choice(["hi", "", None, "a b\tc", "a b", "x" * 9000])))
    rows += [(12, 3, "user", "hi")] * 3 + [(None, 1, "user", "hi"), (77, None, None, None)]
    return rows


@pytest.mark.parametrize("moduli", [prefix_trie.MODULI, ((3, 2), (2, 1))])
def test_against_a_trie_by_hand(spark, monkeypatch, moduli):
    rows = made_rows()
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, node int").repartition(5)
    got = prefix_trie.nodes(*prefix_trie.rebuilt(prefix_trie.numbered(df)), moduli=moduli)
    assert got.columns == NAMES
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_long_conversations_and_many_members(spark):
    rows = [(c, k, "user", f"w {k % 7}") for c in (1, 21) for k in range(9001)] + [(c, 0, "user", "same") for c in range(1000, 4000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = {(r["conv_id"], r["depth"]): r for r in prefix_trie.nodes(*prefix_trie.rebuilt(prefix_trie.numbered(df))).collect()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in range(1000, 4000)}
    root = got[(1, 0)]
    assert root["n_convs"] == 3002 and max(d for _, d in got) == 9001
    first = next(r for (c, d), r in got.items() if d == 1 and c >= 1000)
    kept = [c for c in h if h[c] == 0 or c - c % 20 in h]
    assert first["n_convs"] == len(kept) and first["ends_sha256"] == hashlib.sha256(",".join(map(str, sorted(kept))).encode()).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    got = prefix_trie.nodes(*prefix_trie.rebuilt(prefix_trie.numbered(df)))
    assert got.columns == NAMES and not got.collect()
