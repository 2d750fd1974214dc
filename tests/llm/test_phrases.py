"""Collocations against SQL and against counts by brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
from compare import same

from recscope.llm import phrase_sa
from recscope.llm.queries import ORACLES, QUERIES


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert same(QUERIES["op13_phrase_collocations"](spark, sf), ORACLES["op13_phrase_collocations"], sf) > 40


def test_intervals_count_every_linked_phrase():
    draw = random.Random(5)
    for _ in range(300):
        ids = [draw.choice([0, 1, 2, 3]) for _ in range(draw.randrange(1, 30))] + [0]
        link = [bool(a and b) and draw.random() < 0.9 for a, b in zip(ids, ids[1:], strict=False)] + [False]
        expected = Counter(tuple(ids[i : i + d]) for d in (2, 3, 4) for i in range(len(ids) - d + 1) if all(link[i : i + d - 1]))
        got = {tuple(ids[i : i + d]): n for d, at, counts in phrase_sa.intervals(np.array(ids), np.array(link), 4) for i, n in zip(at.tolist(), counts.tolist(), strict=True)}
        assert got == expected


def brute(rows, least, top):
    import re

    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + d]) for d in (1, 2, 3, 4) for i in range(len(w) - d + 1))
    cand = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    out = {}
    for (lang, *w), a in cand.items():
        inside = any(k[0] == lang and len(k) - 1 > len(w) and any(list(k[i : i + len(w)]) == w for i in range(1, len(k))) and 100 * b >= 80 * a for k, b in cand.items())
        if inside:
            continue
        score, k = min((2_000_000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for lang, v in out.items() for r, (s, a, p, x, y) in enumerate(sorted(v)[:top]))


def test_edges_ties_and_shards(spark, monkeypatch):
    draw = random.Random(1)
    words = ["A", "b", "cé", "d\x1ce", "", "\t", "x\x00", "."]
    rows = [(draw.choice(["en", None, "und", "En"]), " ".join(draw.choice(words) + draw.choice(["", "", ",", "!\n", "?"]) for _ in range(draw.randrange(40)))) for _ in range(120)]
    rows += [("en", None), (None, ""), ("fr", "..."), ("fr", "one"), ("de", "so it goes " * 40)] + [("es", "una vez")] * 7
    df = spark.createDataFrame([(lang, t, "x", 1) for lang, t in rows], "lang string, text string, f string, phrase int").repartition(3)
    monkeypatch.setattr(phrase_sa, "SLICE", 17)
    got = sorted(map(tuple, phrase_sa.collocations(df, least=5, top=20).collect()))
    assert got == brute(rows, 5, 20) and {"en", "und", "de", "es"} <= {g[0] for g in got}


def test_empty_table_and_columns(spark):
    got = phrase_sa.collocations(spark.createDataFrame([], "lang string, text string"))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and not got.collect()
