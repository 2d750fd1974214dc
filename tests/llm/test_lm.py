"""LM scores: base scores and counts from their definition, a proper distribution, and held-out gain over the base."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from recscope.llm import lm_maxent as lm
from recscope.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text: str | None) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*WORD.findall(lower), "\n"]


def held(i) -> bool:
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def expected(rows) -> dict:
    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, text in rows:
        ts = tokens(text)
        out[i] = (held(i), len(ts), sum(counts[t] > 0 for t in ts), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts))
    return out


def check(got, rows):
    want = expected(rows)
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    for r in got:
        h, n, known, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


@pytest.mark.parametrize("dictionary", [65_536, 300])
def test_query_against_its_definition(spark, monkeypatch, dictionary):
    """With a small dictionary most counts come from the join with the count table."""
    monkeypatch.setattr(lm, "DICTIONARY", dictionary)
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op1_lm_scoring"](spark, sf).collect()
    check(got, rows)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (2, ""), (3, "A a\tÄ a\x1cb\x85 x"), (None, "null"), (5, "w " * 400_000)]
    rows += [(k, f"some words {k} here") for k in range(6, 30)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op1_lm_scoring"](spark, str(tmp_path)).collect()
    check(got, rows)
    assert len({r["score"] for r in got if r["doc_id"] == 2}) == 1


def test_without_training_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in lm.score(docs, docs.limit(0)).collect()}
    assert got[1]["train_tokens"] == 0 and got[1]["n_known"] == 0 and got[1]["base_score"] == 0
    assert got[1]["score"] < got[2]["score"] < 0
    assert lm.score(docs.limit(0), docs).count() == 0


def test_next_token_probabilities_add_up_to_one():
    """Over the dictionary and, within open classes, one share for all unseen tokens."""
    vocabulary = lm.Vocabulary([b"%d" % k for k in range(700)], np.arange(700, 0, -1, dtype=float), 245_350, 700, None)
    reader = lm.Reader(vocabulary)
    numbers, (hashes, classes, members, endings) = np.arange(700), reader.own[:4]
    masses, types = np.zeros((lm.OPEN, lm.MEMBERS)), np.zeros((lm.OPEN, lm.MEMBERS))
    for k in range(512, 700):
        at = classes[k] - lm.CLOSED, members[k] - lm.MEMBERS
        assert at == (lm.open_class(vocabulary.tokens[k]) - lm.CLOSED, lm.group_of(vocabulary.tokens[k]))
        masses[at] += vocabulary.counts[k]
        types[at] += 1
    model = lm.Model.new(vocabulary, masses)
    draw = np.random.default_rng(0)
    model.class_weights += draw.normal(size=model.class_weights.shape).astype(np.float32)
    model.member_weights += draw.normal(size=model.member_weights.shape).astype(np.float32)
    history = lm.histories(np.array([hashes[3], hashes[9], 0], np.uint64), np.array([endings[3], endings[9], 0], np.uint64), np.array([0, 3]))[:, 2:]
    parts = model.log10(np.repeat(history, 700, axis=1), classes[numbers], members[numbers])
    is_open = members >= lm.MEMBERS
    shares = np.log10(masses + types + 1.0)
    parts[is_open] += np.log10(vocabulary.counts[is_open] + 1.0) - shares[classes[is_open] - lm.CLOSED, members[is_open] - lm.MEMBERS]
    total = (10**parts).sum()
    unseen = [float(10 ** (model.log10(history, np.array([lm.CLOSED + k]), np.array([lm.MEMBERS + g]))[0] - shares[k, g])) for k in range(lm.OPEN) for g in range(lm.MEMBERS)]
    assert total + sum(unseen) == pytest.approx(1.0, rel=1e-3)


def test_scores_ignore_pieces(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{j % 7}x{(j * k) % 5}" for j in range(200))) for k in range(1, 9)], "doc_id bigint, text string")
    training = docs.where("doc_id > 2")
    whole = {r["doc_id"]: r for r in lm.score(docs, training).collect()}
    words = [w for ws, _ in lm._words("a b  c\td") for w in ws]
    assert words == [b"a", b"b", b"c", b"d"]
    import pyarrow as pa

    monkeypatch.setattr(lm, "PIECE", 11)
    texts = pa.array([r["text"] for r in docs.collect()])
    [(owners, pieces, before)] = list(lm._in_pieces(texts))
    assert [t for o, p, n in zip(owners, pieces, before, strict=True) if o == 3 for t in p[n:]] == lm.tokens_of(texts[3].as_py())
    assert all(p[:n] == q[-2:] for p, q, n in zip(pieces[1:], pieces, before[1:], strict=False) if n)
    reader = lm.Reader(lm.Vocabulary([b"w1x1", lm.END], np.array([2.0, 1.0]), 3, 2, None))
    numbers, starts, _, (hashes, _, _, endings, _) = reader.read(pieces)
    cut = lm.histories(hashes[numbers], endings[numbers], starts)[:, lm._new(starts, before)]
    numbers, starts, _, (hashes, _, _, endings, _) = reader.read([lm.tokens_of(t.as_py()) for t in texts])
    assert np.array_equal(cut, lm.histories(hashes[numbers], endings[numbers], starts))
    assert all(r["n_tokens"] == 201 for r in whole.values())


def test_many_workers_are_averaged_in_two_steps(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"some words {k % 3} here and there") for k in range(60)], "doc_id bigint, text string").repartition(4)
    once = {r["doc_id"]: r["score"] for r in lm.score(docs, docs).collect()}
    monkeypatch.setattr(lm, "FAN", 2)
    twice = {r["doc_id"]: r["score"] for r in lm.score(docs, docs).collect()}
    assert all(abs(once[k] - twice[k]) < 1e-3 * abs(once[k]) for k in once)
