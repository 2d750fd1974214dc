"""Decontamination against a brute-force search of every passage by every item."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from recscope.llm import decontam
from recscope.llm.queries import QUERIES

WORDS = [f"w{k}" for k in range(400)]


def plain(docs: list[tuple[int, str]], items: list[tuple[int, str]], threshold=0.5, n=3, least=0.6) -> set[tuple[int, int]]:
    words = {i: decontam.words_of(t) for i, t in items}
    words = {i: w for i, w in words.items() if w}
    total, mean = len(words), sum(map(len, words.values())) / len(words)
    frequency = Counter(w for ws in words.values() for w in set(ws))
    # Windows are those of an item's class of length: from the longest item down to over a quarter of its words, and so on.
    tops: list[int] = []
    for size in sorted(map(len, words.values()), reverse=True):
        if not tops or size <= tops[-1] / 4:
            tops.append(size)

    def impacts(ws):
        norm = 1.2 * (0.25 + 0.75 * len(ws) / mean)
        each = {w: math.log(1 + (total - frequency[w] + 0.5) / (frequency[w] + 0.5)) * c * 2.2 / (c + norm) for w, c in Counter(ws).items()}
        whole = sum(each.values())
        return {w: x / whole for w, x in each.items()}

    def grams(ws, size):
        return {tuple(ws[k : k + size]) for k in range(len(ws) - size + 1)}

    def overlap(part, passage):
        size = min(n, len(part))
        own = grams(part, size)
        return len(own & grams(passage, size)) / len(own)

    found = set()
    for d, text in docs:
        ws = decontam.words_of(text or "")
        for longest, at in [(t, at) for t in tops for at in range(0, max(len(ws), 1), t)]:
            passage = ws[at : at + 2 * longest]
            for (i, body) in items:
                if i not in words or min(t for t in tops if t >= len(words[i])) != longest:
                    continue
                score = sum(x for w, x in impacts(words[i]).items() if w in set(passage))
                question, answer = decontam._parts(body)
                if score >= threshold - 1e-6 and overlap(question, passage) >= least and overlap(answer, passage) >= least:
                    found.add((d, i))
    return found


def made(seed: int) -> tuple[list, list]:
    draw = random.Random(seed)
    sentence = lambda k: " ".join(draw.choices(WORDS, k=k)).capitalize() + "."
    items = [(k, " ".join(sentence(draw.randrange(4, 14)) for _ in range(draw.randrange(1, 4)))) for k in range(45)]
    items += [(90, ""), (91, "...")]
    docs: list[tuple[int, str | None]] = [(k, " ".join(sentence(9) for _ in range(draw.randrange(0, 12)))) for k in range(40)]
    for k in range(60):
        body = draw.choice(items[:45])[1].split()
        for at in range(len(body)):
            if draw.random() < draw.choice([0, 0.05, 0.2]):
                body[at] = draw.choice(WORDS)
        docs.append((100 + k, sentence(draw.randrange(1, 40)) + " " + " ".join(body) + " " + sentence(draw.randrange(1, 40))))
    return docs + [(900, None), (901, ""), (902, docs[60][1]), (902, docs[60][1])], items


@pytest.mark.parametrize(("seed", "shard"), [(1, 16_000_000), (2, 1_000)])
def test_pairs_are_those_of_brute_force(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(decontam, "SHARD_CHARS", shard)
    docs, items = made(seed)
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontam.leaks(d, i).collect()]
    expected = plain(docs, items)
    assert set(got) == expected and len(expected) > 20
    assert Counter(got)[(902, next(iter(i for x, i in expected if x == 902), -1))] in (0, 2)
    kept = Counter(r["doc_id"] for r in decontam.clean(d, i).collect())
    assert kept == Counter(x for x, _ in docs if x not in {a for a, _ in expected})


def test_block_bounds_never_lose_an_item():
    docs, items = made(3)
    words = [w for _, t in items if (w := decontam.words_of(t))]
    frequency = Counter(w for ws in words for w in set(ws))
    index = decontam.build(items, frequency, len(words), sum(map(len, words)) / len(words), max(map(len, words)))
    dense = np.zeros((len(index.terms), len(index.ids)), np.float32)
    for p, (a, b) in enumerate(zip(index.item_at, index.item_at[1:], strict=False)):
        term = index.key[p] // index.n_blocks
        assert all(index.item[a:b] // decontam.BLOCK_ITEMS == index.key[p] % index.n_blocks)
        assert index.block_max[p] == index.impact[a:b].max()
        dense[term, index.item[a:b]] = index.impact[a:b]
    assert np.array_equal(index.greatest, dense.max(axis=1)) and np.allclose(dense.sum(axis=0), 1)


@pytest.mark.parametrize("cells", [60, 4_000_000])
def test_search_retrieves_all_above_the_threshold(monkeypatch, cells):
    """The pruned search against the scores of all windows by all items."""
    monkeypatch.setattr(decontam, "CELLS", cells)
    monkeypatch.setattr(decontam, "TERMS", cells * 20)
    docs, items = made(5)
    words = [w for _, t in items if (w := decontam.words_of(t))]
    frequency = Counter(w for ws in words for w in set(ws))
    index = decontam.build(items, frequency, len(words), sum(map(len, words)) / len(words), max(map(len, words)))
    codes = [decontam._coded(decontam._Codes(index.terms), t or "") for _, t in docs]
    starts = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
    got = {(t, a, k): s for t, a, _, k, s in decontam.search(index, np.concatenate(codes), starts, 0.3)}
    dense = np.zeros((len(index.terms), len(index.ids)))
    for p, (a, b) in enumerate(zip(index.item_at, index.item_at[1:], strict=False)):
        dense[index.key[p] // index.n_blocks, index.item[a:b]] = index.impact[a:b]
    expected = {}
    for t, c in enumerate(codes):
        for at in range(0, len(c), index.longest):
            passage = np.unique(c[at : at + 2 * index.longest])
            scores = dense[passage[passage >= 0]].sum(axis=0)
            expected |= {(t, starts[t] + at, k): scores[k] for k in np.flatnonzero(scores >= 0.3)}
    assert got.keys() == expected.keys() and len(got) > 50
    assert all(abs(got[k] - expected[k]) < 1e-5 for k in got)


def test_index_of_many_items_is_small():
    """20,000 items of some 30 words: the index takes a few tens of megabytes, and a search stays exact."""
    draw = random.Random(7)
    items = [(k, " ".join(f"t{int(draw.paretovariate(0.4)) % 50_000}" for _ in range(30)) + ".") for k in range(20_000)]
    words = [decontam.words_of(t) for _, t in items]
    frequency = Counter(w for ws in words for w in set(ws))
    index = decontam.build(items, frequency, len(words), 30.0, 30)
    arrays = (index.greatest, index.block_at, index.key, index.block_max, index.item_at, index.item, index.impact, *index.questions, *index.answers)
    assert sum(a.nbytes for a in arrays) < 40_000_000
    texts = [f"some words {items[k][1]} and others" for k in range(0, 20_000, 200)]
    found = decontam.scan(index, texts, 0.5, 3, 0.6, 0.6)
    assert all(k in [x["item_id"] for x in f] for k, f in zip(range(0, 20_000, 200), found, strict=True))


def test_long_text_is_searched_in_pieces(monkeypatch):
    docs, items = made(6)
    words = [w for _, t in items if (w := decontam.words_of(t))]
    frequency = Counter(w for ws in words for w in set(ws))
    index = decontam.build(items, frequency, len(words), sum(map(len, words)) / len(words), max(map(len, words)))
    text = " ".join(t or "" for _, t in docs)
    whole = decontam.scan(index, [text], 0.5, 3, 0.6, 0.6)
    monkeypatch.setattr(decontam, "BATCH_WORDS", 100)
    assert decontam.scan(index, [text], 0.5, 3, 0.6, 0.6) == whole and len(whole[0]) > 5
    assert decontam.scan(index, ["word " * 500_000], 0.5, 3, 0.6, 0.6) == [[]]


def test_whole_benchmark_passages_are_found_and_clean_documents_are_not(spark, tmp_path):
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [(r["item_id"], r["text"]) for r in items.collect()]
    filler = " ".join(["the of and th in er on"] * 30)
    rows = [(k, f"{filler}. {t} {filler}") for k, t in texts] + [(10_000, filler), (10_001, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op3_decontamination"](spark, str(tmp_path)).collect()}
    assert {(k, k) for k, _ in texts} <= got
    assert not {d for d, _ in got} & {10_000, 10_001}


def test_empty_sides_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 3)], "doc_id bigint, text string, leaks string, _leaks int")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.clean(docs, none).collect() == docs.collect()
    items = spark.createDataFrame([(None, "a b c"), (7, None)], "item_id bigint, text string")
    assert [r["item_id"] for r in decontam.leaks(docs, items).collect()] == [None]
    named = spark.createDataFrame([("q/1", "a b c")], "item_id string, text string")
    assert [r["item_id"] for r in decontam.leaks(docs, named).collect()] == ["q/1"]
    assert decontam.clean(docs, items).count() == 0
    assert decontam.clean(docs.limit(0), items).columns == docs.columns


def test_one_long_item_costs_short_ones_little():
    """A thousand words among items of thirty: short items keep their windows."""
    import time

    draw = random.Random(4)
    vocabulary = [f"v{k}" for k in range(3000)]
    items = [(k, " ".join(draw.choices(vocabulary, k=30))) for k in range(2000)]
    long = [(5000, " ".join(draw.choices(vocabulary, k=1000)))]
    text = " ".join(draw.choices(vocabulary, k=100_000)) + " " + items[7][1] + " " + " ".join(draw.choices(vocabulary, k=100_000)) + " " + long[0][1]

    def took(own):
        words = [decontam.words_of(t) for _, t in own]
        frequency = Counter(w for ws in words for w in set(ws))
        tops = decontam.classes([len(w) for w in words])
        indexes = decontam.by_length(own, frequency, len(own), sum(map(len, words)) / len(words), tops)
        decontam.scan(indexes, ["warm"], 0.5, 3, 0.6, 0.6)
        began = time.perf_counter()
        found = decontam.scan(indexes, [text], 0.5, 3, 0.6, 0.6)
        return time.perf_counter() - began, {f["item_id"] for f in found[0]}

    without, found = took(items)
    assert found == {7}
    with_long, found = took(items + long)
    assert found == {7, 5000} and with_long < 2 * without + 0.5


def test_classes():
    assert decontam.classes([30, 30, 8, 7, 1000, 250, 251, 0]) == [1000, 250, 30, 7]
