"""License scans against Dice coefficients computed from their definition."""

from __future__ import annotations

import random
from itertools import pairwise

from recscope.llm import license_dice as ld
from recscope.llm.queries import QUERIES


def dice(a: str, b: str) -> float:
    x, y = set(pairwise(ld.words_of(a))), set(pairwise(ld.words_of(b)))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def test_best_template_is_that_of_all_templates():
    draw = random.Random(4)
    matcher = ld.Matcher(ld.TEMPLATES, 0.8)
    every = [(name, t) for name, texts in ld.TEMPLATES.items() for t in texts]
    for _ in range(200):
        words = draw.choice(every)[1].split()
        for k in range(len(words)):
            if draw.random() < draw.choice([0, 0.02, 0.1]):
                words[k] = draw.choice(["foo", "bar", "the"])
        text = " ".join(words)
        best = max(dice(text, t) for _, t in every)
        got = matcher.compare(ld.words_of(text))
        assert (got is not None) == (best >= 0.8)
        if got:
            assert abs(got[0] - best) < 1e-12
            assert got[1] in {name for name, t in every if abs(dice(text, t) - best) < 1e-12}


def test_every_template_is_found_inside_other_text():
    matcher = ld.Matcher(ld.TEMPLATES, 0.8)
    for name, texts in ld.TEMPLATES.items():
        for t in texts:
            text = f"Some words about nothing at all.\n\n{t}\n\nMore words that are not of any kind of notice."
            found = matcher.scan(text)
            assert name in {f["license"] for f in found}, (name, t)
            assert all(dice(text[f["start"] : f["end"]], u) <= 1 and f["dice"] >= 0.8 for f in found for u in texts)


def test_wrapped_lines_case_and_british_spelling():
    matcher = ld.Matcher(ld.TEMPLATES, 0.8)
    t = ld.TEMPLATES["MIT"][3]
    words = t.upper().replace("LICENSE", "LICENCE").split()
    wrapped = "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))
    assert [f["license"] for f in matcher.scan("Copyright 2020 Somebody\n\n" + wrapped)] == ["MIT"]
    assert matcher.scan("A plain text about software and its use by anyone for any purpose.") == []


def test_query_over_odd_rows(spark, tmp_path):
    mit = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, f"Text. {mit} Text."), (3, f"Text. {mit} Text."), (4, "word"), (None, f"{mit} Licensed under CC BY 4.0."), (5, "x y. " * 20_000 + mit)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op7_license_scans"](spark, str(tmp_path)).collect()), key=str)
    expected = [(1, "", 0, 0.0), (2, "", 0, 0.0), (3, "MIT", 1, 1.0), (3, "MIT", 1, 1.0), (4, "", 0, 0.0), (None, "CC-BY-4.0,MIT", 2, 1.0), (5, "MIT", 1, 1.0)]
    assert got == sorted(expected, key=str)
    assert ld.licenses(spark.createDataFrame([], "text string, licenses int")).count() == 0
