"""The rule ledger against SQL and a plain count."""

from __future__ import annotations

import re
from collections import Counter

from compare import same
from recscope.llm import rules_ledger
from recscope.llm.queries import ORACLES, QUERIES

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def plain(text: str | None) -> dict:
    text = text or ""
    words = [w for w in WHITE.split(text) if w]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    inside = {k + o for k, w in enumerate(windows) if times[w] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if WHITE.sub("", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
        "base_failed": len(words) < 50 or 100 * len(inside) > 50 * len(words),
    }


TEXTS = [None, "", " \n\t", "a", "a b", "a b c", "a a a a", "a b c a b c", "x\n\nx\n x\n \nx", "#*$ %&|<> é é", "\x1c\x1f a\x85b", "a b c d a b c x a b c", " ".join(map(str, range(80))), "w " * 70, "line one\n" * 30, "ß𝔘 " * 60]


def test_ledger_against_a_plain_count(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "null id"), (3, "a"), (3, "a")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.asDict() for r in QUERIES["op6_quality_rules"](spark, str(tmp_path)).collect()]
    for r in got:
        assert not (r["kept"] and r["base_failed"])
    expected = [{"doc_id": i} | plain(t) for i, t in rows]
    counted = lambda rows: Counter(tuple(sorted((k, v) for k, v in r.items() if k not in ("kept", "failed"))) for r in rows)
    assert counted(got) == counted(expected)
    assert all((r["failed"] & rules_ledger.mask("base") != 0) == r["base_failed"] for r in got)
    same(QUERIES["op6_quality_rules"](spark, str(tmp_path)), ORACLES["op6_quality_rules"], str(tmp_path))


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    same(QUERIES["op6_quality_rules"](spark, sf), ORACLES["op6_quality_rules"], sf)
    same(QUERIES["quality_rule_ablations"](spark, sf), ORACLES["quality_rule_ablations"], sf)


def test_very_long_text(spark):
    text = "one two three " * 200_000
    row = rules_ledger.ledger(spark.createDataFrame([(text,)], "text string")).first()
    assert (row["n_words"], row["n_repeat_words"]) == (600_000, 600_000)


def test_ablations_count_without_the_texts(spark):
    entries = rules_ledger.ledger(spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    bits = [r["failed"] for r in entries.collect()]
    own = rules_ledger.mask("v1")
    for r in rules_ledger.ablations(entries, "v1").collect():
        bit = 1 << rules_ledger.BIT[r["rule"]]
        assert r["n_failed"] == sum(bool(b & bit) for b in bits)
        assert r["n_only"] == sum(b & own == bit for b in bits)
        assert r["n_kept_without"] == sum(b & own & ~bit == 0 for b in bits)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "text string, failed string, n_words string, _words int")
    made = rules_ledger.ledger(df)
    assert made.count() == 0
    assert made.columns.count("failed") == made.columns.count("n_words") == 1
