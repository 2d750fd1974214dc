"""Secret scans against SQL and plain regular expressions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from compare import same
from recscope.llm import secrets_index as si
from recscope.llm.queries import ORACLES, QUERIES

TEXTS = [
    None,
    "",
    "password = 'hunter22' and Api_Key:\"abcdef123\" then token=short",
    "AKIA" + "Z9" * 8 + " AKIA123 AKIA" + "A" * 30,
    "é🙂 SECRET: abcdef" + " " + "0123456789abcdef" * 2,
    "deadbeef" * 3 + "g" + "a" * 23,
    "x ghp_" + "a1B2" * 10 + " xoxb-1234567890-abc",
    "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END",
    "eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 12,
    "PASSWD:=secretvalue token token: token=abcdefg",
    "passwordpassword=\"'abc'def-ghi\"",
    "sk_live_" + "1234567890abcdef" + " AIza" + "x" * 35,
    "api_key" * 50 + "=" + "q" * 5000,
]


def plain(text: str | None, rules=si.RULES) -> list[tuple]:
    out = []
    for order, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), order, m.end(), rule.name))
    return sorted(out)


def test_spans_against_plain_expressions(spark, tmp_path):
    draw = random.Random(2)
    bits = ["password", "=", ":", " ", '"', "'", "abc123", "token", "AKIA", "ABCDEFGH12", "0a1b2c3d4e5f", "é", "🙂", "\n", "secret", "gh", "p_", "KEY"]
    rows = list(enumerate(TEXTS + ["".join(draw.choices(bits, k=40)) for _ in range(120)])) + [(2, TEXTS[2]), (2, TEXTS[2]), (None, TEXTS[4])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op8_secret_scans"](spark, str(tmp_path)).collect()
    written = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
    expected = []
    for i, t in rows:
        spans = plain(t)
        base = [s for s in spans if s[1] < 3]
        expected.append((i, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
    assert Counter(map(tuple, got)) == Counter(expected)
    same(QUERIES["op8_secret_scans"](spark, str(tmp_path)), ORACLES["op8_secret_scans"], str(tmp_path))


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    same(QUERIES["op8_secret_scans"](spark, sf), ORACLES["op8_secret_scans"], sf)


def holds(query, text: str) -> bool:
    if isinstance(query, bool):
        return query
    if isinstance(query, str):
        return query in text.lower()
    return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])


def test_trigram_queries_are_necessary():
    for rule in si.RULES:
        query = si.trigram_query(rule.pattern)
        for t in TEXTS:
            if t and re.search(rule.pattern, t):
                assert holds(query, t)
    assert si.trigram_query("[0-9a-f]{24,}") is True
    assert si.trigram_query("AKIA[A-Z0-9]+") == ("and", frozenset({"aki", "kia"}))


def test_a_rule_without_trigrams_scans_every_text(spark):
    rules = (si.Rule("number", "[0-9]+", 3),)
    df = spark.createDataFrame([(1, "a 12 345 6789"), (2, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["found_number"]] for r in si.scan(df, (*si.RULES, *rules)).collect()}
    assert got == {1: [(5, 8), (9, 13)], 2: []}


def test_masking_keeps_rows_and_columns(spark):
    columns = "doc_id bigint, text string, found_hex int, _key string, _rules string, spans int"
    rows = [(1, "password=abcdefgh done", 5, "k", "r", 1), (1, "password=abcdefgh done", 5, "k", "r", 1), (2, None, None, None, None, None), (3, "clean text", 1, "", "", 0)]
    got = si.masked(spark.createDataFrame(rows, columns))
    assert got.columns == ["doc_id", "text", "found_hex", "_key", "_rules", "spans"]
    assert Counter(map(tuple, got.collect())) == Counter([(1, "[SECRET] done", *rows[0][2:])] * 2 + rows[2:])
    assert si.masked(spark.createDataFrame([], columns)).count() == 0


def test_the_index_as_a_table_names_the_same_candidates(spark):
    """Postings merged by key against the queries asked of each text; what a rule finds is among its candidates."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "key bigint, text string")
    got = {r["key"]: r["rules"] for r in si.candidates(si.postings(df)).collect()}
    for k, t in enumerate(TEXTS):
        bits = sum(1 << n for n, r in enumerate(si.RULES) if si.trigram_query(r.pattern) is not True and holds(si.trigram_query(r.pattern), t or ""))
        assert got.get(k, 0) == bits
        assert all(bits >> order & 1 for _, order, _, name in plain(t) if name != "hex")


def test_very_long_text(spark):
    text = "word " * 400_000 + "token=abcdef1234"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert [(s["start"], s["end"]) for s in si.scan(df).first()["found_assign"]] == [(2_000_000, 2_000_016)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 16, 17, 400])
def test_running_values(spark, n):
    from pyspark.sql import functions as F

    draw = random.Random(n)
    values = [draw.randrange(100) for _ in range(n)]
    df = spark.createDataFrame([(values,)], "v array<bigint>")
    sums, most = df.select(si._before(F.col("v"), lambda a, b: a + b), si._before(F.col("v"), F.greatest)).first()
    assert sums == [sum(values[:k]) for k in range(n)] and most == [max([0, *values[:k]]) for k in range(n)]


def test_many_matches_take_little_more_than_linear_time(spark):
    import time

    n = 100_000
    text = "".join(f"é token=abcdef{k % 7} AKIA{'Q' * 20}token: x\n" for k in range(n))
    df = spark.createDataFrame([(1, text), (2, "nothing")], "doc_id long, text string").coalesce(1)
    began = time.perf_counter()
    row = si.scan(df).where("doc_id = 1").select("found_assign", "found_access").first()
    found = [(s["start"], s["end"]) for s in row["found_assign"]]
    assert found == [m.span() for m in re.finditer(si.RULES[0].pattern, text) if len(m[2]) >= 6]
    assert len(row["found_access"]) == n
    clean = si.masked(df).where("doc_id = 1").first()["text"]
    assert time.perf_counter() - began < 90
    spans = sorted(found + [(s["start"], s["end"]) for s in row["found_access"]])
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out.append(text[at:a] + "[SECRET]")
        at = max(at, b)
    assert clean == "".join(out) + text[at:]
