"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for each text. The ledger keeps what was measured and one bit for each rule that failed;
a policy is a version with a mask of rules, so applying another version, or asking what a rule alone drops, is
bitwise arithmetic on the ledger and doesn't read a text again.

Null and empty texts have no words: they fail the rule on few words, and every ratio of theirs counts as within
bounds. Each row is measured by itself, so repeated rows and ties change nothing. Extra columns stay; a column of the
frame that has the name of a measurement or of ``failed`` is replaced by it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recscope.llm.common import text_or_empty, unused

WHITE = r"\x20\x09-\x0D"

#: Name and condition of failing, by bit; conditions are SQL over the measurements, for Spark and DuckDB alike.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("many_words", "n_words > 1000000"),
    ("short_words", "10 * word_chars < 20 * n_words"),
    ("long_words", "10 * word_chars > 150 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    ("capitals", "100 * n_capitals > 50 * word_chars"),
]
BIT = {name: k for k, (name, _) in enumerate(RULES)}
#: What each version of the policy asks for. ``base`` is the least; a later version never changes an earlier one.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "many_words", "short_words", "long_words", "symbols", "duplicate_lines", "capitals"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")


def mask(policy: str) -> int:
    return reduce(or_, (1 << BIT[name] for name in POLICIES[policy]))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(windows: Column) -> Column:
    """Words inside windows of three that occur twice or more: by sorting windows with their places."""

    def places(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda w, k: (F.get(ordered, k - 1)["h"] == w["h"]) | (F.get(ordered, k + 1)["h"] == w["h"]))
        return F.sort_array(F.transform(twice, lambda w: w["k"]))

    def words(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.get(at, k + 1) - p, F.lit(3))), F.lit(0), lambda a, b: a + b)

    ordered = F.sort_array(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    return let(let(ordered, places), words)


def _of_words(words: Column) -> Column:
    n = F.size(words)
    # A window is known by a 64-bit hash of its three words; only windows of one text are compared.
    windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 3), lambda k: F.xxhash64(F.get(words, k), F.get(words, k + 1), F.get(words, k + 2))))
    repeated = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
    return F.struct(n.cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), repeated.cast("long").alias("n_repeat_words"))


def _of_lines(lines: Column) -> Column:
    n = F.size(lines).cast("long")
    return F.struct(n.alias("n_lines"), (n - F.size(F.array_distinct(lines))).alias("n_dup_lines"))


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements and ``failed``, the bits of the failed rules."""
    body = text_or_empty(F.col(f"`{text}`"))
    left = lambda kept: F.length(F.regexp_replace(body, f"[^{kept}]+", "")).cast("long")
    of_words, of_lines = unused(df, "_words"), unused(df, "_lines")
    measured = df.withColumns(
        {
            of_words: let(F.array_remove(F.split(body, f"[{WHITE}]+"), ""), _of_words),
            of_lines: let(F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{WHITE}]")), _of_lines),
            "n_symbols": left("#*$%&|<>"),
            "n_capitals": left(r"\p{Lu}"),
        }
    )
    measured = measured.withColumns({c: F.col(f"{of_words}.{c}") for c in ("n_words", "word_chars", "n_repeat_words")} | {c: F.col(f"{of_lines}.{c}") for c in ("n_lines", "n_dup_lines")}).drop(of_words, of_lines)
    bits = [F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, condition) in enumerate(RULES)]
    return measured.withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def passes(policy: str, failed: str = "failed") -> Column:
    """Whether a row of the ledger passes a version of the policy."""
    return F.col(failed).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that only it drops, and rows kept without it.

    One pass counts the distinct bit sets (at most 2 to the number of rules); the rest is arithmetic on those.
    """
    counted = entries.select(F.col("failed").bitwiseAND(F.lit(mask(policy))).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << BIT[name]).alias("bit")) for name in POLICIES[policy]]))
    each = counted.withColumn("r", rules).select("bits", "n", "r.rule", "r.bit")
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return each.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_only"),
        total((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"),
    )


def _ledger_sql() -> str:
    """Tables whose last one, ``b``, is the ledger of ``documents`` as DuckDB SQL."""
    bits = " + ".join(f"CASE WHEN {condition} THEN {1 << k} ELSE 0 END" for k, (_, condition) in enumerate(RULES))
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT d.*, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT r, unnest(range(1, len(words) - 1)) AS k, words FROM w),
h AS (SELECT r, k, count(*) OVER (PARTITION BY r, words[k], words[k + 1], words[k + 2]) AS c FROM g),
p AS (SELECT r, count(DISTINCT k + o) AS n FROM h, (SELECT unnest([0, 1, 2]) AS o) WHERE c > 1 GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(list_aggregate(words, 'string_agg', ''))::BIGINT AS chars_, lines,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g'))::BIGINT AS n_capitals,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN p USING (r)),
l AS (SELECT *, coalesce(chars_, 0)::BIGINT AS word_chars FROM m),
b AS (SELECT *, ({bits})::BIGINT AS failed FROM l)"""


def oracle_sql() -> str:
    """The ledger under policy v1 as DuckDB SQL over ``documents``."""
    fails = lambda names: " OR ".join(f"({RULES[BIT[n]][1]})" for n in names)
    return f"""{_ledger_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({fails(POLICIES["base"])}) AS base_failed, NOT ({fails(POLICIES["v1"])}) AS kept, failed FROM b"""


def ablations_sql(policy: str = "v1") -> str:
    """What ``ablations`` counts, as DuckDB SQL over ``documents``."""
    own = mask(policy)
    each = [
        f"SELECT '{name}' AS rule, count(*) FILTER (failed & {bit} <> 0) AS n_failed, count(*) FILTER (failed & {own} = {bit}) AS n_only, count(*) FILTER (failed & {own & ~bit} = 0) AS n_kept_without FROM b"
        for name in POLICIES[policy]
        for bit in [1 << BIT[name]]
    ]
    return f"{_ledger_sql()}\n" + "\nUNION ALL ".join(each)
