"""Secret scans through a trigram inverted index, in DataFrame functions only.

From every rule's expression a Boolean query over trigrams is derived: a necessary condition on the texts that it can
match. The index has a posting (trigram, text) for each trigram that some query names; texts are known by their hashes. Posting lists are merged by text,
intersected and united as the queries say, which leaves the candidates of each rule; only those are verified with the expression
itself, which also drops a text that only shares a hash. Postings are shuffled, texts are not: the candidates come to them as a bitmap of bounded size. A rule
without a mandatory trigram has no query and scans every text.

Expressions are in the common subset of Java's and RE2's syntax. Matches are leftmost and don't overlap within a rule;
those below the rule's least length are dropped after matching. Spans are in code points, the end exclusive; of one start they are
listed in the order of the rules.

Null and empty texts have no spans. Rows are scanned one by one, so repeated rows each have their own spans. Extra columns stay;
columns named like the added ones are replaced. A text of any length is scanned whole, by Java's expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache, reduce
from itertools import product
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recscope.llm.common import bits_for, stored, text_or_empty, unused


@dataclass(frozen=True)
class Rule:
    """``group``: the part whose length counts; ``least``: its least length in characters."""

    name: str
    pattern: str
    least: int = 0
    group: int = 0


def _either(words: str) -> str:
    """``words`` with each letter in either case."""
    return re.sub(r"[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


_QUOTE, _BLANK = "[\"']?", r"\x20*"
#: In the order in which spans of one start are listed.
RULES: tuple[Rule, ...] = (
    Rule("assign", f"({_either('password|passwd|secret|token|api_?key')}){_QUOTE}{_BLANK}[:=]{_BLANK}{_QUOTE}([A-Za-z0-9+/_.=-]+)", 6, 2),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24,}"),  # the runs of [0-9a-f]+ that have 24 characters: a run is taken whole or not at all
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[sr]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
SPANS = "array<struct<start:int,order:int,end:int,kind:string>>"

#: Literal alternatives carried along while a query is derived, at most.
MOST = 64
#: Trigrams to a word of bits.
WIDTH = 62
#: Bits of the bitmap of candidates, at most, as a power of two; characters of a piece of a text that is masked.
BITMAP, CHUNK = 27, 2048
#: A query: a trigram, True (no condition), or ("and" | "or", frozenset of queries).
Query = str | bool | tuple


def _combine(kind: str, parts: list[Query]) -> Query:
    absorbing, neutral = (False, True) if kind == "and" else (True, False)
    kept = {p for p in parts if p is not neutral}
    if absorbing in {p for p in kept if isinstance(p, bool)}:
        return absorbing
    if not kept:
        return neutral
    return next(iter(kept)) if len(kept) == 1 else (kind, frozenset(kept))


def _of_literals(words: set[str]) -> Query:
    """The condition that a text has one of ``words``."""
    return _combine("or", [_combine("and", [w[k : k + 3] for k in range(len(w) - 2)]) if len(w) > 2 else True for w in words])


def _derive(items) -> tuple[set[str] | None, Query]:
    """Of a parsed sequence: the texts that it matches if they are few (lower case), else None; and its query."""
    done: list[Query] = []
    run = {""}
    exact = True
    for op, arg in items:
        name, own, query = str(op), None, True
        if name == "LITERAL":
            own = {chr(arg).lower()}
        elif name == "IN" and len(arg) <= 8 and all(str(o) == "LITERAL" for o, _ in arg):
            own = {chr(c).lower() for _, c in arg}
        elif name == "SUBPATTERN":
            own, query = _derive(arg[3])
        elif name == "BRANCH":
            each = [_derive(x) for x in arg[1]]
            own = None if any(x is None for x, _ in each) else set().union(*(x for x, _ in each))
            query = _combine("or", [q for _, q in each])
        elif name == "MAX_REPEAT":
            low, high, body = arg
            inner, inner_query = _derive(body)
            if inner is not None and high == 1:
                own = inner | ({""} if low == 0 else set())
            elif inner is not None and low == high and len(inner) == 1:
                own = {next(iter(inner)) * low}
            query = inner_query if low else True
        if own is not None and len(run) * len(own) <= MOST:
            run = {a + b for a, b in product(run, own)}
        else:
            exact = False
            done += [_of_literals(run), query if own is None else True]
            run = {""} if own is None else own
    return (run if exact else None), _combine("and", [*done, _of_literals(run)])


@cache
def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of an expression, over texts in lower case; True: it has no mandatory trigram."""
    return _derive(re._parser.parse(pattern))[1]


def _named(query: Query) -> set[str]:
    if isinstance(query, bool):
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_named, query[1]))


def trigrams(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted(set().union(*(_named(trigram_query(r.pattern)) for r in rules)))


def postings(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "key") -> DataFrame:
    """(trigram, key): the inverted index of ``df`` over the trigrams that the rules' queries name, by number."""
    lower = df.select(F.col(key).alias("key"), F.lower(text_or_empty(F.col(f"`{text}`"))).alias("lower"))
    has = F.array_compact(F.array(*[F.when(F.contains("lower", F.lit(t)), F.lit(k)) for k, t in enumerate(trigrams(rules))]))
    return lower.select("key", F.explode(has).alias("trigram")).select("trigram", "key")


def _satisfied(words: list[Column], rules: tuple[Rule, ...]) -> Column:
    """Bits of the rules whose query a text's postings satisfy; ``words``: bits of its trigrams, ``WIDTH`` to a word."""
    place = {t: divmod(k, WIDTH) for k, t in enumerate(trigrams(rules))}

    def condition(query: Query) -> Column:
        if isinstance(query, str):
            w, bit = place[query]
            return words[w].bitwiseAND(F.lit(1 << bit)) != 0
        return reduce(and_ if query[0] == "and" else or_, map(condition, sorted(query[1], key=str)))

    found = [F.when(condition(q), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(rules) if not isinstance(q := trigram_query(r.pattern), bool)]
    return reduce(lambda a, b: a.bitwiseOR(b), found, F.lit(0)).cast("long")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules): bits of the rules whose query the key's postings satisfy; lists are merged by key."""
    n_words = -(-len(trigrams(rules)) // WIDTH)
    own = lambda w: F.when((F.col("trigram") >= WIDTH * w) & (F.col("trigram") < WIDTH * (w + 1)), F.expr(f"shiftleft(1L, trigram - {WIDTH * w})")).otherwise(F.lit(0).cast("long"))
    met = index.groupBy("key").agg(*[F.bit_or(own(w)).alias(f"w{w}") for w in range(n_words)])
    return met.select("key", _satisfied([F.col(f"w{w}") for w in range(n_words)], rules).alias("rules")).where("rules <> 0")


def candidate_bits(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> tuple[Column, int]:
    """(bitmap, bits of its places): which (text, rule) pairs the inverted index lets through, by hash.

    The index is written once, its lists are merged by key, and what satisfies a rule's query is marked in a bitmap of 16 bits a pair and
    ``2 ** BITMAP`` bits at most. Its value is a subquery of one row. Two pairs with one place are both let through, and verification tells.
    """
    spark = df.sparkSession
    keyed = df.select(F.xxhash64(text_or_empty(F.col(f"`{text}`"))).alias("key"), text_or_empty(F.col(f"`{text}`")).alias("text"))
    found = stored(candidates(stored(postings(keyed, rules), "postings"), rules), "candidates")
    pairs = found.select("key", F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(rules) - 1)), lambda k: F.col("rules").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) != 0)).alias("rule"))
    places = min(BITMAP, bits_for(16 * pairs.count(), 1, 10))
    at = pairs.select(F.xxhash64("key", "rule").bitwiseAND(F.lit((1 << places) - 1)).alias("at"))
    filled = at.groupBy(F.shiftright("at", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("v"))
    words = spark.range(1 << places - 6).join(filled, "id", "left").select("id", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    row = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "v"))), lambda x: x["v"]).alias("bitmap"))
    return stored(row, "bitmap").scalar(), places


def _before(values: Column, combine, zero: int = 0) -> Column:
    """For each number of an array what ``combine`` makes of those before it; in blocks of the root of their number, so that no
    array grows by more than that one by one."""
    start = lambda: F.struct(F.lit(zero).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda s, x: F.struct(combine(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))

    def blocked(v: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda j: F.slice(v, j * size + 1, size))
        return _let(F.transform(blocks, lambda b: F.aggregate(b, start(), step)), joined)

    def joined(each: Column) -> Column:
        starts = F.aggregate(each, start(), lambda s, e: step(s, e["at"]))["out"]
        return F.flatten(F.zip_with(each, starts, lambda e, first: F.transform(e["out"], lambda y: combine(first, y))))

    return _let(values, lambda v: F.when(F.size(v) > 0, blocked(v)).otherwise(F.array().cast("array<bigint>")))


def _spans(body: Column, rule: Rule, order: int) -> Column:
    """The rule's spans in ``body``: the pieces between matches and the matches themselves add up to the places."""
    pattern = F.lit(rule.pattern)

    def placed(m: Column) -> Column:
        between = F.slice(F.split(body, rule.pattern, -1), 1, F.size(m))
        sizes = F.zip_with(m, between, lambda a, b: F.struct(F.length(b).cast("long").alias("b"), F.length(a).cast("long").alias("m")))
        return _let(sizes, lambda z: F.arrays_zip(z.alias("z"), _before(F.transform(z, lambda x: x["b"] + x["m"]), add).alias("at"), F.regexp_extract_all(body, pattern, F.lit(rule.group)).alias("g")))

    def span(p: Column) -> Column:
        begin = p["at"] + p["z"]["b"]
        return F.struct(begin.cast("int").alias("start"), F.lit(order).alias("order"), (begin + p["z"]["m"]).cast("int").alias("end"), F.lit(rule.name).alias("kind"))

    parts = _let(F.regexp_extract_all(body, pattern, F.lit(0)), placed)
    return F.transform(F.filter(parts, lambda p: F.length(p["g"]) >= rule.least), span)


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Add ``found_<rule>``: an array of the rule's spans (start, order, end, kind), for each rule."""
    body = text_or_empty(F.col(f"`{text}`"))
    key = unused(df, "_key")
    bitmap, places = candidate_bits(df, rules, text) if trigrams(rules) else (F.lit(None), 0)
    found = {}
    for k, rule in enumerate(rules):
        if trigram_query(rule.pattern) is True:
            asked = body.rlike(rule.pattern)
        else:
            at = F.xxhash64(F.col(key), F.lit(k)).bitwiseAND(F.lit((1 << places) - 1))
            asked = F.call_function("shiftright", F.get(bitmap, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) != 0
        found[f"found_{rule.name}"] = F.when(asked, _spans(body, rule, k)).otherwise(F.array().cast(SPANS))
    return df.withColumn(key, F.xxhash64(body)).withColumns(found).drop(key)


def written(*found: Column) -> Column:
    """Spans as kind:start:end, by start and then rule, joined by commas."""
    return F.array_join(F.transform(F.sort_array(F.concat(*found)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", by: str = "[SECRET]") -> DataFrame:
    """``text`` with every span replaced by ``by``; of overlapping spans the union is replaced once."""
    own = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)])  # no name of a span's column clashes
    name = {c: f"c{k}" for k, c in enumerate(df.columns)}
    scanned = scan(own, rules, name[text]).withColumn("spans", F.sort_array(F.concat(*[F.col(f"found_{r.name}") for r in rules])))
    body = text_or_empty(F.col(name[text]))

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        """Characters from ``a`` to ``b``, of the chunks that have them."""
        own = F.array_join(F.slice(chunks, F.floor(a / CHUNK).cast("int") + 1, (F.floor((b - 1) / CHUNK) - F.floor(a / CHUNK)).cast("int") + 1), "")
        return F.when(b > a, F.substring(own, (a % CHUNK).cast("int") + 1, (b - a).cast("int"))).otherwise(F.lit(""))

    def cleaned(chunks: Column) -> Column:
        """What lies before each span that begins after all before it have ended, and what lies after the last one."""
        done = _before(F.transform("spans", lambda x: x["end"].cast("long")), F.greatest)
        fresh = F.filter(F.arrays_zip(F.col("spans").alias("s"), done.alias("done")), lambda x: x["s"]["start"] >= x["done"])
        return F.concat(F.array_join(F.transform(fresh, lambda x: F.concat(piece(chunks, x["done"], x["s"]["start"].cast("long")), F.lit(by))), ""), piece(chunks, F.array_max(F.transform("spans", lambda x: x["end"].cast("long"))), F.length(body).cast("long")))

    # In two steps, as each piece is looked for from the beginning of what it is taken from.
    cut = lambda t, size: F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / size).cast("int")), lambda j: F.substring(t, j * size + 1, F.lit(size)))
    clean = _let(F.flatten(F.transform(cut(body, CHUNK * 64), lambda t: cut(t, CHUNK))), cleaned)
    kept = F.when(F.size("spans") > 0, clean).otherwise(F.col(name[text]))
    return scanned.select(*[(kept if c == text else F.col(name[c])).alias(c) for c in df.columns])


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """Counts, digest and spans as DuckDB SQL over ``documents``."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    found = []
    for order, rule in enumerate(rules):
        p = quoted(rule.pattern)
        found.append(
            f"SELECT r, {order} AS o, {quoted(rule.name)} AS kind, "
            "list_sum(list_transform(b[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS s, length(m[k]) AS n FROM "
            f"(SELECT r, m, b, g, unnest(range(1, len(m) + 1)) AS k FROM (SELECT r, regexp_extract_all(text, {p}) AS m, regexp_split_to_array(text, {p}) AS b, regexp_extract_all(text, {p}, {rule.group}) AS g FROM d))"
            f" WHERE length(g[k]) >= {rule.least}"
        )
    line = "kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(found)}),
c AS (SELECT r, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
             string_agg({line}, ',' ORDER BY s, o) FILTER (o < 3) AS base, string_agg({line}, ',' ORDER BY s, o) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN c USING (r)"""
