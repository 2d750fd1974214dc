"""Phrase collocation mining: suffix arrays over word ids, built by prefix doubling.

A text (A-Z in lower case) is split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at spaces and tabs into words. Within each language a
phrase's frequency f is the number of its contiguous occurrences in pieces, overlaps included. Candidates are phrases of
2 to ``LONGEST`` words with f of ``least`` at least; a candidate's score is that of its lowest-scoring cut, floor(2,000,000 a / (l + r)).

A shard is up to ``SHARD`` words of one language in a task: word ids, breaks where no phrase may pass, and the suffix array of
what is left, sorted by the first word, then two, then four (prefix doubling). Runs of its neighbours' common prefixes are the
phrases and their counts (LCP intervals), which are merged by key in three passes over the texts:

1. words: exact counts;
2. pairs of frequent words: counts by 64-bit hash. A hash's count is never below that of a phrase with it, so what it rules out is infrequent;
3. phrases of frequent pairs only: exact counts of all lengths.

Any part of a frequent phrase is frequent, so nothing that counts is left out. Passes hand on what is frequent as a bitmap of hashes, of
16 bits a key and ``BITMAP`` bits at most: beyond that it rules out less, and results stay the same. What is broadcast beside it are words and
phrases that over a thousandth of all rows ask for, which are a thousand at most.

Null texts are empty; a null language is ``und``. Texts without a word, single words and empty tables give no phrase; repeated rows count
each time. Long texts are read in slices, which end between words, and become word ids before they are put together. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recscope.llm.common import bits_for, looked_up, released, remembered, stored, text_or_empty

LONGEST = 4
LEAST = 30
TOP = 2000
#: A candidate goes if a longer one around it has this share (in hundredths) of its occurrences.
COVERED = 80
SCALE = 2_000_000
#: Words of a shard; bits of a bitmap, as a power of two; characters of a slice.
SHARD, BITMAP, SLICE = 1_500_000, 27, 1_000_000
#: Groups that the best phrases of a language are chosen from, step by step.
ROUNDS = (64, 8, 1)
UNKNOWN = "und"

_BREAKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)
_EDGE = re.compile(r"[ \t.,;:!?\n-\r]")


class _Ids(dict):
    """Word -> number from 1; a break is 0."""

    def __init__(self) -> None:
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _slices(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SLICE and (m := _EDGE.search(text, at + SLICE)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def word_ids(text: str, ids: _Ids) -> list[np.ndarray]:
    """The text's words as numbers, with a 0 at each break and at the end."""
    out = []
    for piece in _slices(text):
        words = piece.encode("utf-8", "replace").lower().translate(_BREAKS).replace(b".", b" . ").replace(b"\t", b" ").split(b" ")
        found = np.fromiter((ids[w] for w in words if w), np.int32)
        out.append(found)
    out.append(np.zeros(1, np.int32))
    return out


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order of the keys, and each one's rank from 1 among the distinct ones."""
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def _moved(x: np.ndarray, n: int) -> np.ndarray:
    """What stands ``n`` places on; zeros beyond the end."""
    out = np.zeros_like(x)
    out[: len(x) - n if len(x) > n else 0] = x[n:]
    return out


def intervals(ids: np.ndarray, link: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, first places, counts) of the phrases of d words, for d from 2 to ``longest``.

    ``link``: whether a phrase may go on from a word to the next one (False at the last). Positions that no phrase touches
    are not sorted.
    """
    touched = link.copy()
    touched[1:] |= link[:-1]
    at = np.flatnonzero(touched)
    if not len(at):
        return
    # Links hold between neighbours in ``at`` too: a linked word's next one is touched.
    w, on = ids[at].astype(np.int64), link[at]
    size = int(w.max()) + 1
    order, rank = _ranks(w * size + np.where(on, _moved(w, 1), 0))
    two = on & _moved(on, 1)
    reach = on.astype(np.int8) + two + (two & _moved(on, 2))  # words that follow within a phrase, up to three
    whole = rank
    if longest > 2:
        order, whole = _ranks(rank * (int(rank.max()) + 1) + np.where(two, _moved(rank, 2), 0))
    third = _moved(w, 2)
    a, b = order[:-1], order[1:]
    common = {2: rank[a] == rank[b], 3: (rank[a] == rank[b]) & (third[a] == third[b]), 4: whole[a] == whole[b]}
    for d in range(2, longest + 1):
        has = reach[order] >= d - 1
        # A phrase's suffixes are neighbours, so a run of common prefixes of d words is one phrase.
        first = has.copy()
        first[1:] &= ~(common[d] & has[:-1])
        starts = np.flatnonzero(first)
        if len(starts):
            yield d, at[order[starts]], np.add.reduceat(has.astype(np.int64), starts)


def _hashes(words: list[bytes], lang: str) -> np.ndarray:
    """``xxhash64(lang, word)`` of each word, as Spark has it; that of the break is not used."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = (first * np.uint64(0x9E3779B97F4A7C15)) ^ second
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _in(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _word_counts(lang: str, words: list[bytes], ids: np.ndarray) -> pa.RecordBatch:
    """Each word's count, and a null word with that of all."""
    n = np.bincount(ids, minlength=len(words))[1:]
    values = pa.array([*words[1:], None], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), values, pa.array(np.append(n, n.sum()))], names=["lang", "phrase", "f"])


def _links(lang: str, words: list[bytes], ids: np.ndarray, frequent: np.ndarray, pairs: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of words, whether a word and the next one may be in one phrase)."""
    hashes = _hashes(words, lang)
    known = _in(frequent, hashes)
    known[0] = False
    fits = known[ids]
    link = fits & np.append(fits[1:], False)
    if pairs is not None:
        at = np.flatnonzero(link)
        link[at] = _in(pairs, _paired(hashes[ids[at]], hashes[ids[at + 1]]))
    return hashes, link


def _pair_counts(lang: str, words: list[bytes], ids: np.ndarray, frequent) -> Iterator[pa.RecordBatch]:
    hashes, link = _links(lang, words, ids, frequent.value, None)
    for _, at, n in intervals(ids, link, 2):
        yield pa.RecordBatch.from_arrays([pa.array(_paired(hashes[ids[at]], hashes[ids[at + 1]]).view(np.int64)), pa.array(n)], names=["h", "f"])


def _phrase_counts(lang: str, words: list[bytes], ids: np.ndarray, frequent, pairs) -> Iterator[pa.RecordBatch]:
    _, link = _links(lang, words, ids, frequent.value, pairs.value)
    for d, at, n in intervals(ids, link, LONGEST):
        for k in range(0, len(at), 50_000):
            own = at[k : k + 50_000]
            texts = [b" ".join([words[i] for i in row]) for row in ids[own[:, None] + np.arange(d)].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(np.full(len(own), d, np.int32)), pa.array(n[k : k + 50_000])], names=["lang", "phrase", "d", "f"])


def _by_shard(batches: Iterator[pa.RecordBatch], counted) -> Iterator[pa.RecordBatch]:
    """``counted`` of (language, words, ids) of each shard of (lang, text) rows."""
    remembered("phrase_sa")
    open_: dict[str, tuple[_Ids, list[np.ndarray]]] = {}
    held = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang in list(open_):
            ids, parts = open_.pop(lang)
            out = counted(lang, list(ids), np.concatenate(parts))
            yield from [out] if isinstance(out, pa.RecordBatch) else out

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            name = lang.as_py()
            ids, parts = open_.setdefault(name, (_Ids(), []))
            found = word_ids(text.as_py(), ids)
            parts += found
            held += sum(map(len, found))
            if held >= SHARD:
                yield from flushed()
                held = 0
                released()
    yield from flushed()
    released()


def _bitmap(keys: DataFrame, h: str) -> np.ndarray:
    """The hashes of a stored table as a bitmap of words of 64 bits; its size is bounded by ``BITMAP``."""
    bits = min(BITMAP, bits_for(16 * keys.count(), 1, 10))
    at = keys.select(F.expr(h).bitwiseAND(F.lit((1 << bits) - 1)).alias("at"))
    filled = at.groupBy(F.shiftright("at", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[filled.column(0).to_numpy()] = filled.column(1).to_numpy().view(np.uint64)
    return out


def frequencies(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, d, f) of all words and phrases of up to ``LONGEST`` words that occur ``least`` times, (lang, n)): stored tables."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), text_or_empty(F.col(f"`{text}`")).alias("text"))
    words = texts.mapInArrow(partial(_by_shard, counted=_word_counts), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    words = stored(words.where(F.col("phrase").isNull() | (F.col("f") >= least)), "words")
    frequent = words.where("phrase IS NOT NULL")
    known = sc.broadcast(_bitmap(frequent, "xxhash64(lang, phrase)"))
    pairs = texts.mapInArrow(partial(_by_shard, counted=partial(_pair_counts, frequent=known)), "h long, f long").groupBy("h").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    linked = sc.broadcast(_bitmap(stored(pairs.select("h"), "pairs"), "h"))
    phrases = texts.mapInArrow(partial(_by_shard, counted=partial(_phrase_counts, frequent=known, pairs=linked)), "lang string, phrase string, d int, f long")
    phrases = phrases.groupBy("lang", "phrase").agg(F.first("d").alias("d"), F.sum("f").alias("f")).where(F.col("f") >= least)
    found = stored(frequent.select("lang", "phrase", F.lit(1).alias("d"), "f").union(phrases), "phrases")
    return found, words.where("phrase IS NULL AND f > 0").select("lang", F.col("f").alias("n"))


def _part(words: str, first, count):
    return F.array_join(F.slice(words, first, count), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language."""
    found, totals = frequencies(docs, least, text, lang)
    candidates = found.where("d > 1").withColumn("words", F.split("phrase", " "))
    long = candidates.where("d > 2").select("lang", "words", "d", F.col("f").alias("longer"))
    # A part is given by where it begins and how many words it has; the whole is none.
    inner = F.filter(F.flatten(F.transform(F.sequence(F.lit(2), F.col("d") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("d") - m + 1), lambda k: F.struct(k.alias("k"), m.alias("m"))))), lambda x: x["m"] < F.col("d"))
    around = long.select("lang", "words", "longer", F.explode(inner).alias("x")).select("lang", _part("words", F.col("x.k"), F.col("x.m")).alias("phrase"), "longer")
    around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = "decimal(38,0)"
    kept = candidates.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer").cast(wide) * 100 < F.col("f").cast(wide) * COVERED)).drop("longer")
    kept = stored(kept.select("lang", "phrase", "d", F.col("f").alias("a")), "kept")

    words = F.split("phrase", " ")
    cuts = kept.select("lang", "phrase", "a", words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("d") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part("words", F.lit(1), F.col("k")).alias("first"), _part("words", F.col("k") + 1, F.size("words")).alias("rest"))
    counted = found.select("lang", "phrase", "f")
    cuts = looked_up(stored(cuts, "cuts"), counted.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = looked_up(stored(cuts, "cuts"), counted.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr(f"CAST(a AS DECIMAL(20,0)) * CAST({SCALE} AS DECIMAL(8,0)) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("x"))
    best = worst.select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for groups in ROUNDS:
        window = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(groups))).orderBy(*order)
        best = best.withColumn("rank", F.row_number().over(window).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def oracle_sql(least: int = LEAST, top: int = TOP) -> str:
    """The same in DuckDB SQL."""
    return rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, d, unnest(list_transform(range(1, len(w) - d + 2), lambda i: array_to_string(w[i:i + d - 1], ' '))) AS phrase FROM w, range(1, {LONGEST + 1}) AS x(d) WHERE len(w) >= d),
f AS (SELECT lang, phrase, d, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {least}),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, d, f AS a, string_split(phrase, ' ') AS w FROM f WHERE d > 1),
around AS (SELECT c.lang, array_to_string(w[k:k + m - 1], ' ') AS phrase, max(a) AS longer FROM c, range(2, {LONGEST}) AS y(m), range(1, {LONGEST}) AS z(k) WHERE m < d AND k + m - 1 <= d GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN around USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {COVERED} * a),
cuts AS (SELECT kept.lang, kept.phrase, a, k, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * a // (x.f + y.f))::BIGINT AS score FROM kept, range(1, {LONGEST}) AS z(k),
  f AS x, f AS y WHERE k < kept.d AND x.lang = kept.lang AND y.lang = kept.lang AND x.phrase = array_to_string(w[1:k], ' ') AND y.phrase = array_to_string(w[k + 1:], ' ')),
worst AS (SELECT lang, phrase, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {top}"""
