"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND and verification.

The test items are the indexed documents and every training passage is a query. Items are in classes of length, each with an index
and windows of its own: from the longest item down, a class has those of over a quarter of its longest one's words. A passage is a window of words twice
as long as the longest item of a class, at a step of half its length, so each copy of an item lies whole in some window, and a short item is
never asked with the windows of a far longer one. Scores are
BM25 impacts divided by what the item itself would score: 1 means that all of its terms are in the passage. Everything
above the threshold is retrieved; there is no top k.

The index is sparse: postings (item, impact) by term, cut into blocks of neighbouring items with each block's greatest impact.
As in WAND, a passage's terms are ordered by their greatest impact, and the pivot is the first at which the sum reaches a part
of the threshold: an item with terms before the pivot only can't reach it, so only postings of the terms from the pivot on are opened. Their
block maxima, with the greatest impacts of the terms before, bound each block that they name, and only blocks whose bound
reaches the threshold are scored. Passages take these steps in numpy batches, not one after another.

A retrieved pair is verified by overlap: the share of the item's word n-grams that the passage has, for its question
(all but the last sentence) and its answer (the last sentence) separately. Both must reach their least share.

Words are lower-cased and stripped of punctuation at their ends. Null and empty texts, and items without a word, match
nothing; an item of one sentence is question and answer at once. Repeated documents are each reported; repeated item
ids (a null id is one like any other) are reported once for each document, with the best overlap (ties: the best score). Item ids
may be of any type. Extra columns stay; one named like the added column is replaced. A long text is searched in pieces, with four
bytes a word held of the whole.

The index of a shard of items is broadcast. A shard has about ``SHARD_CHARS`` characters at most (some 100 MB of index; a single
longer item is a shard of its own); a larger benchmark takes a pass for each shard over the frame, which is written once, with numbers for its rows;
passes add the numbers of rows with leaks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from recscope.llm.common import cut, released, remembered, stored, text_or_empty, unused

K1, B = 1.2, 0.75
#: Items of a block; passages times blocks, and terms of passages, that are bounded at once; what sums may be off by.
BLOCK_ITEMS, CELLS, TERMS, SLACK = 4, 500_000, 100_000, 1e-5
#: Share of the threshold that terms before the pivot may add up to: at 1 the fewest postings are opened, but bounds are loose.
SPARE = 0.2
SHARD_CHARS = 16_000_000
#: Words that a worker remembers; words scored at once.
REMEMBER, BATCH_WORDS = 100_000, 300_000
ENDS = " .,;:!?\"'()[]{}<>*#$%&|-_/\\+=~`^@…«»„“”‘’¿¡·•"


def words_of(text: str) -> list[str]:
    """Lower-case words without punctuation at their ends; none are empty."""
    return [w for w in (x.strip(ENDS) for x in text.lower().split()) if w]


@dataclass
class Index:
    """One shard of items. ``greatest``: impact by term; postings in blocks: ``block_at`` (by term, where its blocks begin), ``key``
    (term times the number of blocks, plus the block; ascending), ``block_max``, ``item_at`` (where a block's items begin), ``item``,
    ``impact``; and the items' words."""

    terms: dict[str, int]
    ids: list
    n_blocks: int
    greatest: np.ndarray
    block_at: np.ndarray
    key: np.ndarray
    block_max: np.ndarray
    item_at: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    longest: int


def _parts(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer: the last sentence, or all of a single sentence."""
    sentences = [w for s in re.split(r"(?<=[.!?])\s+|\n+", text) if (w := words_of(s))]
    if len(sentences) < 2:
        return sum(sentences, []), sum(sentences, [])
    return sum(sentences[:-1], []), sentences[-1]


def classes(lengths: list[int]) -> list[int]:
    """The longest item's words of each class, the longest first: a class reaches down to over a quarter of its longest."""
    out: list[int] = []
    for n in sorted(lengths, reverse=True):
        if n and (not out or 4 * n <= out[-1]):
            out.append(n)
    return out


def by_length(items: list[tuple[object, str]], frequency: dict[str, int], n_items: int, mean_words: float, tops: list[int]) -> list[Index]:
    """An index for each class of length that has one of ``items``, all with one numbering of terms."""
    terms: dict[str, int] = {}
    groups: dict[int, list] = {}
    for item, text in items:
        words = words_of(text)
        for w in words:
            terms.setdefault(w, len(terms))
        if words:
            groups.setdefault(min(t for t in tops if t >= len(words)), []).append((item, text))
    return [build(own, frequency, n_items, mean_words, longest, terms) for longest, own in sorted(groups.items(), reverse=True)]


def build(items: list[tuple[object, str]], frequency: dict[str, int], n_items: int, mean_words: float, longest: int, terms: dict[str, int] | None = None) -> Index:
    """The index of ``items`` under the whole benchmark's statistics; ``terms``: a numbering that has all of their words."""
    parts = [(i, *_parts(text)) for i, text in items]
    parts = [(i, q, a, q if q == a else q + a) for i, q, a in parts if a]
    # Items that share rare words lie next to each other, so that a block's bounds are close to its items' impacts.
    parts.sort(key=lambda p: min(p[3], key=lambda w: (frequency.get(w, 1), w)))
    terms = {} if terms is None else terms
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for *_, words in parts:
        norm = K1 * (1 - B + B * len(words) / mean_words)
        counts = Counter(words)
        tf = np.fromiter(counts.values(), float, len(counts))
        df = np.array([frequency.get(w, 1) for w in counts], float)
        own = np.log(1 + (n_items - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + norm)
        found.append((np.array([terms.setdefault(w, len(terms)) for w in counts], np.int64), own / own.sum()))
    size = [len(t) for t, _ in found]
    term = np.concatenate([t for t, _ in found]) if found else np.zeros(0, np.int64)
    impact = np.concatenate([x for _, x in found]).astype(np.float32) if found else np.zeros(0, np.float32)
    item = np.repeat(np.arange(len(found), dtype=np.int32), size)
    order = np.lexsort((item, term))
    term, item, impact = term[order], item[order], impact[order]
    n_blocks = max(1, -(-len(parts) // BLOCK_ITEMS))
    key = term * n_blocks + item // BLOCK_ITEMS
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    block_max = np.maximum.reduceat(impact, first) if len(first) else np.zeros(0, np.float32)
    block_at = np.searchsorted(key[first], np.arange(len(terms) + 1) * n_blocks)
    greatest = np.zeros(len(terms), np.float32)
    named = np.flatnonzero(block_at[1:] > block_at[:-1])
    if len(named):
        greatest[named] = np.maximum.reduceat(block_max, block_at[named])
    coded = lambda words: np.array([terms[w] for w in words], np.int32)
    return Index(terms, [p[0] for p in parts], n_blocks, greatest, block_at, key[first], block_max, np.append(first, len(key)), item, impact, [coded(p[1]) for p in parts], [coded(p[2]) for p in parts], longest)


class _Codes(dict):
    """Word as it stands -> term number; -1: not in the index, -2: no word at all."""

    def __init__(self, terms: dict[str, int]) -> None:
        self.terms = terms

    def __missing__(self, word: str) -> int:
        bare = word.strip(ENDS)
        code = self[word] = self.terms.get(bare, -1) if bare else -2
        return code


def _grams(words: np.ndarray, n: int) -> set[bytes]:
    n = min(n, len(words))
    return {words[k : k + n].tobytes() for k in range(len(words) - n + 1)}


def _overlap(part: np.ndarray, passage: np.ndarray, n: int) -> float:
    """Share of the part's n-grams that the passage has."""
    own = _grams(part, n)
    return len(own & _grams_of_size(passage, min(n, len(part)))) / len(own) if own else 0.0


def _grams_of_size(words: np.ndarray, n: int) -> set[bytes]:
    return {words[k : k + n].tobytes() for k in range(len(words) - n + 1)}


def _runs(edges: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of the runs that begin at ``edges`` and have ``size`` members, one run after another."""
    begins = np.cumsum(size) - size
    return np.repeat(edges - begins, size) + np.arange(int(size.sum()))


def _distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def search(index: Index, codes: np.ndarray, starts: np.ndarray, threshold: float) -> list[tuple[int, int, int, int, float]]:
    """(text, from, to, item, score) of all passages above the threshold, in texts whose codes are one after another.

    ``starts``: where each text begins in ``codes``, and the end. A window is two halves. The sum of both halves' greatest impacts
    bounds a window, which rules most out before their terms are put together.
    """
    half, width, least = index.longest, len(index.terms) + 1, threshold - SLACK
    found: list[tuple] = []
    length = np.diff(starts)
    n_halves = -(-length // half)
    first_half = np.concatenate([[0], np.cumsum(n_halves)])
    owner = np.repeat(np.arange(len(length)), length)
    half_of = first_half[owner] + (np.arange(len(codes)) - starts[owner]) // half
    known = (codes >= 0) & (np.append(index.greatest, 0)[codes] > 0)
    key = _distinct(half_of[known] * width + codes[known])
    if not len(key):
        return found
    own, term = key // width, key % width
    edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    # By half: where its terms begin, how many there are, and the sum of their greatest impacts.
    n = int(first_half[-1])
    begin, size, most = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 1)
    begin[own[edges]], size[own[edges]] = edges, np.diff(np.append(edges, len(own)))
    most[own[edges]] = np.add.reduceat(index.greatest[term], edges)
    text_of = np.append(np.repeat(np.arange(len(length)), n_halves), -1)
    follows = text_of[1:] == text_of[:-1]
    live = np.flatnonzero(most[:-1] + most[1:] * follows >= least)
    follow_size = np.where(follows, size[1:], 0)
    lot_of = np.maximum(np.arange(len(live)) // max(1, CELLS // index.n_blocks), np.cumsum(size[live] + follow_size[live]) // TERMS)
    for lot in np.unique(lot_of):
        some = live[lot_of == lot]
        which = np.concatenate([np.repeat(np.arange(len(some)), size[some]), np.repeat(np.arange(len(some)), follow_size[some])])
        terms = np.concatenate([term[_runs(begin[some], size[some])], term[_runs(begin[some + 1], follow_size[some])]])
        pairs = _distinct(which * width + terms)  # a term of both halves counts once
        for w, item, score in _above(index, pairs // width, pairs % width, len(some), threshold, least):
            h = int(some[w])
            text = int(text_of[h])
            start = int(starts[text] + (h - first_half[text]) * half)
            found.append((text, start, min(start + 2 * half, int(starts[text + 1])), item, score))
    return found


def _above(index: Index, which: np.ndarray, terms: np.ndarray, n: int, threshold: float, least: float) -> list[tuple[int, int, float]]:
    """(window, item, score) above the threshold, for windows' distinct terms, in order of ``which``."""
    greatest = index.greatest[terms].astype(float)
    order = np.lexsort((greatest, which))
    sums = np.cumsum(greatest[order])
    count = np.bincount(which, minlength=n)
    at = np.cumsum(count) - count
    before = np.where(at > 0, sums[at - 1], 0.0)
    within = sums - before[which]
    pivoted = within >= SPARE * least
    # What the terms before the pivot can add to any item.
    skipped = np.zeros(n)
    np.maximum.at(skipped, which[~pivoted], within[~pivoted])
    open_, owner = terms[order][pivoted], which[pivoted]
    size = index.block_at[open_ + 1] - index.block_at[open_]
    at_post = _runs(index.block_at[open_], size)
    cell = np.repeat(owner, size) * index.n_blocks + index.key[at_post] % index.n_blocks
    bound = np.bincount(cell, weights=index.block_max[at_post], minlength=n * index.n_blocks)
    bound = bound.reshape(n, index.n_blocks)
    window, block = np.nonzero((bound > 0) & (bound + skipped[:, None] >= least))
    out: list[tuple[int, int, float]] = []
    # Score the blocks that are left: all terms of the window, in pieces of bounded size.
    cost = np.cumsum(count[window])
    for piece in np.unique(cost // TERMS):
        some = np.flatnonzero(cost // TERMS == piece)
        size = count[window[some]]
        pair = np.repeat(np.arange(len(some)), size)
        key = terms[_runs(at[window[some]], size)] * index.n_blocks + block[some][pair]
        place = np.minimum(np.searchsorted(index.key, key), len(index.key) - 1)
        hit = index.key[place] == key
        place, pair = place[hit], pair[hit]
        size = index.item_at[place + 1] - index.item_at[place]
        posts = _runs(index.item_at[place], size)
        scores = np.bincount(np.repeat(pair, size) * BLOCK_ITEMS + index.item[posts] % BLOCK_ITEMS, weights=index.impact[posts], minlength=len(some) * BLOCK_ITEMS)
        for x in np.flatnonzero(scores >= threshold - SLACK).tolist():
            r, k = divmod(x, BLOCK_ITEMS)
            out.append((int(window[some[r]]), int(block[some[r]]) * BLOCK_ITEMS + k, float(scores[x])))
    return out


class _Searched:
    """Pieces of texts that are searched together: cut at half windows of an index, with a half window of overlap."""

    def __init__(self, index: Index, found) -> None:
        self.index, self.found = index, found
        self.long = max(1, BATCH_WORDS // index.longest) * index.longest
        self.lot: list[tuple[int, np.ndarray]] = []
        self.size = 0

    def add(self, t: int, codes: np.ndarray, threshold: float) -> None:
        for at in range(0, max(len(codes) - self.index.longest, 1), self.long):
            self.lot.append((t, codes[at : at + self.long + self.index.longest]))
            self.size += len(self.lot[-1][1])
            if self.size >= BATCH_WORDS:
                self.done(threshold)

    def done(self, threshold: float) -> None:
        if self.lot:
            codes = np.concatenate([c for _, c in self.lot])
            starts = np.concatenate([[0], np.cumsum([len(c) for _, c in self.lot])])
            for piece, begin, end, k, score in search(self.index, codes, starts, threshold):
                self.found(self.index, self.lot[piece][0], codes[begin:end], k, score)
        self.lot, self.size = [], 0


def scan(index: Index | list[Index], texts: list[str | None] | pa.Array, threshold: float, n: int, least_question: float, least_answer: float) -> list[list[dict]]:
    """For each text its verified leaks: item_id, score, question_overlap, answer_overlap. Several indexes have one numbering of terms."""
    indexes = index if isinstance(index, list) else [index]
    lookup = _lookup(indexes[0])
    out: list[list[dict]] = [[] for _ in texts]
    best: dict[tuple[int, object], tuple] = {}

    def verified(own: Index, t: int, passage: np.ndarray, k: int, score: float) -> None:
        question, answer = _overlap(own.questions[k], passage, n), _overlap(own.answers[k], passage, n)
        if question >= least_question and answer >= least_answer:
            key = t, own.ids[k]
            best[key] = max(best.get(key, ()), (question + answer, score, question, answer))

    lots = [_Searched(own, verified) for own in indexes]
    for t, text in enumerate(texts):
        codes = _coded(lookup, (text.as_py() if isinstance(text, pa.Scalar) else text) or "")
        for lot in lots:
            lot.add(t, codes, threshold)
    for lot in lots:
        lot.done(threshold)
    for (text, item), (_, score, question, answer) in sorted(best.items(), key=lambda b: (b[0][0], str(b[0][1]))):
        out[text].append({"item_id": item, "score": score, "question_overlap": question, "answer_overlap": answer})
    return out


def _coded(lookup: _Codes, text: str) -> np.ndarray:
    """A text's words as term numbers, -1 for others."""
    parts = []
    for piece in cut(text.lower()):
        if len(lookup) > REMEMBER:
            lookup.clear()
        codes = np.fromiter(map(lookup.__getitem__, piece.split()), np.int32)
        parts.append(codes[codes > -2])
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _lookup(index: Index) -> _Codes:
    """Codes under an index; a worker keeps those of its last few, and the indexes with them."""
    known = remembered("decontam").setdefault("codes", [])
    for own, codes in known:
        if own is index:
            return codes
    known.insert(0, (index, _Codes(index.terms)))
    del known[4:]
    return known[0][1]


def _marks(index, kind: str, arrow: pa.DataType, threshold: float, n: int, least_question: float, least_answer: float):
    """A function of a text column that finds the leaks of one shard, whose index is broadcast."""

    @F.arrow_udf(kind)
    def marked(texts: pa.Array) -> pa.Array:
        found = pa.array(scan(index.value, texts, threshold, n, least_question, least_answer), arrow)
        released()
        return found

    return marked


def mark(docs: DataFrame, items: DataFrame, threshold: float = 0.5, n: int = 3, least_question: float = 0.6, least_answer: float = 0.6, text: str = "text", out: str = "leaks", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Add ``out``: the test items that ``text`` contains, an array of item_id, score, question_overlap, answer_overlap.

    ``threshold``: least BM25 score relative to the item's own; ``n``: words of an n-gram.
    """
    spark = docs.sparkSession
    split = F.arrow_udf(lambda texts: pa.array([words_of(t or "") for t in texts.to_pylist()], pa.list_(pa.string())), "array<string>")
    own = items.select(F.col(f"`{item_id}`").alias("item"), text_or_empty(F.col(f"`{item_text}`")).alias("body"))
    id_type = own.schema["item"].dataType
    kind = f"array<struct<item_id:{id_type.simpleString()},score:double,question_overlap:double,answer_overlap:double>>"
    arrow = pa.list_(pa.struct([("item_id", to_arrow_type(id_type)), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))
    worded = own.withColumn("words", split("body"))
    n_items, mean_words, lengths, chars = worded.agg(F.count(F.when(F.size("words") > 0, 1)), F.avg(F.when(F.size("words") > 0, F.size("words"))), F.collect_set(F.size("words")), F.sum(F.length("body"))).first()
    if not n_items:
        return docs.withColumn(out, F.array().cast(kind))
    shards = max(1, -(-chars // SHARD_CHARS))
    if shards > 1:
        worded = stored(worded, "items")
    frequency = worded.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    shard_of = F.pmod(F.xxhash64("item", "body"), F.lit(shards))

    def found_in(s: int) -> Column:
        some = worded.where(shard_of == s)
        terms = some.select(F.explode("words").alias("term")).distinct()
        df = dict(map(tuple, (frequency.join(terms, "term") if shards > 1 else frequency).collect()))
        indexes = by_length([tuple(r) for r in some.select("item", "body").collect()], df, n_items, mean_words, classes(lengths))
        if not indexes:
            return F.array().cast(kind)
        return _marks(spark.sparkContext.broadcast(indexes), kind, arrow, threshold, n, least_question, least_answer)(text_or_empty(F.col(f"`{text}`")))

    if shards == 1:
        return docs.withColumn(out, found_in(0))
    row, added = unused(docs, "_row"), unused(docs, "_found")
    docs = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    passes = [stored(docs.select(row, F.lit(s).alias("s"), found_in(s).alias(added)).where(F.size(added) > 0), "leaks") for s in range(shards)]
    each = reduce(DataFrame.union, passes).groupBy(row).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("s", added))), lambda x: x[added])).alias(added))
    return docs.join(each, row, "left").withColumn(out, F.coalesce(added, F.array().cast(kind))).drop(row, added)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id_col, item_id, score, question_overlap, answer_overlap): a row for each pair of document and contained item."""
    marked = mark(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{options.get('text', 'text')}`").alias("text")), items, **options | {"text": "text", "out": "leaks"})
    pairs = marked.select("_id", F.explode("leaks").alias("leak"))
    return pairs.select(F.col("_id").alias(id_col), *[F.col(f"leak.{c}").alias(c) for c in ("item_id", "score", "question_overlap", "answer_overlap")])


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without those that contain a test item."""
    found = unused(docs, "_leaks")
    return mark(docs, items, **options | {"out": found}).where(F.size(found) == 0).drop(found)
