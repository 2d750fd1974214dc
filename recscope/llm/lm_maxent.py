"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

A token's probability given its history is P(class | history) P(member | class, history), and both factors are softmaxes over hashed
features of the history: the last token, the last two, the one before the last (a skip), and the last token's ending. The ``SHORT`` most
frequent tokens are dealt to closed classes of ``MEMBERS`` tokens: there a member is a token. All other tokens are
in open classes by a hash of their own ending, and a member is one of ``MEMBERS`` groups of tokens by a hash of the whole token (told
from the last token and the skip alone); within its group a token has its smoothed share of the training tokens, with one share for
all unseen tokens of the group. So the model is a distribution over texts in which the unseen words of a group count as one token.

Training: token counts over all training texts give vocabulary, classes and shares. Then every training text is seen
once: in each of ``ROUNDS`` rounds, workers start from the broadcast weights, make mini-batch gradient steps over their
share of the texts, and return their weights in blocks; the blocks are averaged (by groups of ``FAN`` workers first), each row by the
number of times that the workers met its feature. The weight table of the members grows with the training tokens up to a bound, as it
is broadcast; what else is gathered, the token counts, is a table that is joined and never collected (but for the
``DICTIONARY`` most frequent tokens). A worker trains on some ``SHARE`` tokens at most where the input has as many partitions.

Scoring: texts are scored in sparse numpy batches against the broadcast weights. Counts of tokens outside of the
dictionary come from a join of (row, token) with the count table.

Long texts are read in pieces of ``PIECE`` words, each with the two tokens before it. Null and empty texts are one end token. Texts are scored row by row, so repeated rows have equal scores; ties in frequency are
broken by the token's bytes. Without training texts all counts are 0 and the softmaxes are uniform. The result has the id
column and this operator's columns; no other column of the frame is read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recscope.llm.common import cut, kept_memory, remembered, stored, text_or_empty

END = b"\n"
CLOSED, OPEN, MEMBERS = 16, 16, 32
CLASSES, SHORT = CLOSED + OPEN, CLOSED * MEMBERS
#: Rows of the two weight tables, as powers of two (the members': from the least, a row for ``PER_ROW`` training tokens, to the most);
#: rows of a block of them.
CLASS_BITS, LEAST_BITS, MOST_BITS, PER_ROW, BLOCK = 14, 12, 16, 8, 1024
#: Features that tell the groups of open classes: the last token and the skip.
OF_GROUPS = (0, 2)
#: Most frequent tokens that are broadcast with their counts, at most.
DICTIONARY = 65_536
#: Rounds of training; tokens of a worker; workers that are averaged at once; tokens of a mini-batch; step size.
ROUNDS, SHARE, FAN, BATCH, RATE = 2, 100_000_000, 256, 16_384, 0.3
#: Rows of weights that are worked on at once, so that they stay in the processor's cache.
CACHED = 2_048
#: Distinct tokens counted before they are sent on; words of texts that are scored at once.
COUNTED, PIECE = 400_000, 300_000
N_FEATURES = 4
_ONES = np.ones(max(CLASSES, MEMBERS), np.float32)
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def tokens_of(text: str) -> list[bytes]:
    """Words with ASCII letters in lower case, then the end."""
    words = text.encode().lower().split()
    words.append(END)
    return words


def open_class(token: bytes) -> int:
    return CLOSED + zlib.crc32(token[-2:]) % OPEN


def group_of(token: bytes) -> int:
    """The member of an open class that a token belongs to."""
    return (zlib.crc32(token) >> 8) % MEMBERS


@dataclass
class Vocabulary:
    """``tokens``: the most frequent, by falling count, the end among the first ``SHORT``; ``shares``: log10 of the
    denominators of the open classes' groups."""

    tokens: list[bytes]
    counts: np.ndarray
    n_tokens: int
    n_types: int
    shares: np.ndarray


class Reader(dict):
    """Token -> number: of the dictionary, and from there on of the other tokens of the current batch."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__((t, k) for k, t in enumerate(vocabulary.tokens))
        self.own = self._attributes(vocabulary.tokens)
        short = min(SHORT, len(vocabulary.tokens))
        self.own[1][:short] = np.arange(short) // MEMBERS
        self.own[2][:short] = np.arange(short) % MEMBERS
        self.own[4][:] = np.log10(vocabulary.counts + 1.0)
        self.size = len(vocabulary.tokens)
        self.tail: list[bytes] = []

    @staticmethod
    def _attributes(tokens: list[bytes]) -> list[np.ndarray]:
        """Hash, class, member (from ``MEMBERS`` on: a group of an open class), ending and log10(count + 1)."""
        crc = zlib.crc32
        ending, whole = np.array([crc(t[-2:]) for t in tokens], np.uint64), np.array([crc(t) for t in tokens], np.uint64)
        group = MEMBERS + ((whole >> np.uint64(8)) % np.uint64(MEMBERS)).astype(np.int64)
        return [whole, CLOSED + (ending % np.uint64(OPEN)).astype(np.int64), group, ending, np.zeros(len(tokens))]

    def __missing__(self, token: bytes) -> int:
        number = self[token] = self.size + len(self.tail)
        self.tail.append(token)
        return number

    def read(self, pieces: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes], list[np.ndarray]]:
        """Numbers of all tokens, where each piece begins and the end, the other tokens, and attributes by number."""
        starts = np.concatenate([[0], np.cumsum([len(s) for s in pieces])])
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(pieces)), np.int64, int(starts[-1]))
        tail, self.tail = self.tail, []
        for t in tail:
            del self[t]
        every = [np.concatenate(pair) for pair in zip(self.own, self._attributes(tail), strict=True)] if tail else self.own
        return numbers, starts, tail, every


def histories(hashes: np.ndarray, endings: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Feature hashes of each position's history, one row for each kind of feature."""
    before = np.full(len(hashes), 7, np.uint64)
    ending = np.full(len(hashes), 7, np.uint64)
    skip = np.full(len(hashes), 11, np.uint64)
    before[1:], ending[1:], skip[2:] = hashes[:-1], endings[:-1], hashes[:-2]
    first = starts[:-1]
    before[first], ending[first], skip[first] = 7, 7, 11
    second = (first + 1)[np.diff(starts) > 1]
    skip[second] = 11
    return np.stack([before + np.uint64(1 << 33), (before << np.uint64(17)) ^ skip ^ np.uint64(1 << 50), skip + np.uint64(1 << 34), ending + np.uint64(1 << 35)]) * _SALTS[:, None]


def _rows(hashes: np.ndarray, bits: int) -> np.ndarray:
    mixed = hashes ^ (hashes >> np.uint64(31))
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.uint16)  # sorted by radix


@dataclass
class Model:
    class_bias: np.ndarray
    member_bias: np.ndarray
    class_weights: np.ndarray
    member_weights: np.ndarray

    @classmethod
    def new(cls, vocabulary: Vocabulary, open_counts: np.ndarray) -> Model:
        """Weights of zero; the biases give each class and member its share of the training tokens.

        ``open_counts``: training tokens by open class and group."""
        short = np.zeros(SHORT)
        own = vocabulary.counts[:SHORT]
        short[: len(own)] = own
        short = short.reshape(CLOSED, MEMBERS)
        present = np.zeros(SHORT, bool)
        present[: len(own)] = True
        closed = np.where(present.reshape(CLOSED, MEMBERS), np.log(short + 1.0), -40.0)
        member = np.concatenate([closed, np.log(open_counts + 1.0)]).astype(np.float32)
        masses = np.concatenate([short.sum(axis=1), open_counts.sum(axis=1)]) + 1.0
        empty = np.concatenate([~present.reshape(CLOSED, MEMBERS).any(axis=1), np.zeros(OPEN, bool)])
        bias = np.where(empty, -30.0, np.log(masses / masses.sum())).astype(np.float32)
        member -= member.max(axis=1, keepdims=True)
        bits = min(max(int(vocabulary.n_tokens // PER_ROW).bit_length(), LEAST_BITS), MOST_BITS)
        return cls(bias, member, np.zeros((1 << CLASS_BITS, CLASSES), np.float32), np.zeros((1 << bits, MEMBERS), np.float32))

    def factors(self, features: np.ndarray, classes: np.ndarray, members: np.ndarray) -> Iterator[tuple]:
        """For each factor: the weight table (0 or 1), its features' rows, logits, targets and the positions they are of."""
        rows = _rows(features, CLASS_BITS)
        yield 0, rows, _logits(self.class_weights, rows, self.class_bias), classes, slice(None)
        bits = len(self.member_weights).bit_length() - 1
        is_open = members >= MEMBERS
        for at, chosen in ((np.flatnonzero(~is_open), slice(None)), (np.flatnonzero(is_open), list(OF_GROUPS))):
            if len(at):
                own = classes[at]
                rows = _rows(features[chosen].take(at, axis=1) ^ (own.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), bits)
                yield 1, rows, _logits(self.member_weights, rows, self.member_bias.take(own, axis=0)), members[at] % MEMBERS, at

    def log10(self, features: np.ndarray, classes: np.ndarray, members: np.ndarray) -> np.ndarray:
        """log10 of the modelled factors, for each position."""
        out = np.zeros(len(classes))
        for _, _, x, target, at in self.factors(features, classes, members):
            own = x.ravel().take(_cells(x, target)).astype(np.float64)
            np.exp(x, out=x)
            out[at] += (own - np.log(x @ _ONES[: x.shape[1]])) / np.log(10.0)
        return out

    def step(self, features: np.ndarray, classes: np.ndarray, members: np.ndarray, squares: list[np.ndarray], met: list[np.ndarray]) -> None:
        """One gradient step, scaled by the root of the squared gradients so far."""
        tables = self.class_weights, self.member_weights
        for k, rows, p, target, _ in self.factors(features, classes, members):
            weights = tables[k]
            np.exp(p, out=p)
            p /= (p @ _ONES[: p.shape[1]])[:, None]
            p.ravel()[_cells(p, target)] -= 1.0
            flat = rows.ravel()
            order = np.argsort(flat, kind="stable")
            flat = flat[order]
            edges = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            size = np.diff(np.concatenate([edges, [len(flat)]]))
            longest = np.argsort((65_535 - np.minimum(size, 65_535)).astype(np.uint16), kind="stable")  # by radix
            edges, size = edges[longest], size[longest]
            gradient = _summed(p, np.tile(np.arange(len(target)), len(rows)).take(order), edges, size)
            every = flat[edges]
            met[k][every] += size.astype(np.float32)
            for first in range(0, len(every), CACHED):
                at, own = every[first : first + CACHED], gradient[first : first + CACHED]
                squared = own * own
                squared += squares[k].take(at, axis=0)
                squares[k][at] = squared
                squared += 1.0
                own *= RATE
                own /= np.sqrt(squared, out=squared)
                weights[at] = np.subtract(weights.take(at, axis=0), own, out=own)


def _cells(rows: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Places of one cell of each row in the rows one after another."""
    return np.arange(len(rows)) * rows.shape[1] + column


def _summed(rows: np.ndarray, chosen: np.ndarray, edges: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``rows[chosen]`` that begin at ``edges``, the longest first; most runs are short."""
    out = rows.take(chosen.take(edges), axis=0)
    live = len(edges)
    for k in range(1, 32):
        live = np.searchsorted(-size[:live], -k)
        out[:live] += rows.take(chosen.take(edges[:live] + k), axis=0)
    for r in range(np.searchsorted(-size[:live], -32)):
        out[r] += rows.take(chosen[edges[r] + 32 : edges[r] + size[r]], axis=0).sum(axis=0)
    return out


def _logits(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    out = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        out += weights.take(r, axis=0)
    out += bias
    return np.clip(out, -80.0, 80.0, out=out)  # biases are 0 at most, and weights stay far below


def _in_pieces(texts: pa.Array, size: int = 2_000_000) -> Iterator[tuple[list[int], list[list[bytes]], list[int]]]:
    """Pieces of texts whose characters add up to about ``size``: the text of each, its tokens, and how many of them only go before.

    Only one of the lists is there at once, and a text is read in pieces of ``PIECE`` words.
    """
    owners: list[int] = []
    pieces: list[list[bytes]] = []
    before: list[int] = []
    n = 0
    for k, text in enumerate(texts):
        last: list[bytes] = []
        for words, ends in _words(text.as_py()):
            owners.append(k)
            pieces.append(last + words + ([END] if ends else []))
            before.append(len(last))
            last = pieces[-1][-2:]
            n += sum(map(len, words)) + len(words)
            if n >= size:
                yield owners, pieces, before
                owners, pieces, before, n = [], [], [], 0
    if pieces:
        yield owners, pieces, before


def _words(text: str) -> Iterator[tuple[list[bytes], bool]]:
    """Words of a text, ``PIECE`` at most at a time, and whether they are the last ones."""
    held: list[bytes] = []
    for part in cut(text):
        held += part.encode().lower().split()
        while len(held) > PIECE:
            yield held[:PIECE], False
            held = held[PIECE:]
    yield held, True


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, c) over the column ``text``: counted within partitions first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["token", "c"])

        for batch in batches:
            for text in batch.column(0):
                for words, ends in _words(text.as_py()):
                    counts.update(words)
                    counts[END] += ends
                    if len(counts) > COUNTED:
                        yield sent()
                        counts.clear()
        yield sent()

    return texts.select("text").mapInArrow(counted, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _vocabulary(counts: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary, and the training tokens of each open class and group."""
    n_tokens, n_types, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("token") == F.lit(END), F.col("c"))), F.lit(0))).first()
    # Counts by size: exact up to 4096, then in steps of a 64th of a power of two.
    grade = F.when(F.col("c") <= 4096, F.col("c")).otherwise(4096 + F.floor((F.log2("c") - 12) * 64))
    least, total = None, 0
    for row in sorted(counts.groupBy(grade.alias("g")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect(), reverse=True):
        total += row["n"]
        if total > DICTIONARY:
            break
        least = row["least"]
    table = counts.where(F.col("c") >= least).toArrow() if least is not None else None
    found = dict(zip(map(bytes, table.column(0).to_pylist()), table.column(1).to_pylist(), strict=True)) if table is not None else {}
    found.pop(END, None)
    ranked = sorted(found, key=lambda t: (-found[t], t))
    if ends:
        place = min(sum(found[t] > ends for t in ranked), SHORT - 1)
        ranked.insert(place, END)
        found[END] = ends
    ending = F.crc32(F.expr("substring(token, greatest(octet_length(token) - 1, 1), 2)"))
    masses, types = np.zeros((OPEN, MEMBERS)), np.zeros((OPEN, MEMBERS))
    group = F.pmod(F.shiftright(F.crc32("token"), 8), F.lit(MEMBERS))
    for k, g, mass, n in counts.groupBy((ending % OPEN).alias("k"), group.alias("g")).agg(F.sum("c"), F.count("*")).collect():
        masses[k, g], types[k, g] = mass, n
    for t in ranked[:SHORT]:
        masses[open_class(t) - CLOSED, group_of(t)] -= found[t]
        types[open_class(t) - CLOSED, group_of(t)] -= 1
    counts_of = np.array([found[t] for t in ranked], np.float64)
    return Vocabulary(ranked, counts_of, n_tokens, n_types, np.log10(masses + types + 1.0)), masses


def train(texts: DataFrame, vocabulary: Vocabulary, open_counts: np.ndarray) -> Model:
    """A model of the column ``text``, every row of it seen once."""
    spark = texts.sparkSession
    model = Model.new(vocabulary, open_counts)
    shared_words = spark.sparkContext.broadcast(vocabulary)
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def worker(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            start = shared.value
            own = Model(start.class_bias, start.member_bias, start.class_weights.copy(), start.member_weights.copy())
            tables = [own.class_weights, own.member_weights]
            squares, met = [np.zeros_like(w) for w in tables], [np.zeros(len(w), np.float32) for w in tables]
            reader = _reader(shared_words)
            for batch in batches:
                for _, pieces, before in _in_pieces(batch.column(0)):
                    numbers, starts, _, (hashes, classes, members, endings, _) = reader.read(pieces)
                    features = histories(hashes[numbers], endings[numbers], starts)
                    own_classes, own_members = classes[numbers], members[numbers]
                    if any(before):
                        new = _new(starts, before)
                        features, own_classes, own_members = features[:, new], own_classes[new], own_members[new]
                    for at in range(0, len(own_classes), BATCH):
                        s = slice(at, at + BATCH)
                        own.step(features[:, s], own_classes[s], own_members[s], squares, met)
            out = [(k, b, met[k][b : b + BLOCK].tobytes(), (w[b : b + BLOCK] * met[k][b : b + BLOCK, None]).astype(np.float32).tobytes()) for k, w in enumerate(tables) for b in range(0, len(w), BLOCK) if met[k][b : b + BLOCK].any()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["k", "b", "met", "sums"])

        def added(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
            met, sums = np.zeros(BLOCK), 0.0
            for batch in batches:
                for m, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    met += np.frombuffer(m, np.float32)
                    sums = sums + np.frombuffer(s, np.float32).reshape(BLOCK, -1).astype(np.float64)
            return met, sums

        def summed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met, sums = added(batches)
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([met.astype(np.float32).tobytes()]), pa.array([sums.astype(np.float32).tobytes()])], names=["k", "b", "met", "sums"])

        def averaged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met, sums = added(batches)
            mean = (sums / np.maximum(met, 1.0)[:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([met.astype(np.float32).tobytes()]), pa.array([mean.tobytes()])], names=["k", "b", "met", "sums"])

        schema = "k int, b int, met binary, sums binary"
        some = texts.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == r).select("text")
        workers = max(2 * spark.sparkContext.defaultParallelism, -(-vocabulary.n_tokens // SHARE))
        parts = some.coalesce(workers).mapInArrow(worker, schema)
        if workers > FAN:
            fan = F.pmod(F.spark_partition_id(), F.lit(-(-workers // FAN)))
            parts = parts.withColumn("fan", fan).groupBy("k", "b", "fan").applyInArrow(summed, schema)
        blocks = parts.groupBy("k", "b").applyInArrow(averaged, schema)
        new = [model.class_weights.copy(), model.member_weights.copy()]
        for row in blocks.toLocalIterator():
            seen = np.frombuffer(row["met"], np.float32) > 0
            at = np.arange(row["b"], row["b"] + BLOCK)[seen]
            new[row["k"]][at] = np.frombuffer(row["sums"], np.float32).reshape(BLOCK, -1)[seen]
        model = Model(model.class_bias, model.member_bias, *new)
    return model


def _new(starts: np.ndarray, before: list[int]) -> np.ndarray:
    """Which tokens are not only there to go before others."""
    out = np.ones(int(starts[-1]), bool)
    for start, n in zip(starts.tolist(), before, strict=False):
        out[start : start + n] = False
    return out


def _reader(shared) -> Reader:
    """The reader of a broadcast vocabulary; a worker keeps that of its last one, and the vocabulary with it."""
    own = remembered("lm")
    if own.get("vocabulary") is not shared.value:
        kept_memory()
        own["vocabulary"], own["reader"] = shared.value, Reader(shared.value)
    return own["reader"]


def score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score) of ``docs``, learning from ``training``."""
    spark = docs.sparkSession
    learned = training.select(text_or_empty(F.col(f"`{text}`")).alias("text"))
    counts = stored(token_counts(learned), "counts")
    vocabulary, open_counts = _vocabulary(counts)
    model = spark.sparkContext.broadcast(train(learned, vocabulary, open_counts))
    words = spark.sparkContext.broadcast(vocabulary)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, shares = _reader(words), words.value.shares
        names = ["row", "id", "n_tokens", "known", "logs", "parts", "token", "times"]
        for batch in batches:
            n = batch.num_rows
            length, known, base, parts_of = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            for owners, pieces, before in _in_pieces(batch.column(2)):
                numbers, starts, tail, (hashes, classes, members, endings, logs) = reader.read(pieces)
                own_classes, own_members = classes[numbers], members[numbers]
                features = histories(hashes[numbers], endings[numbers], starts)
                owner = np.repeat(np.array(owners), np.diff(starts))
                if any(before):
                    new = _new(starts, before)
                    numbers, owner, features, own_classes, own_members = numbers[new], owner[new], features[:, new], own_classes[new], own_members[new]
                parts = np.concatenate([model.value.log10(features[:, at : at + BATCH], own_classes[at : at + BATCH], own_members[at : at + BATCH]) for at in range(0, len(numbers), BATCH)])
                is_open = own_members >= MEMBERS
                log = logs[numbers]
                parts[is_open] += log[is_open] - shares[own_classes[is_open] - CLOSED, own_members[is_open] - MEMBERS]
                outside = numbers >= reader.size
                length += np.bincount(owner, minlength=n)
                known += np.bincount(owner[~outside], minlength=n)
                edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                base[owner[edges]] += np.add.reduceat(log, edges)  # in pairs, so sums over long texts stay exact
                parts_of[owner[edges]] += np.add.reduceat(parts, edges)
                pair, times = np.unique(owner[outside] * (len(tail) + 1) + numbers[outside] - reader.size, return_counts=True)
                if len(pair):
                    which = pa.array((tail[k] for k in (pair % (len(tail) + 1)).tolist()), pa.binary())
                    rows = batch.column(0).take(pa.array(pair // (len(tail) + 1)))
                    yield pa.RecordBatch.from_arrays([rows, pa.nulls(len(pair), batch.column(1).type), *[pa.nulls(len(pair), t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], which, pa.array(times, pa.int64())], names=names)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(length), pa.array(known), pa.array(base), pa.array(parts_of), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names=names)

    asked = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), text_or_empty(F.col(f"`{text}`")).alias("text"))
    kind = asked.schema["id"].dataType.simpleString()
    rows = stored(asked.mapInArrow(scored, f"row long, id {kind}, n_tokens long, known long, logs double, parts double, token binary, times long"), "scored")
    tails = rows.where("token IS NOT NULL").select("row", "token", "times")
    found = tails.join(counts, "token").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("rest"))
    rest = F.coalesce("rest", F.lit(0.0))
    whole = float(np.log10(vocabulary.n_tokens + vocabulary.n_types + 1.0))
    return rows.where("token IS NULL").join(found, "row", "left").select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.n_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + rest - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("parts") + rest).alias("score"),
    )
