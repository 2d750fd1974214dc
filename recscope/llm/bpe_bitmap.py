"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of pieces. Every adjacent pair that the rank file knows waits in the
bucket of its merge rank; a bitmap of two levels marks the buckets in use, so the next rank is found by two
find-first-set steps however many ranks wait. Entries are never removed when a neighbour
merges: an entry is stale if the pair that now starts at its position has another rank, and is skipped.
A pre-token of n bytes takes O(n log n) steps at worst, so one of a million bytes is no special case.

Null texts encode as the empty text (no ids). Output rows stay with their input rows: repeated rows, ties
and extra columns of any name are kept as they are.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice
from pathlib import Path
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recscope.llm.common import released, remembered

#: Pre-tokens longer than this are encoded each time; shorter ones are remembered.
REMEMBER_CHARS = 64
#: Pre-tokens that a worker remembers in each of two generations, at most.
REMEMBER = 250_000
#: Bits of a word of the bitmap: two levels of 256 bits hold 65,536 ranks in words, and more in a longer top.
SHIFT = 8
LOW = (1 << SHIFT) - 1
#: Texts longer than this are cut into pre-tokens step by step, not as one list.
LONG_TEXT = 4_000_000
#: Texts that are encoded before their ids are sent on.
ROWS = 250


class RankBitmap:
    """A set of small integers with find-first-set, as two levels of words of ``1 << SHIFT`` bits."""

    def __init__(self, size: int) -> None:
        self.words = [0] * ((size >> SHIFT) + 1)
        self.top = 0

    def add(self, x: int) -> None:
        w = x >> SHIFT
        self.words[w] |= 1 << (x & LOW)
        self.top |= 1 << w

    def discard(self, x: int) -> None:
        w = x >> SHIFT
        self.words[w] &= ~(1 << (x & LOW))
        if not self.words[w]:
            self.top &= ~(1 << w)

    def first(self) -> int:
        """The least member, or -1."""
        if not self.top:
            return -1
        w = (self.top & -self.top).bit_length() - 1
        word = self.words[w]
        return w << SHIFT | (word & -word).bit_length() - 1


class RankedBpe:
    """Encoder and decoder for one rank file; lives in a worker process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.find = regex.compile(pattern)
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.queue = RankBitmap(len(self.table))
        self.known = _Known(self)

    @classmethod
    def load(cls, path: str, pattern: str) -> RankedBpe:
        with Path(path).open("rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        known = self.ranks.get
        if (whole := known(piece)) is not None:
            return [whole]
        n, queue = len(piece), self.queue
        add, first, discard = queue.add, queue.first, queue.discard
        after, before = list(range(1, n + 2)), list(range(-1, n + 1))
        pair: list[int | None] = [known(piece[i : i + 2]) for i in range(n - 1)]
        pair += [None, None]
        buckets: dict[int, list[int]] = {}
        for i, r in enumerate(pair):
            if r is not None:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    add(r)
        while (r := first()) >= 0:
            waiting = buckets[r]
            i = heappop(waiting) if len(waiting) > 1 else waiting.pop()
            if not waiting:
                del buckets[r]
                discard(r)
            if pair[i] != r:
                continue  # stale: a neighbour has merged since
            j = after[i]
            after[i] = end = after[j]
            before[end] = i
            pair[j] = None
            pair[i] = new = known(piece[i : after[end]]) if end < n else None
            if new is not None:
                if new in buckets:
                    heappush(buckets[new], i)
                else:
                    buckets[new] = [i]
                    add(new)
            at = before[i]
            if at >= 0:
                pair[at] = new = known(piece[at:end])
                if new is not None:
                    if new in buckets:
                        heappush(buckets[new], at)
                    else:
                        buckets[new] = [at]
                        add(new)
        ids, i = [], 0
        while i < n:
            ids.append(known(piece[i : after[i]]))
            i = after[i]
        return ids

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        known = self.known
        known.age()
        if len(text) <= LONG_TEXT:
            return b"".join(map(known.__getitem__, self.find.findall(text)))
        parts, pieces = [], (m[0] for m in self.find.finditer(text))
        while block := list(islice(pieces, 100_000)):
            parts.append(b"".join(map(known.__getitem__, block)))
            known.age()
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Known(dict):
    """Pre-token -> packed ids, filled as it is asked; what wasn't asked for a while is forgotten."""

    def __init__(self, bpe: RankedBpe) -> None:
        self.bpe = bpe
        self.old: dict[str, bytes] = {}

    def age(self) -> None:
        if len(self) > REMEMBER:
            self.old = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = pack("<%dI" % len(found := self.bpe.merge(piece.encode())), *found)
        if len(piece) <= REMEMBER_CHARS:
            self[piece] = ids
        return ids


def _bpe(path: str, pattern: str) -> RankedBpe:
    """One encoder for each worker process and rank file."""
    loaded = remembered("bpe")
    if (path, pattern) not in loaded:
        loaded[path, pattern] = RankedBpe.load(path, pattern)
    return loaded[path, pattern]


def _encoded(bpe: RankedBpe, batches: Iterator[pa.RecordBatch], names: list[str], decoded: bool) -> Iterator[pa.RecordBatch]:
    """The batches with ids (and decoded bytes) for their last column, in batches of ``ROWS``: neither this process nor Spark's holds those of a
    whole batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            *columns, texts = batch.slice(at, ROWS).columns
            coded = [pa.array((bpe.encode(t.as_py() or "") for t in texts), pa.binary())]
            if decoded:
                coded.append(pa.array((bpe.decode(x.as_py()) for x in coded[0]), pa.binary()))
            yield pa.RecordBatch.from_arrays([*columns, *coded], names=names)
        released()


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """``keep`` (all columns by default; one named ``ids`` is replaced) and ``ids``: the text's token ids, packed as
    little-endian unsigned 32-bit integers; with ``decoded`` also the bytes that the ids decode to.

    ``rank_file`` is a local path on every executor (a vocabulary installed with the image).
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in (ids, decoded)]
    asked = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)], F.col(f"`{text}`").cast("string").alias("text"))
    made = [ids] if decoded is None else [ids, decoded]
    schema = T.StructType([*[T.StructField(c, f.dataType) for c, f in zip(kept, asked.schema, strict=False)], *[T.StructField(c, T.BinaryType()) for c in made]])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(_bpe(rank_file, pattern), batches, [*kept, *made], decoded is not None)

    return asked.mapInArrow(encoded, schema)  # a step of its own: ids that are used twice are made once


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes that the packed ids stand for (null ids: no bytes)."""

    @F.arrow_udf("binary")
    def decoded(packed: pa.Array) -> pa.Array:
        bpe = _bpe(rank_file, pattern)
        return pa.array((bpe.decode(x.as_py() or b"") for x in packed), pa.binary())

    return df.withColumn(out, decoded(F.col(f"`{ids}`")))


def n_ids(ids: Column) -> Column:
    return (F.length(ids) / 4).cast("long")
