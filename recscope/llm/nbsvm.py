"""Quality classifier: naive Bayes support vectors.

A text is the set of its n-grams: one and two lower-case words, and one to three word shapes (case, ending, length,
and whether the word repeats the one before), all hashed into ``2 ** HASH_BITS`` indicators. Each indicator is scaled by
its naive Bayes log-count ratio, the smoothed log ratio of its document frequencies in the two classes; rows are then scaled to length
one. A linear hinge-loss model is fitted by dual coordinate descent on shards of ``SHARD`` labelled documents, in
parallel, and the shards' weights are averaged. A sigmoid fitted on labelled documents outside of the shards (at
most ``CALIBRATE``) turns margins into scores.

The model is fitted on at most ``FIT`` labels, those whose ids have the least hashes; only their documents are read for it.
Scoring covers every row.

Only the text is read for a score, in blocks of words, so a long text takes little more memory than itself. Ties in the hash of an
id go by the id, then the label. Null and empty texts have no n-gram and get the score of the bias alone. Null labels
and labels of a null id are left out; a text with one id counts once under each of its labels, however often its row is
repeated. Without labels every score is one half. Each row is scored by itself; extra columns stay, one named like the added
column is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recscope.llm.common import cut, fold, released, remembered, stored, text_or_empty

HASH_BITS = 18
SIZE = 1 << HASH_BITS
#: Labels that a model is fitted on, at most.
FIT = 40_000
#: Documents of a shard; passes over it; cost of a hinge loss; smoothing of the document frequencies.
SHARD, PASSES, COST, SMOOTH = 4096, 12, 4.0, 1.0
#: Documents that the sigmoid is fitted on, at most: of each ``HELD`` labelled documents one is kept out for it.
CALIBRATE, HELD = 20_000, 8
#: Words whose hash a worker remembers; words hashed at once.
REMEMBER, BLOCK = 100_000, 1_000_000


class _Hashed(dict):
    """Word -> 32-bit hash of its lower case, and its shape in the low 8 bits."""

    def __missing__(self, word: str) -> int:
        last = word[-1]
        case = 3 if len(word) > 1 and word.isupper() else 2 if word[0].isupper() else 1 if word[0].isalpha() else 0
        end = 0 if last.isalpha() else 1 if last == "." else 2 if last == "," else 3 if last in "!?" else 4 if last.isdigit() else 5
        twice = len(word) > 1 and not last.isalnum() and word[-2] == last
        length = 0 if len(word) < 4 else 1 if len(word) < 16 else 2
        shape = ((case * 6 + end) * 3 + length) * 2 + twice
        code = self[word] = zlib.crc32(word.lower().encode()) << 8 | shape
        return code


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - HASH_BITS)


def _blocks(text: str) -> Iterator[list[str]]:
    """The words of a text, ``BLOCK`` at most at a time."""
    for piece in cut(text):
        words = piece.split()
        for at in range(0, len(words), BLOCK):
            yield words[at : at + BLOCK]


def features(text: str) -> np.ndarray:
    """The text's indicators, ascending, without the bias."""
    own = remembered("nbsvm")
    hashed = own.get("words") or own.setdefault("words", _Hashed())
    first, seen = None, None
    before: list[str] = []
    for words in _blocks(text):
        if len(hashed) > REMEMBER:
            hashed.clear()
        # Three words of the block before: n-grams reach over two, and the shape of a word asks for the one before it.
        some = before + words
        code = np.fromiter(map(hashed.__getitem__, some), np.uint64, len(some))
        word, shape = code >> np.uint64(8), code & np.uint64(255)
        shape[1:] += (word[1:] == word[:-1]).astype(np.uint64) * np.uint64(256)
        if len(before) == 3:
            word, shape = word[1:], shape[1:]
        before = some[-3:]
        pair = shape[:-1] * np.uint64(1024) + shape[1:]
        made = np.concatenate([_mixed(word, 1), _mixed(word[:-1] * np.uint64(0x100000001B3) ^ word[1:], 2), _mixed(shape, 3), _mixed(pair, 4), _mixed(pair[:-1] * np.uint64(1024) + shape[2:], 5)])
        if first is None:
            first = made
            continue
        if seen is None:
            seen = np.zeros(SIZE, bool)
            seen[first] = True
        seen[made] = True
    if seen is not None:
        return np.flatnonzero(seen)
    return np.unique(first).astype(np.int64) if first is not None else np.zeros(0, np.int64)


def _packed(found: np.ndarray) -> bytes:
    """Ascending numbers as 16-bit gaps; 65535 moves on without a number."""
    gaps = np.diff(found, prepend=0)
    far = gaps // 65535
    if far.any():
        gaps = np.insert(gaps % 65535, np.repeat(np.arange(len(gaps)), far), 65535)
    return gaps.astype("<u2").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, "<u2").astype(np.int64)
    return np.cumsum(gaps)[gaps != 65535]


def _unit(v: np.ndarray) -> np.ndarray:
    return (v / max(np.sqrt((v * v).sum()), 1e-12)).astype(np.float32)


def descend(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = COST, passes: int = PASSES, seed: int = 0) -> np.ndarray:
    """Weights of the hinge-loss model by dual coordinate descent; the last weight is the bias."""
    weights = np.zeros(SIZE + 1)
    at = [np.append(r, SIZE).astype(np.int32) for r in rows]
    x = [_unit(np.append(ratio[r], 1.0)) for r in rows]
    alpha = np.zeros(len(rows))
    draw = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in draw.permutation(len(rows)).tolist():
            gradient = labels[i] * float(weights[at[i]] @ x[i]) - 1.0
            new = min(max(alpha[i] - gradient, 0.0), cost)  # rows have length one
            if new != alpha[i]:
                weights[at[i]] += (new - alpha[i]) * labels[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights


def sigmoid(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of the labels (0, 1) over the margins, with smoothed targets."""
    if not len(margins):
        return 0.0, 0.0
    n1 = float(labels.sum())
    n0 = len(labels) - n1
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    at = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float((np.logaddexp(0, z) - target * z).sum() + 0.005 * at[0] ** 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ at))
        gradient = x.T @ (p - target) + [0.01 * at[0], 0.0]
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([0.01, 1e-9]), gradient)
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


@dataclass
class Model:
    """``ratio``: log-count ratios; ``weights``: of the scaled indicators, then the bias; ``slope``, ``offset``: the sigmoid."""

    ratio: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        r = self.ratio[found]
        return float((r @ self.weights[found] + self.weights[SIZE]) / np.sqrt(float(r @ r) + 1.0))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features(text)) + self.offset, -35, 35))))


def _vector(df: DataFrame, size: int) -> np.ndarray:
    """Collect (at, value) rows into a vector; there are at most ``size``."""
    table = df.toArrow()
    out = np.zeros(size)
    out[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", id_col: str = "doc_id", most: int = FIT) -> Model:
    """A model of ``label`` (1 or 0) from the rows of ``docs`` that have one of at most ``most`` ``labels``.

    The chosen labels are broadcast, so no text is shuffled; labelled texts become sets of indicators, a kilobyte each.
    """
    spark = docs.sparkSession
    body = text_or_empty(F.col(f"`{text}`"))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{id_col}`"), body).alias("key"), body.alias("text"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((_packed(features(t.as_py())) for t in batch.column(2)), pa.binary())], names=["label", "key", "found"])

    own = labels.where(F.col(label).isNotNull() & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(label).cast("int").alias("label")).distinct()
    chosen = own.orderBy(F.xxhash64("id"), "id", "label").limit(most)
    made = texts.join(F.broadcast(chosen), "id").select("label", "key", "text").mapInArrow(featured, "label int, key long, found binary")
    rows = stored(made.dropDuplicates(["key", "label"]), "labelled")
    held = F.pmod("key", F.lit(HELD)) == 0

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("nbsvm")
        counts = np.zeros((2, SIZE), np.int64)
        for batch in batches:
            for y, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[int(y > 0)][_unpacked(found)] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[1, at]), pa.array(counts[0, at])], names=["at", "p", "q"])

    counted = rows.select("label", "found").mapInArrow(frequencies, "at long, p long, q long").groupBy("at").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    counted = counted.toArrow()
    p, q = np.full(SIZE, SMOOTH), np.full(SIZE, SMOOTH)
    p[counted.column(0).to_numpy()] += counted.column(1).to_numpy()
    q[counted.column(0).to_numpy()] += counted.column(2).to_numpy()
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    shared = spark.sparkContext.broadcast(ratio)
    n = rows.where(~held).count()
    if not n:
        return Model(ratio, np.zeros(SIZE + 1), 0.0, 0.0)
    shards = -(-n // SHARD)

    def shard(key: tuple, group: pa.Table) -> pa.Table:
        remembered("nbsvm")
        order = np.argsort(group.column("key").to_numpy(), kind="stable")
        found = group.column("found").to_pylist()
        labels = np.where(group.column("label").to_numpy() > 0, 1.0, -1.0)[order]
        weights = descend([_unpacked(found[i]).astype(np.int32) for i in order], labels, shared.value, seed=key[0].as_py()) * len(order)
        at = np.flatnonzero(weights)
        return pa.table({"at": at, "w": weights[at]})

    parts = rows.where(~held).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInArrow(shard, "at long, w double")
    weights = _vector(parts.groupBy("at").agg(F.sum("w") / n), SIZE + 1)
    plain = spark.sparkContext.broadcast(Model(ratio, weights, 0.0, 0.0))

    @F.arrow_udf("double")
    def margin(found: pa.Array) -> pa.Array:
        return pa.array([plain.value.margin(_unpacked(x)) for x in found.to_pylist()], pa.float64())

    kept_out = rows.where(held).orderBy("key").limit(CALIBRATE).select("label", margin("found").alias("margin")).toArrow()
    slope, offset = sigmoid(kept_out.column(1).to_numpy(), (kept_out.column(0).to_numpy() > 0).astype(float))
    return Model(ratio, weights, slope, offset)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``: the model's score of the text, from 0 to 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        scores = pa.array((shared.value.score(t.as_py()) for t in texts), pa.float64())
        released()
        return scores

    return df.withColumn(out, scored(text_or_empty(F.col(f"`{text}`"))))


def fit_on_folds(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, held_part: int = 2) -> Model:
    """A model of ``label`` from the documents outside of the held-out fold of the id's hash."""
    outside = fold(F.col("doc_id"), parts) != held_part
    return fit(docs.where(outside).select("doc_id", "text"), labels.where(outside).select("doc_id", F.col(label).alias("label")))
