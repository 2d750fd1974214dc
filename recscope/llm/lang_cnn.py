"""Language identification: a convolutional network over bytes, trained and applied in numpy.

A text's UTF-8 bytes (A-Z in lower case) are cut into windows of ``WINDOW`` bytes; neighbours share three bytes, so that every run of four
lies within one. Bytes are embedded, filters of ``WIDTHS`` bytes slide over a window, each filter's greatest answer stays
(max pooling), and a softmax layer makes logits of the languages. A text's logits are the means over its windows, weighted by their bytes.

The model learns from at most ``FIT`` different texts, of at most ``LANGUAGES`` languages (the most frequent ones), spread evenly over them: those whose
hashes are the least, once each, ``DRAWN`` windows of each. Rounds of gradient steps run on ``SHARDS`` shards at once, and
their parameters are averaged. To score, embedding and filters become tables by pairs of bytes, so a filter of four bytes is two look-ups.
Scoring reads every text whole.

``und`` with score 0 is a text that is null or has no letter, and every text where no language could be learned. Rows without a language
teach nothing; neither do rows without a letter. Ties in the hash go by the language, ties between languages to the first by name. Each row is scored by itself:
repeated rows get equal results; long texts are scored in blocks of windows. Extra columns stay; one named like an added column is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recscope.llm.common import released, stored, text_or_empty

UNKNOWN = "und"
WINDOW, WIDTHS = 256, (2, 3, 4)
SHARED = max(WIDTHS) - 1
#: Numbers of a byte's embedding; filters of each width.
EMBEDDING, FILTERS = 8, 16
#: Texts that a model learns from, at most; languages, at most; windows of a text.
FIT, LANGUAGES, DRAWN = 8_000, 64, 4
#: Training: shards, rounds, passes of a round over a shard, windows of a step, rate of the first round.
SHARDS, ROUNDS, PASSES, STEP, RATE = 4, 4, 2, 64, 0.01
#: Windows scored at once.
BLOCK = 64


@dataclass
class Network:
    """Parameters: embedding (256, E), filters by width (w * E, F), their offsets (F each), output (all filters, languages) and its offset."""

    languages: list[str]
    parts: list[np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 0) -> Network:
        draw = np.random.default_rng(seed)
        parts = [draw.normal(0, 0.5, (256, EMBEDDING))]
        parts += [draw.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS)) for w in WIDTHS]
        parts += [np.zeros(FILTERS) for _ in WIDTHS]
        parts += [draw.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))), np.zeros(len(languages))]
        return cls(languages, [p.astype(np.float32) for p in parts])

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Answers to the first pair of bytes by all filters, to the third byte by those of three, to the second pair by those of four."""
        embedded, (two, three, four) = self.parts[0], self.parts[1:4]
        by_byte = lambda w, k: embedded @ w[k * EMBEDDING : (k + 1) * EMBEDDING]
        pair = lambda w, k: (by_byte(w, k)[:, None] + by_byte(w, k + 1)[None]).reshape(65_536, FILTERS)
        return np.ascontiguousarray(np.hstack([pair(two, 0), pair(three, 0), pair(four, 0)])), by_byte(three, 2), pair(four, 2)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Each window's greatest answers."""
        first, third, second = self.tables
        n = WINDOW - SHARED
        pairs = windows[:, :-1].astype(np.int32) << 8 | windows[:, 1:]
        answers = first[pairs[:, :n]]
        answers[:, :, FILTERS : 2 * FILTERS] += third[windows[:, 2 : n + 2]]
        answers[:, :, 2 * FILTERS :] += second[pairs[:, 2 : n + 2]]
        return np.maximum(answers.max(axis=1) + np.concatenate(self.parts[4:7]), 0)

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        total = np.zeros(len(self.languages))
        size = 0
        for windows, sizes in blocks(text):
            logits = self.pooled(windows) @ self.parts[-2] + self.parts[-1]
            total += sizes @ logits
            size += sizes.sum()
        mean = total / size
        p = np.exp(mean - mean.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def _windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(windows, bytes that are a window's own) of some bytes."""
    step = WINDOW - SHARED
    n = max(1, -(-(len(data) - SHARED) // step))
    padded = np.frombuffer(data.ljust(n * step + SHARED, b"\0"), np.uint8)
    sizes = np.full(n, float(step))
    sizes[-1] = min(step, max(len(data) - (n - 1) * step, 1))
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step], sizes


def blocks(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A text's windows, ``BLOCK`` at a time."""
    data = text.encode("utf-8", "replace").lower()
    step = BLOCK * (WINDOW - SHARED)
    for at in range(0, max(len(data) - SHARED, 1), step):
        yield _windows(data[at : at + step + SHARED])


def drawn(text: str) -> bytes:
    """``DRAWN`` windows of a text to learn from, every second one cut short; the draw depends on the text alone."""
    data = text.encode("utf-8", "replace").lower()
    draw = np.random.default_rng(zlib.crc32(data))
    out = []
    for k in range(DRAWN):
        at = int(draw.integers(0, max(1, len(data) - WINDOW + 1)))
        size = int(draw.integers(8, WINDOW)) if k % 2 else WINDOW
        out.append(data[at : at + size].ljust(WINDOW, b"\0"))
    return b"".join(out)


def gradient(net: Network, windows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """(mean loss, gradient of each part) of the cross-entropy."""
    embedded, filters, offsets, out, bias = net.parts[0], net.parts[1:4], net.parts[4:7], net.parts[7], net.parts[8]
    n, places = len(windows), WINDOW - SHARED
    x = embedded[windows]
    patches, best, top = [], [], []
    for w, f, b in zip(WIDTHS, filters, offsets, strict=True):
        seen = np.lib.stride_tricks.as_strided(x, (n, places, w * EMBEDDING), x.strides)  # a row's bytes follow one another
        answers = seen @ f
        at = answers.argmax(axis=1)
        best.append(at)
        top.append(np.take_along_axis(answers, at[:, None], 1)[:, 0] + b)
        patches.append(seen)
    pooled = np.hstack(top)
    active = np.maximum(pooled, 0)
    logits = active @ out + bias
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    row = np.arange(n)
    loss = float(-np.log(np.maximum(p[row, labels], 1e-30)).mean())
    p[row, labels] -= 1
    p /= n
    back = (p @ out.T) * (pooled > 0)
    d_embedded = np.zeros_like(embedded)
    d_filters, d_offsets = [], []
    for k, (w, f) in enumerate(zip(WIDTHS, filters, strict=True)):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        chosen = patches[k][row[:, None], best[k]]  # (n, F, w * E)
        d_filters.append(np.einsum("nf,nfe->ef", g, chosen))
        d_offsets.append(g.sum(axis=0))
        back_x = (g[:, :, None] * f.T[None]).reshape(-1, EMBEDDING)
        where = windows[row[:, None, None], best[k][:, :, None] + np.arange(w)].ravel()
        for e in range(EMBEDDING):
            d_embedded[:, e] += np.bincount(where, back_x[:, e], 256)
    return loss, [d_embedded, *d_filters, *d_offsets, active.T @ p, p.sum(axis=0)]


def trained(net: Network, windows: np.ndarray, labels: np.ndarray, rate: float, passes: int = PASSES, seed: int = 0) -> Network:
    """The network after passes of gradient steps (Adam) over the windows."""
    draw = np.random.default_rng(seed)
    parts = [p.copy() for p in net.parts]
    mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    now, t = Network(net.languages, parts), 0
    for _ in range(passes):
        order = draw.permutation(len(windows))
        for at in range(0, len(order), STEP):
            own = order[at : at + STEP]
            t += 1
            for p, m, s, g in zip(parts, mean, square, gradient(now, windows[own], labels[own])[1], strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-7)
    return now


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", most: int = FIT) -> tuple[list[str], DataFrame]:
    """(languages, (label, key, windows)): what a model learns from, at most ``most`` rows, as a stored table."""
    body = text_or_empty(F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(body).alias("key"), body.alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    once = stored(rows.groupBy("lang", "key").agg(F.min("id").alias("id")), "texts")
    counts = once.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return [], once
    # Hashes are even: a share of their range is that share of a language's texts.
    own = most // len(languages)
    share = lambda n: -(1 << 63) + min((1 << 64) - 1, (own << 64) // n)
    label, below = F.lit(None).cast("int"), F.lit(False)
    for r in counts:
        label = F.when(F.col("lang") == r["lang"], languages.index(r["lang"])).otherwise(label)
        below = below | ((F.col("lang") == r["lang"]) & (F.col("key") <= share(r["n"])))
    chosen = once.where(below).withColumn("label", label).orderBy("key", "lang").limit(most)

    @F.arrow_udf("binary")
    def windows(texts: pa.Array) -> pa.Array:
        return pa.array((drawn(t.as_py()) for t in texts), pa.binary())

    found = rows.join(F.broadcast(chosen.withColumnRenamed("id", "own_id")), ["lang", "key"]).where(F.col("id").eqNullSafe(F.col("own_id")))
    return languages, stored(found.select("label", "key", windows("text").alias("windows")).dropDuplicates(["label", "key"]), "windows")


def _round(start: Broadcast, turn: int):
    """A shard's part in a round: (windows that it has, its parameters after some passes from ``start``)."""

    def step(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("label", "ascending")])
        windows = np.concatenate([np.frombuffer(w, np.uint8).reshape(-1, WINDOW) for w in group.column("windows").to_pylist()])
        labels = np.repeat(group.column("label").to_numpy(), DRAWN)
        after = trained(start.value, windows, labels, RATE * 0.5**turn, seed=turn * SHARDS + key[0].as_py())
        return pa.table({"n": [len(labels)], "parts": [np.concatenate([p.ravel() for p in after.parts]).astype("<f4").tobytes()]})

    return step


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", most: int = FIT) -> Network:
    """A network that has learned the languages of ``docs``."""
    languages, rows = sample(docs, text, lang, id_col, most)
    net = Network.fresh(languages)
    if not languages:
        return net
    sc = docs.sparkSession.sparkContext
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(SHARDS)).cast("int"))
    for turn in range(ROUNDS):
        found = sharded.groupBy("shard").applyInArrow(_round(sc.broadcast(net), turn), "n long, parts binary").collect()
        total = sum(r["n"] for r in found)
        flat = sum(np.frombuffer(r["parts"], "<f4") * np.float32(r["n"] / total) for r in found)
        edges = np.cumsum([p.size for p in net.parts])[:-1]
        net = Network(languages, [v.reshape(p.shape).astype(np.float32) for v, p in zip(np.split(flat, edges), net.parts, strict=True)])
    return net


def identified(df: DataFrame, net: Network, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add ``out``, the text's language, and ``score``, its probability."""
    shared = df.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("struct<lang: string, p: double>")
    def found(texts: pa.Array) -> pa.Array:
        pairs = [shared.value.predict(t.as_py()) for t in texts]
        released()
        return pa.StructArray.from_arrays([pa.array([a for a, _ in pairs], pa.string()), pa.array([p for _, p in pairs], pa.float64())], ["lang", "p"])

    taken = {c.lower() for c in df.columns}
    own = "_found"
    while own in taken:
        own += "_"
    both: Column = found(text_or_empty(F.col(f"`{text}`")))
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in (out.lower(), score.lower())]
    return df.withColumn(own, both).select(*kept, F.col(own)["lang"].alias(out), F.col(own)["p"].alias(score))
