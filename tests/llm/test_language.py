"""Language identification: gradients, tables against plain convolution, held-out accuracy, odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from recscope.llm import lang_cnn
from recscope.llm.common import fold
from recscope.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.01"


def made(seed=1):
    net = lang_cnn.Network.fresh(["a", "b", "c"], seed)
    draw = np.random.default_rng(seed)
    net.parts = [p.astype(np.float64) + draw.normal(0, 0.1, p.shape) for p in net.parts]
    return net, draw


def test_gradient_is_the_slope_of_the_loss():
    net, draw = made()
    windows, labels = draw.integers(0, 256, (6, lang_cnn.WINDOW)).astype(np.uint8), draw.integers(0, 3, 6)
    _, found = lang_cnn.gradient(net, windows, labels)
    for part, g in zip(net.parts, found, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        both = []
        for step in (1e-5, -1e-5):
            part[at] += step
            both.append(lang_cnn.gradient(net, windows, labels)[0])
            part[at] -= step
        assert (both[0] - both[1]) / 2e-5 == pytest.approx(g[at], rel=1e-4)


def brute(net, text):
    """Logits by plain loops: every run of bytes is seen once, in windows of their own size."""
    data = text.encode().lower()
    step = lang_cnn.WINDOW - lang_cnn.SHARED
    total, size = np.zeros(len(net.languages)), 0.0
    for at in range(0, max(len(data) - lang_cnn.SHARED, 1), step):
        window = data[at : at + lang_cnn.WINDOW].ljust(lang_cnn.WINDOW, b"\0")
        own = min(step, max(len(data) - at, 1))
        pooled = []
        for k, w in enumerate(lang_cnn.WIDTHS):
            rows = [np.concatenate([net.parts[0][b] for b in window[i : i + w]]) @ net.parts[1 + k] for i in range(step)]
            pooled.append(np.maximum(np.max(rows, axis=0) + net.parts[4 + k], 0))
        total += own * (np.concatenate(pooled) @ net.parts[7] + net.parts[8])
        size += own
    p = np.exp(total / size)
    return p / p.sum()


@pytest.mark.parametrize("n", [1, 3, 255, 256, 257, 509, 510, 40_000])
def test_tables_give_what_plain_convolution_gives(n):
    net, draw = made(n)
    text = ("q" + "".join(chr(c) for c in draw.integers(97, 800, n)))[:n]
    p = brute(net, text)
    best, score = net.predict(text)
    assert best == net.languages[int(p.argmax())] and score == pytest.approx(float(p.max()), rel=1e-6)


def test_query_on_held_out_rows(spark):
    rows = QUERIES["op12_language_id"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == table(spark, SF, "documents").count()
    held = [r for r in rows if r["held_out"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98 and all(0 <= r["score"] <= 1 for r in rows)
    flags = {r["doc_id"]: r["h"] for r in table(spark, SF, "documents").select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("h")).collect()}
    assert all(r["held_out"] == flags[r["doc_id"]] for r in rows)


def test_odd_rows_and_columns(spark):
    rows = [(k, f"{w} {w} tree number {k}" if k % 2 else f"wald {w} baum {k}", "en" if k % 2 else "de") for k in range(60) for w in ("of", "the")]
    odd = [(None, None, "en"), (100, "", "de"), (101, "12 34 ###", "en"), (102, "tree of", None), (103, "x" * 300_000, None), (102, "tree of", None)]
    df = spark.createDataFrame([(*r, "kept", 7) for r in rows + odd], "doc_id long, text string, lang string, _found string, Score int")
    net = lang_cnn.fit(df)
    assert net.languages == ["de", "en"]
    got = lang_cnn.identified(df, net)
    assert got.columns == ["doc_id", "text", "lang", "_found", "lang_pred", "score"]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert found[None] == found[100] == found[101] == ("und", 0.0) and found[102][0] == "en" and found[103][0] in ("de", "en")
    nothing = lang_cnn.fit(df.where("lang IS NULL"))
    assert {r["lang_pred"] for r in lang_cnn.identified(df, nothing).collect()} == {"und"}
    assert not lang_cnn.identified(df.limit(0), lang_cnn.fit(df.limit(0))).collect()


def test_sample_is_bounded_and_has_copies_once(spark):
    rows = [(k, f"word {k % 500}", "en" if k % 10 else "fr") for k in range(5000)]
    languages, found = lang_cnn.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=100)
    counts = {r["label"]: r["count"] for r in found.groupBy("label").count().collect()}
    assert languages == ["en", "fr"] and 20 < counts[0] <= 80 and 20 < counts[1] <= 50 and sum(counts.values()) <= 100
