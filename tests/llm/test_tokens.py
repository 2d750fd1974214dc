"""Token counts and byte-level BPE against the libraries that define them."""

from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from recscope.llm import bpe_bitmap, token_fst
from recscope.llm.queries import QUERIES

TEXTS = ["", " ", "\n\n  x", "don't we'll I'VE they're", "  a   b\t\tc \n", "日本語テキスト und Grüße", "x" * 5000, "ab" * 3000, "<|endoftext|>", "a<|endoftext|>b<|endoftext|>", "'", "''s", "a'l", "a'r b've 'll", "\0\0a\0", "1234567 89,0", "𝔘𝔫𝔦​c o　d", "é́", " ' s", "\r\n\r\n ", "🙂🙂 🙂"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))


@pytest.fixture(scope="module")
def counter():
    return token_fst.TokenCounter(str(P.path("byte_bpe_50k.json")))


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return bpe_bitmap.RankedBpe.load(str(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


def ids_of(packed: bytes) -> list[int]:
    return [int.from_bytes(packed[k : k + 4], "little") for k in range(0, len(packed), 4)]


def test_counts_like_the_library(library, counter):
    expected = [len(library.encode(t, add_special_tokens=False).ids) for t in TEXTS]
    assert counter.count(TEXTS) == expected


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abest'rvl  \n\t.,!19éß日🙂\0")), max_size=40), max_size=8))
def test_counts_of_random_texts(library, counter, texts):
    assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_a_text_over_the_batch_size_is_carried_on(library, counter, monkeypatch):
    draw = random.Random(3)
    texts = ["".join(draw.choices("ab'lrve \n1.é", k=draw.randrange(1, 3000))) for _ in range(12)]
    monkeypatch.setattr(token_fst, "BATCH", 700)
    assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_prefix_scan_is_the_plain_run():
    import numpy as np

    draw = np.random.default_rng(1)
    nxt, out = token_fst._splitter()
    classes = draw.integers(0, 10, 5000).astype(np.uint8)
    marks, last = token_fst.scan_marks(classes)
    state, plain = token_fst.DONE, []
    for c in classes.tolist():
        at = state * token_fst.N_CLASSES + c
        plain.append(int(out[at]))
        state = int(nxt[at])
    assert marks.tolist() == plain and last == state


def test_encodes_like_tiktoken(tik, bpe):
    for t in TEXTS:
        packed = bpe.encode(t)
        assert ids_of(packed) == tik.encode_ordinary(t)
        assert bpe.decode(packed) == t.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_round_trip_of_random_texts(tik, bpe, text):
    packed = bpe.encode(text)
    assert ids_of(packed) == tik.encode_ordinary(text)
    assert bpe.decode(packed).decode() == text


def test_a_very_long_pre_token(tik, bpe):
    draw = random.Random(5)
    text = "".join(draw.choices("etaoinshrdlu", k=120_000))
    assert ids_of(bpe.encode(text)) == tik.encode_ordinary(text)


def test_bitmap_finds_the_least():
    draw = random.Random(7)
    found, plain = bpe_bitmap.RankBitmap(70_000), set()
    for _ in range(4000):
        x = draw.randrange(70_000)
        if draw.random() < 0.6:
            found.add(x)
            plain.add(x)
        elif plain:
            x = min(plain)
            found.discard(x)
            plain.discard(x)
        assert found.first() == min(plain, default=-1)


def test_queries_over_a_table_with_odd_rows(spark, tmp_path, library, tik):
    rows = [(1, None), (2, ""), (2, ""), (3, "<|endoftext|> plain"), (None, "null id"), (4, "z" * 20_000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.asDict() for r in QUERIES["op2_token_counts"](spark, str(tmp_path)).collect()), key=str)
    expected = [{"doc_id": i, "n_bytes": len((t or "").encode()), "n_tokens": (n := len(library.encode(t or "", add_special_tokens=False).ids)), "over_limit": n > 512} for i, t in rows]
    assert got == sorted(expected, key=str)
    got = sorted((r.asDict() for r in QUERIES["op10_byte_bpe"](spark, str(tmp_path)).collect()), key=str)
    packed = lambda ids: b"".join(i.to_bytes(4, "little") for i in ids)
    expected = [{"doc_id": i, "n_tokens": len(ids := tik.encode_ordinary(t or "")), "ids_sha256": hashlib.sha256(packed(ids)).hexdigest(), "decoded_sha256": hashlib.sha256((t or "").encode()).hexdigest()} for i, t in rows]
    assert got == sorted(expected, key=str)


def test_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([], "text string, ids int, _text string, n_tokens string")
    ranks = str(P.path("byte_bpe_50k.tiktoken"))
    assert bpe_bitmap.encode(df, ranks, P.PATTERN).count() == 0
    assert token_fst.count_tokens(df, str(P.path("byte_bpe_50k.json"))).columns.count("n_tokens") == 1
    one = spark.createDataFrame([("a b", 1, "x", "y")], df.schema)
    coded = bpe_bitmap.encode(one, ranks, P.PATTERN, keep=["text", "ids", "n_tokens"]).first()
    assert coded["n_tokens"] == "y" and isinstance(coded["ids"], (bytes, bytearray))


def test_vocabularies_of_other_splitters_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_fst.TokenCounter(str(P.path("word_bpe_49k.json")))
