"""Encoding sends small batches on, whatever the size of those that come."""

from __future__ import annotations

import public_tokenizers as P
import pyarrow as pa

from recscope.llm import bpe_bitmap


def test_a_large_batch_is_sent_on_in_small_ones():
    bpe = bpe_bitmap.RankedBpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = [None, ""] + [f"text number {k} of a batch" for k in range(3 * bpe_bitmap.ROWS)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "text"])
    out = list(bpe_bitmap._encoded(bpe, iter([batch, batch.slice(0, 0)]), ["k", "ids", "decoded"], True))
    assert max(b.num_rows for b in out) == bpe_bitmap.ROWS
    got = pa.Table.from_batches(out)
    assert got["k"].to_pylist() == list(range(len(texts)))
    assert [b.decode() for b in got["decoded"].to_pylist()] == [t or "" for t in texts]
    assert got["ids"].to_pylist() == [bpe.encode(t or "") for t in texts]
