"""Token counts where blocks end at any place."""

from __future__ import annotations

import random

import public_tokenizers as P
from tokenizers import Tokenizer

from recscope.llm import token_fst


def test_counts_do_not_depend_on_where_blocks_end(monkeypatch):
    library = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    counter = token_fst.TokenCounter(str(P.path("byte_bpe_50k.json")))
    draw = random.Random(7)
    for batch in range(3, 51):
        monkeypatch.setattr(token_fst, "BATCH", batch)
        texts = ["".join(draw.choices("abest'rvl  \n\t.,!19éß日🙂\0", k=draw.randrange(0, 30))) for _ in range(60)] + ["abc", "def", "a"] * 5
        assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts], batch
