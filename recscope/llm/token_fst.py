"""Token counts by compiled finite-state transducers.

Two deterministic transducers give a text's token count without making its tokens:

* the *splitter* reads character classes and marks where pre-tokens begin. It has eleven states, so a chunk of
  text is a map of eleven states to eleven states. All chunks of a batch are run at once from every state, the
  maps are composed by a parallel prefix scan, and a second pass from the now known states gives the marks;
* the *counter* reads the bytes of a pre-token. Each transition carries the change of the number of tokens that
  the bytes read so far encode to. A state holds, for every start that may still grow into a vocabulary entry,
  the trie node reached, the last token before that start and the token count there relative to now; of the
  tokens ending at a byte exactly one fits its left neighbour under the merge order. States and transitions are
  compiled when first met and kept by the worker. Each mark resets the counter, so its chunk map is constant.

Null texts count as empty (0 tokens). Special strings inside a text are one token each, as the vocabulary file's
library has it by default. Rows are never merged: repeated rows, ties and extra columns stay as they are.
"""

from __future__ import annotations

import json
from functools import cache
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recscope.llm.common import remembered

#: Characters of a chunk; of a batch that is split at once.
CHUNK, BATCH = 256, 2_000_000
#: Transitions kept by a worker, at most; beyond it they are compiled anew.
TRANSITIONS = 1_500_000
#: Pre-tokens whose count a worker remembers, and their longest.
REMEMBER, REMEMBER_CHARS = 300_000, 64

# Character classes of the splitter.
LETTER, NUMBER, SPACE, BLANK, OTHER, APOSTROPHE, L_STMD, L_E, L_RV, L_L, END = range(11)
# States: closed, in letters, in numbers, in other characters, in white space (one or more characters; the last is
# a space or not), after an apostrophe that began, after its r or v, after its l.
DONE, LET, NUM, OTH, SP1, SPN, BL1, BLN, APO, APO_RV, APO_L = range(11)
N_STATES, N_CLASSES = 11, 16


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next states, and outputs: bit 0: a pre-token begins here, bit 1: one begins a character earlier."""
    letters = (LETTER, L_STMD, L_E, L_RV, L_L)
    begin = dict.fromkeys(letters, LET) | {NUMBER: NUM, SPACE: SP1, BLANK: BL1, OTHER: OTH, APOSTROPHE: APO}
    runs = {LET: letters, NUM: (NUMBER,), OTH: (OTHER, APOSTROPHE)}
    nxt = np.zeros((N_STATES, N_CLASSES), np.uint8)
    out = np.zeros((N_STATES, N_CLASSES), np.uint8)
    for s in range(N_STATES):
        for c, new in begin.items():
            nxt[s, c], out[s, c] = new, 1
        for c in runs.get(s, ()):
            nxt[s, c], out[s, c] = s, 0
        if s in (SP1, SPN, BL1, BLN):
            for c, new in begin.items():
                if c in (SPACE, BLANK):
                    nxt[s, c], out[s, c] = (SPN if c == SPACE else BLN), 0
                else:
                    joined = s in (SP1, SPN)
                    nxt[s, c] = OTH if joined and c == APOSTROPHE else new
                    out[s, c] = (not joined) | (2 if s in (SPN, BLN) else 0)
        if s == APO:
            for c in (OTHER, APOSTROPHE):
                nxt[s, c], out[s, c] = OTH, 0
            for c, new in ((L_STMD, DONE), (L_RV, APO_RV), (L_L, APO_L)):
                nxt[s, c], out[s, c] = new, 0
        if s in (APO_RV, APO_L):
            for c in letters:
                nxt[s, c], out[s, c] = LET, 2
            for c in set(begin) - set(letters):
                out[s, c] |= 2
            c = L_E if s == APO_RV else L_L
            nxt[s, c], out[s, c] = DONE, 0
            out[s, END] = 2
        nxt[s, END] = DONE
    return nxt.ravel(), out.ravel()


@cache
def _classes() -> np.ndarray:
    """The class of each code point."""
    of = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for c, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\p{White_Space}")):
        of[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = c
    of[0x20] = SPACE
    of[ord("'")] = APOSTROPHE
    for c, chars in ((L_STMD, "stmd"), (L_E, "e"), (L_RV, "rv"), (L_L, "l")):
        of[[*map(ord, chars)]] = c
    return of


def scan_marks(classes: np.ndarray, start: int = DONE) -> tuple[np.ndarray, int]:
    """Outputs of the splitter over ``classes`` from state ``start``, and its last state."""
    nxt, out = _splitter_tables()
    n = len(classes)
    lanes = max(1, -(-n // CHUNK))
    padded = np.full(lanes * CHUNK, N_CLASSES - 1, np.uint8)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T)
    maps = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], lanes, axis=1)
    for c in steps[:, :-1] if lanes == 1 else steps:
        maps = nxt.take(maps * np.uint8(N_CLASSES) + c)
    ahead = 1
    while ahead < lanes:  # inclusive scan: maps[:, k] becomes the composition of chunks 0 to k
        maps[:, ahead:] = np.take_along_axis(maps[:, ahead:], maps[:, :-ahead], axis=0)
        ahead *= 2
    state = np.concatenate([[start], maps[start, :-1]]).astype(np.uint8)
    marks = np.empty_like(steps)
    last = n - (lanes - 1) * CHUNK
    final = start
    for k, c in enumerate(steps):
        at = state * np.uint8(N_CLASSES) + c
        marks[k] = out.take(at)
        state = nxt.take(at)
        if k == last - 1:
            final = int(state[-1])
    return marks.T.ravel()[:n], final


@cache
def _splitter_tables() -> tuple[np.ndarray, np.ndarray]:
    return _splitter()


class Counter:
    """The counting transducer of one vocabulary, compiled as far as it is used."""

    def __init__(self, merges: list[tuple[bytes, bytes]], vocabulary: set[bytes]) -> None:
        self.rank = {pair: r for r, pair in enumerate(merges)}
        self.halves = {a + b: (a, b, r) for r, (a, b) in reversed(list(enumerate(merges)))}
        self.tokens = {t for t in vocabulary if len(t) == 1 or t in self.halves}
        self.prefixes = {t[:k] for t in self.tokens for k in range(1, len(t) + 1)}
        self.fits = cache(self._fits)
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [((b"", None, 0),)]
        self.index = {self.states[0]: 0}
        self.transitions: dict[int, tuple[int, int]] = {}

    def _spine(self, token: bytes, right: bool) -> list[tuple[bytes, float]]:
        """Pieces along the token's edge, from a byte up to the token, each with the rank that consumes it."""
        pieces, until = [], float("inf")
        while True:
            pieces.append((token, until))
            if len(token) == 1:
                return pieces[::-1]
            a, b, until = self.halves[token]
            token = b if right else a

    def _fits(self, left: bytes | None, token: bytes) -> bool:
        """Whether the merge order leaves ``left`` and ``token`` as they are, side by side."""
        if left is None:
            return True
        a, b = self._spine(left, True), self._spine(token, False)
        i = j = 0
        while True:
            (x, gone_x), (y, gone_y) = a[i], b[j]
            seam = self.rank.get((x, y), float("inf"))
            if seam < gone_x and seam <= gone_y and seam < float("inf"):
                return False
            if gone_x == gone_y == float("inf"):
                return True
            if gone_x <= gone_y:
                i += 1
            else:
                j += 1

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of ``state`` on ``byte``: next state, change of the token count."""
        b = bytes([byte])
        open_, ended = [], None
        for prefix, left, count in self.states[state]:
            grown = prefix + b
            if grown in self.prefixes:
                open_.append((grown, left, count))
                if ended is None and grown in self.tokens and self.fits(left, grown):
                    ended = (grown, count + 1)
        token, delta = ended
        key = (*((p, left, count - delta) for p, left, count in open_), (b"", token, 0))
        to = self.index.get(key)
        if to is None:
            to = self.index[key] = len(self.states)
            self.states.append(key)
        self.transitions[state << 8 | byte] = to, delta
        return to, delta

    def count(self, piece: bytes) -> int:
        """Tokens of one pre-token."""
        if len(self.transitions) > TRANSITIONS:
            self.reset()
        state = total = 0
        for byte in piece:
            step = self.transitions.get(state << 8 | byte)
            state, delta = step or self.compile(state, byte)
            total += delta
        return total


class _Remembered(dict):
    def __init__(self, counter: Counter) -> None:
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        n = self.counter.count(piece.encode())
        if len(piece) <= REMEMBER_CHARS:
            self[piece] = n
        return n


def _refuse_others(spec: dict, path: str) -> None:
    """An error for a vocabulary whose texts are normalised or split in another way than the compiled splitter does, or whose model isn't plain byte-level BPE."""
    splitter = spec.get("pre_tokenizer") or {}
    plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
    model = spec["model"]
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    altered = [t["content"] for t in spec["added_tokens"] if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    if spec.get("normalizer") or not plain or model.get("type") != "BPE" or odd or altered:
        raise ValueError(f"{path}: only byte-level BPE without a normaliser, with the byte-level splitter, is counted")


class TokenCounter:
    """Counts the tokens of texts under one vocabulary file."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text())
        _refuse_others(spec, path)
        to_byte = {c: b for b, c in _printable_bytes().items()}
        raw = lambda s: bytes(map(to_byte.__getitem__, s))
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocabulary = {raw(t) for t in spec["model"]["vocab"] if t not in self.special}
        self.known = _Remembered(Counter([(raw(a), raw(b)) for a, b in pairs], vocabulary))
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def count(self, texts: list[str]) -> list[int]:
        counts = [0] * len(texts)
        parts: list[str] = []
        owners: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            pieces = [text]
            if self.cut and any(s in text for s in self.special):
                pieces = self.cut.split(text)
                counts[k] += len(pieces) - 1
            for part in filter(None, pieces):
                if size and size + len(part) > BATCH:
                    self._add(parts, owners, counts)
                    parts, owners, size = [], [], 0
                parts.append(part)
                owners.append(k)
                size += len(part)
        self._add(parts, owners, counts)
        return counts

    def _add(self, parts: list[str], owners: list[int], counts: list[int]) -> None:
        """Add the counts of ``parts``; a part over the batch size is read in blocks, the state carried on."""
        if not parts:
            return
        ends = np.cumsum([len(p) + 1 for p in parts])
        text = "\0".join(parts) + "\0"
        known, state, left = self.known, DONE, 0
        waiting = 0  # where the pre-token begins that is still open
        for at in range(0, len(text), BATCH):
            block = text[at : at + BATCH]
            classes = _classes()[np.frombuffer(block.encode("utf-32-le"), np.uint32)]
            stops = ends[(ends > at) & (ends <= at + BATCH)] - 1 - at
            classes[stops] = END
            marks, state = scan_marks(classes, state)
            marks[stops] |= 1  # the separator is a piece of its own, left out below
            after = np.zeros(len(block) + 1, np.uint8)
            after[1:] = marks & 1
            after[:-1] |= marks >> 1
            begins = np.flatnonzero(after) - 1 + at
            begins = np.unique(begins[begins > waiting]).tolist()
            bounds = [waiting, *begins]
            got = np.fromiter(
                (0 if text[a] == "\0" and b - a == 1 and self._separator(ends, a) else known[text[a:b]] for a, b in pairwise(bounds)),
                np.int64,
                len(bounds) - 1,
            )
            owner = np.searchsorted(ends, bounds[:-1], side="right")
            left = np.bincount(owner, got, len(parts)).astype(np.int64)
            for k in np.flatnonzero(left).tolist():
                counts[owners[k]] += int(left[k])
            waiting = bounds[-1]
            if len(known) > REMEMBER:
                known.clear()

    @staticmethod
    def _separator(ends: np.ndarray, at: int) -> bool:
        k = np.searchsorted(ends, at, side="right")
        return ends[k] - 1 == at


def _printable_bytes() -> dict[int, str]:
    """Byte-level vocabularies write bytes as printable characters: themselves, or from U+0100 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _counter(path: str) -> TokenCounter:
    loaded = remembered("tokens")
    if path not in loaded:
        loaded[path] = TokenCounter(path)
    return loaded[path]


def count_tokens(df: DataFrame, vocabulary_file: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add ``out``: the number of tokens of ``text`` under the vocabulary (a local path on every executor)."""

    @F.arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array(_counter(vocabulary_file).count([t or "" for t in texts.to_pylist()]), pa.int64())

    return df.withColumn(out, counted(F.col(f"`{text}`").cast("string")))
