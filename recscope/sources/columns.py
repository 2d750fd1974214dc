"""Payloads to values by columns: records of one descriptor are decoded together, parameter by parameter.

A descriptor is a list of steps. A step reads its parameter for all records at once: numbers as views of gathered bytes, texts and byte
buffers as runs of pieces, each record's place moving on past what it read. A record whose bytes end early keeps the values before. Records of descriptors
with a nested log, whose steps depend on the bytes, are left to ``sources.values``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from recscope.schema import FLAGS

VALUE_TYPES = [("idx", pa.int32()), ("depth", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("flags", pa.int64()), ("i", pa.int64()), ("u", pa.decimal128(20, 0)), ("d", pa.float64()), ("s", pa.string()), ("b", pa.binary()), ("type_name", pa.string())]
SIZES = {"NUM_8": 1, "NUM_16": 2, "NUM_32": 4, "NUM_64": 8}


def nested(params: list[dict]) -> bool:
    return any(p["flags"] & FLAGS["NESTED_LOG"] for p in params)


class Columns:
    """Values of one parameter for the records that have it: ``rows`` are their numbers."""

    def __init__(self, rows: np.ndarray, kind: str, **fields: pa.Array) -> None:
        self.rows, self.kind, self.fields = rows, kind, fields


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of runs that begin at ``begin``, one after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _unsigned(u: np.ndarray) -> pa.Array:
    """Numbers of 64 bits, zero-extended, as decimals."""
    wide = np.zeros((len(u), 2), np.uint64)
    wide[:, 0] = u
    return pa.Array.from_buffers(pa.decimal128(20, 0), len(u), [None, pa.py_buffer(wide.tobytes())])


def _texts(data: np.ndarray, begin: np.ndarray, size: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """Byte strings of ``n`` records from pieces, which are in order of their owners."""
    whole = np.bincount(owner, weights=size, minlength=n).astype(np.int32)
    offsets = np.concatenate([[0], np.cumsum(whole)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[_ranges(begin, size)].tobytes())])


def _readable(texts: pa.Array) -> pa.Array:
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


class _Read:
    """The records of one descriptor: where each one reads next, and where it ends."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        self.data, self.at, self.end = data, begin.copy(), end
        self.live = np.arange(len(begin))

    def number(self, size: int) -> np.ndarray:
        """The next ``size`` bytes of the records that have them, as unsigned numbers; others are done."""
        self.live = self.live[self.at[self.live] + size <= self.end[self.live]]
        raw = np.zeros((len(self.live), 8), np.uint8)
        raw[:, :size] = self.data[self.at[self.live][:, None] + np.arange(size)]
        self.at[self.live] += size
        return raw.view("<u8")[:, 0]

    def text(self) -> pa.Array:
        """The next byte string, in pieces of up to 127 bytes after their lengths."""
        at, open_ = self.at.copy(), self.live
        begins, sizes, owners = [], [], []
        broken = np.zeros(len(self.at), bool)
        while len(open_):
            has = at[open_] < self.end[open_]
            broken[open_[~has]] = True
            open_ = open_[has]
            head = self.data[at[open_]]
            size = (head & 0x7F).astype(np.int64)
            fits = at[open_] + 1 + size <= self.end[open_]
            broken[open_[~fits]] = True
            open_, size, head = open_[fits], size[fits], head[fits]
            begins.append(at[open_] + 1)
            sizes.append(size)
            owners.append(open_)
            at[open_] += 1 + size
            open_ = open_[head & 0x80 > 0]
        self.live = self.live[~broken[self.live]]
        self.at[self.live] = at[self.live]
        begin, size, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begins, sizes, owners))
        keep = ~broken[owner]
        order = np.argsort(owner[keep], kind="stable")
        place = np.zeros(len(self.at), np.int64)
        place[self.live] = np.arange(len(self.live))
        return _texts(self.data, begin[keep][order], size[keep][order], place[owner[keep][order]], len(self.live))


def _step(read: _Read, p: dict, names: dict) -> Columns | None:
    flags = p["flags"]
    if flags & FLAGS["CSTR"]:
        return Columns(read.live, "cstr", s=pa.repeat(pa.scalar(p["text"], pa.string()), len(read.live)))
    if flags & FLAGS["VARRAY"]:
        found = read.text()
        return Columns(read.live, "str", s=_readable(found), b=found) if flags & FLAGS["STR"] else Columns(read.live, "bytes", b=found)
    if flags & FLAGS["ENUM"]:
        u = read.number(4)
        some, of = np.unique(u, return_inverse=True)
        labels = pa.array([names.get((p["type_id"], int(x))) for x in some], pa.string())
        return Columns(read.live, "enum", i=pa.array(u.astype(np.int64)), u=_unsigned(u), s=labels.take(pa.array(of.ravel())))
    if flags & FLAGS["DOUBLE"]:
        d = read.number(8).view("<f8")
        return Columns(read.live, "double", d=pa.array(d))
    for name, size in SIZES.items():
        if flags & FLAGS[name]:
            u = read.number(size)
            shift = np.int64(64 - 8 * size)
            return Columns(read.live, "int", i=pa.array((u.view(np.int64) << shift) >> shift), u=_unsigned(u))
    return None


def decode(data: np.ndarray, begin: np.ndarray, end: np.ndarray, params: list[dict], names: dict) -> pa.ListArray:
    """A list of values for each record of one descriptor."""
    read, n = _Read(data, begin, end), len(begin)
    steps = [(idx, p, c) for idx, p in enumerate(params) if (c := _step(read, p, names)) is not None]
    count = np.bincount(np.concatenate([c.rows for *_, c in steps]), minlength=n) if steps else np.zeros(n, np.int64)
    offsets = np.concatenate([[0], np.cumsum(count)])
    # Steps one after another become rows one after another: the k-th value of a record is its k-th step, as a step only drops records.
    order = np.zeros(int(offsets[-1]), np.int64)
    at = 0
    for k, (*_, c) in enumerate(steps):
        order[offsets[c.rows] + k] = at + np.arange(len(c.rows))
        at += len(c.rows)
    constant = {"idx": lambda idx, p, c: idx, "depth": lambda idx, p, c: 0, "name": lambda idx, p, c: p["param_name"], "kind": lambda idx, p, c: c.kind, "flags": lambda idx, p, c: p["flags"], "type_name": lambda idx, p, c: p["type_name"]}
    fields = []
    for field, kind in VALUE_TYPES:
        own = [pa.repeat(pa.scalar(constant[field](idx, p, c), kind), len(c.rows)) if field in constant else c.fields.get(field, pa.nulls(len(c.rows), kind)) for idx, p, c in steps]
        fields.append(pa.concat_arrays(own).take(pa.array(order)) if own else pa.nulls(0, kind))
    values = pa.StructArray.from_arrays(fields, [f for f, _ in VALUE_TYPES])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def decoded(payloads: pa.Array, groups: np.ndarray, known: list[tuple[list[dict], dict] | None], by_row) -> pa.Array:
    """A list of values for each payload. ``groups``: each one's descriptor, as a place in ``known`` ((parameters, enumerators), or None for no values);
    ``by_row``: what decodes one payload of a descriptor with nested logs, of (payload, place)."""
    kind = pa.list_(pa.struct([(f, t) for f, t in VALUE_TYPES]))
    flat = payloads.fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2], np.uint8) if flat.buffers()[2] is not None else np.zeros(0, np.uint8)
    order = np.argsort(groups, kind="stable")
    edges = np.flatnonzero(np.append(True, groups[order][1:] != groups[order][:-1])) if len(groups) else np.zeros(0, np.int64)
    parts = []
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
        rows, own = order[a:b], known[groups[order[a]]]
        if own is None:
            parts.append(pa.array([[]] * len(rows), kind))
        elif nested(own[0]):
            parts.append(pa.array([by_row(flat[int(r)].as_py(), int(groups[r])) for r in rows], kind))
        else:
            parts.append(decode(data, offsets[rows], offsets[rows + 1], *own).cast(kind))
    if not parts:
        return pa.array([], kind)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return pa.concat_arrays(parts).take(pa.array(back))
