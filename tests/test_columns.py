"""Values by columns against values record by record, and how fast."""

from __future__ import annotations

import random
import struct
import time

import numpy as np
import pyarrow as pa
from journal_writer import chunked, flag

from recscope.sources import columns, values

KINDS = [("NUM_8",), ("NUM_8", "UNSIGNED"), ("NUM_16",), ("NUM_32", "HEX"), ("NUM_64",), ("NUM_64", "UNSIGNED"), ("DOUBLE",), ("ENUM",), ("VARRAY", "STR"), ("VARRAY",), ("CSTR",), ()]


def made(draw: random.Random, kinds) -> tuple[list[dict], callable]:
    params = [{"flags": flag(*k), "type_id": 1, "param_name": draw.choice([None, "n"]), "text": "const" if k == ("CSTR",) else None, "type_name": draw.choice([None, "T"])} for k in kinds]
    size = {"NUM_8": 1, "NUM_16": 2, "NUM_32": 4, "NUM_64": 8, "DOUBLE": 8, "ENUM": 4}

    def payload() -> bytes:
        out = b""
        for k in kinds:
            if k and k[0] in size:
                out += bytes(draw.randrange(256) for _ in range(size[k[0]])) if k[0] != "ENUM" else struct.pack("<I", draw.choice([0, 7, 1 << 31]))
            elif k and k[0] == "VARRAY":
                out += chunked(draw.choice([b"", "é".encode() * 80, b"\xff\xfe", b"x" * 127, b"y" * 300]))
        return out[: draw.choice([len(out)] * 4 + [draw.randrange(len(out) + 1)])]

    return params, payload


def test_columns_are_the_rows(tmp_path):
    draw = random.Random(7)
    names = {(1, 0): "zero", (1, 7): "seven"}
    for _ in range(60):
        known, payloads, groups = [None], [], []
        for _ in range(draw.randrange(1, 4)):
            params, payload = made(draw, [draw.choice(KINDS) for _ in range(draw.randrange(0, 7))])
            known.append((params, names))
            for _ in range(draw.randrange(0, 12)):
                payloads.append(payload())
                groups.append(len(known) - 1)
        payloads += [None, b"abc"]
        groups += [1, 0]
        mixed = draw.sample(range(len(groups)), len(groups))
        payloads, groups = [payloads[k] for k in mixed], [groups[k] for k in mixed]
        got = columns.decoded(pa.array([b"skipped", *payloads], pa.binary()).slice(1), np.array(groups), known, None).to_pylist()
        expected = []
        for data, g in zip(payloads, groups, strict=True):
            out: list[dict] = []
            if g:
                values.walk(data or b"", 0, known[g][0], {}.get, names, 0, out)
            expected.append([{f: v.get(f) for f, _ in columns.VALUE_TYPES} for v in out])
        assert repr(got) == repr(expected)  # NaN is itself


def test_nested_logs_go_row_by_row():
    params = [{"flags": flag("NESTED_LOG"), "type_id": 0, "param_name": None, "text": None, "type_name": None}]
    inner = [{"flags": flag("NUM_8"), "type_id": 0, "param_name": "k", "text": None, "type_name": None}]
    version = ({0: params, 1: inner}, {})
    got = columns.decoded(pa.array([struct.pack("<I", 1) + b"\x05"]), np.array([0]), [(params, {})], lambda data, k: values._values(data, 0, version)).to_pylist()
    assert [(v["kind"], v["i"], v["depth"]) for v in got[0]] == [("nested", None, 0), ("int", 5, 1)]


def test_faster_than_row_by_row():
    draw = random.Random(1)
    params, payload = made(draw, [("CSTR",), ("NUM_64",), ("NUM_8", "UNSIGNED"), ("NUM_64",), ("DOUBLE",), ("ENUM",), ("VARRAY", "STR")])
    some = pa.array([payload() for _ in range(10_000)], pa.binary())
    kind = pa.list_(pa.struct(columns.VALUE_TYPES))
    began = time.perf_counter()
    columns.decoded(some, np.zeros(len(some), np.int64), [(params, {})], None)
    by_columns = time.perf_counter() - began
    began = time.perf_counter()
    pa.array([values._values(d, 0, ({0: params}, {})) for d in some.to_pylist()], kind)
    assert 5 * by_columns < time.perf_counter() - began
