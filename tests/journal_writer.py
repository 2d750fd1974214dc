
from __future__ import annotations

import struct

from recscope.schema import FIRST, FLAGS, LAST, REC_TYPES

HEADER = struct.Struct("<QHHhBBI")


def slot(payload: bytes, rec_type: str, ts: int = 1, pid: int = 0, tid: int = 0, nesting: int = 0, termination: int = FIRST | LAST, severity: int = 0) -> bytes:
    return HEADER.pack(ts, pid, tid, nesting, termination, severity | REC_TYPES[rec_type] << 4, 0) + payload.ljust(44, b"\0")


def metadata(name: str, logs: list[tuple[int, int, list[dict]]], types: list[tuple[str, list[tuple[str, int]]]], base: int = 0x7F0000000000) -> bytes:
    """A blob: logs are (kind, severity, params), a param a dict of flags, type_id, name and text; types are (name, enumerators)."""
    at_logs = 0x100 + 24
    at_types = at_logs + 16 * len(logs)
    at_params = at_types + 24 * len(types)
    at_enums = at_params + 32 * sum(len(p) + 1 for _, _, p in logs)
    at_text = at_enums + 16 * sum(len(m) + 1 for _, m in types)
    texts = b"\0"

    def text(s: str | None) -> int:
        nonlocal texts
        if s is None:
            return 0
        texts += s.encode() + b"\0"
        return base + at_text + len(texts) - len(s.encode()) - 1

    log_part = param_part = type_part = enum_part = b""
    for kind, severity, params in logs:
        log_part += struct.pack("<iiQ", kind, severity, base + at_params + len(param_part))
        for p in params:
            param_part += struct.pack("<QQQQ", p["flags"], p.get("type_id", 0), text(p.get("name")), text(p.get("text")))
        param_part += bytes(32)
    for type_name, members in types:
        type_part += struct.pack("<iIQQ", 1, len(members), text(type_name), base + at_enums + len(enum_part))
        for member, value in members:
            enum_part += struct.pack("<QI4x", text(member), value)
        enum_part += bytes(16)
    return name.encode().ljust(0x100, b"\0") + struct.pack("<QQQ", base, len(logs), len(types)) + log_part + type_part + param_part + enum_part + texts


def metadata_slots(blob: bytes, pid: int) -> list[bytes]:
    out = [slot(struct.pack("<I", len(blob)), "METADATA_HEADER", pid=pid, termination=FIRST)]
    out += [slot(blob[k : k + 44], "METADATA_PAYLOAD", pid=pid, termination=0) for k in range(0, len(blob), 44)]
    return [*out, slot(b"", "METADATA_PAYLOAD", pid=pid, termination=LAST)]


def chunked(data: bytes) -> bytes:
    pieces = [data[k : k + 127] for k in range(0, len(data), 127)] or [b""]
    return b"".join(bytes([len(p) | (0x80 if k < len(pieces) - 1 else 0)]) + p for k, p in enumerate(pieces))


def record(log_id: int, payload: bytes, ts: int, pid: int, tid: int, nesting: int, severity: int) -> list[bytes]:
    data = struct.pack("<I", log_id) + payload
    parts = [data[k : k + 44] for k in range(0, len(data), 44)]
    ends = lambda k: (FIRST if k == 0 else 0) | (LAST if k == len(parts) - 1 else 0)
    return [slot(p, "TYPED", ts, pid, tid, nesting, ends(k), severity) for k, p in enumerate(parts)]


class Journal:
    def __init__(self, machine: str = "testhost", boot_us: int = 77) -> None:
        self.slots = [slot(machine.encode().ljust(24, b"\0") + struct.pack("<Q", boot_us), "FILE_HEADER")]
        self.meta: dict[int, int] = {}
        self.dump = 0

    def process(self, pid: int, blob: bytes) -> None:
        self.meta[pid] = len(self.slots)
        self.slots += metadata_slots(blob, pid)

    def add_dump(self, chunks: list[tuple[int, int, int, list[bytes]]]) -> None:
        """A dump of chunks (pid, severity mask, flush time, slots)."""
        at = len(self.slots)
        size = sum(1 + len(c[3]) for c in chunks)
        self.slots.append(slot(struct.pack("<III", self.dump, size, at + 1), "DUMP_HEADER", ts=min((c[2] for c in chunks), default=1)))
        previous = 0
        for pid, mask, flush, rows in chunks:
            here = len(self.slots)
            self.slots.append(slot(struct.pack("<IIIIQII", self.meta[pid], previous, at, 0, flush, len(rows), mask), "BUFFER_CHUNK", pid=pid))
            self.slots += rows
            previous = here
        self.dump = at

    def write(self, path) -> None:
        with open(path, "wb") as f:
            f.write(b"".join(self.slots))


def flag(*names: str) -> int:
    return sum(FLAGS[n] for n in names)
