"""Data source ``trace_journal``: files of 64-byte slots as the ``fragments`` table, in batch and as a stream.

    spark.dataSource.register(TraceJournal)
    spark.read.format("trace_journal").load("/logs/trace.*.dump")
    spark.readStream.format("trace_journal").load("/logs")

A file is cut into ranges of ``slotsPerPartition`` slots, each read and decoded by one task as one numpy view, in Arrow
batches; small files are read by one task together. Paths are local or any that Arrow's file systems open (``hdfs://``, ``s3://``); a folder stands for the files in it,
a pattern for its matches. Only whole slots count: a cut last slot is left out, as is an empty file. A file that doesn't
begin with a file header is an error unless ``requireHeader`` is ``false`` (later files of a rotation have none). A thread beyond 65535
has its upper bits in the field of the generation, and a mark for that; slots of other threads are as the format has them.

``Slots`` names a journal and reads parts of it: limits on ``file``, ``pos``, ``rec_type``, ``pid``, ``severity`` and ``ts_ns``
go to the reader as an option. Ranges and files outside are not read, and tasks go from one chunk header to the next and pass
over the chunks whose process, severities or flush time rule a match out (all of them, where only headers are asked for). A chunk
that begins before a task's range is read there slot by slot. (Spark's own way of pushing filters into Python sources keeps them with the
relation, so two filters on one frame would get mixed up.)

A folder with a log (``sources.manifest``, written by ``sources.record_sink``) is read as of one version (``version``, or the latest one when the read is
planned). Files whose bounds in the log rule a match out are not opened, and of the others' records only the chunks are read that their zone map lets through.

Written (``write_journal``), a frame of slots becomes a file for each ``file``; its slots must come in order of ``pos``, from 0. Files
appear when the whole write has ended.

As a stream, an offset is the number of whole slots of each file, so a growing file is followed and new files
are picked up. A batch takes at most ``slotsPerBatch`` slots past the last offset that was planned (no bound if unset), shared
out over the files that have more. So that the bound holds after a restart too, the planned offset is kept in the file that ``progress`` names. (A query
with the trigger ``availableNow`` takes one batch of a Python source; ``live.drained`` takes all.)
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from recscope.functions.matchers import Limit
from recscope.schema import FRAGMENTS, REC_TYPES, SLOT
from recscope.sources import manifest

#: The slot as written on a 64-bit little-endian machine.
LAYOUT = np.dtype([("ts_ns", "<u8"), ("pid", "<u2"), ("tid", "<u2"), ("nesting", "<i2"), ("bits", "u1"), ("kinds", "u1"), ("generation", "<u4"), ("payload", "V44")])
#: Of a slot's six reserved bits: its thread doesn't fit 16 bits, and the generation's field holds the upper 16 bits of the thread and the lower ones of the generation.
WIDE = 4
ARROW = pa.schema(
    [("file", pa.string()), ("pos", pa.int64()), ("ts_ns", pa.int64()), ("pid", pa.int32()), ("tid", pa.int32()), ("nesting", pa.int32()), ("termination", pa.int32()), ("severity", pa.int32()), ("rec_type", pa.int32()), ("generation", pa.int64()), ("payload", pa.binary())]
)
#: A zone map: place, size, process, severities, least and greatest time of each chunk of a file.
ZONES = np.dtype([("at", "<i8"), ("n", "<i8"), ("pid", "<i4"), ("mask", "<u4"), ("low", "<i8"), ("high", "<i8")])
READ_SLOTS = 65_536
#: Slots of small files that one task reads, at most: 8 MB.
PACKED = 131_072
#: Slots that are read at first to find a chunk header.
HEAD = 64


def threads_of(slots: np.ndarray) -> np.ndarray:
    """Threads of slots: those marked ``WIDE`` have the upper 16 bits of theirs beside the generation."""
    high = np.where(slots["bits"] & WIDE, slots["generation"] >> 16, 0).astype(np.uint32)
    return (high << 16 | slots["tid"]).view(np.int32)


def put_threads(slots: np.ndarray, tid: np.ndarray) -> None:
    """Set the threads of slots, numbers of 32 bits; ``bits`` and ``generation`` are there before."""
    own = tid.astype(np.int32).view(np.uint32)
    wide = own >> 16 != 0
    if wide.any():
        if (slots["generation"][wide] >> 16).any():
            raise ValueError("a slot holds no thread beyond 65535 beside a generation beyond 65535")
        slots["generation"] |= own >> 16 << 16
        slots["bits"][wide] |= WIDE
    slots["tid"] = own & 0xFFFF


def decode_slots(data: bytes, file: str, first: int) -> pa.RecordBatch:
    """Slots as a batch of fragments; ``first``: the position of the first one."""
    slots = np.frombuffer(data, LAYOUT)
    payload = np.ascontiguousarray(slots["payload"])
    packed = pa.Array.from_buffers(pa.binary(44), len(slots), [None, pa.py_buffer(payload.tobytes())]).cast(pa.binary())
    columns = [
        pa.array([file] * len(slots), pa.string()),
        np.arange(first, first + len(slots)),
        slots["ts_ns"].astype(np.int64),
        slots["pid"].astype(np.int32),
        threads_of(slots),
        slots["nesting"].astype(np.int32),
        (slots["bits"] & 3).astype(np.int32),
        (slots["kinds"] & 15).astype(np.int32),
        (slots["kinds"] >> 4).astype(np.int32),
        np.where(slots["bits"] & WIDE, slots["generation"] & 0xFFFF, slots["generation"]).astype(np.int64),
        packed,
    ]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=ARROW)


def encode_slots(batch: pa.RecordBatch) -> bytes:
    """A batch of fragments as slots."""
    slots = np.zeros(batch.num_rows, LAYOUT)
    of = {name: batch.column(name) for name in batch.schema.names}
    for name in ("ts_ns", "pid", "nesting", "generation"):
        slots[name] = of[name].to_numpy(zero_copy_only=False).astype(np.int64).astype(LAYOUT[name])
    slots["bits"] = of["termination"].to_numpy(zero_copy_only=False) & 3
    put_threads(slots, of["tid"].to_numpy(zero_copy_only=False))
    slots["kinds"] = (of["severity"].to_numpy(zero_copy_only=False) & 15) | (of["rec_type"].to_numpy(zero_copy_only=False) << 4)
    slots["payload"] = of["payload"].to_numpy(zero_copy_only=False)
    return slots.tobytes()


_opened = manifest.opened


def listed(path: str, recursive: bool = False, version: int | None = None) -> list[tuple[str, int]]:
    """(file, whole slots) of a file, a folder or a pattern in a folder, by name; ``recursive``: with folders in it. A folder
    with a log has the files of one of its versions."""
    system, at, scheme = _opened(path)
    if (logged := manifest.state(path, version)) is not None:
        return sorted((f"{scheme}{at}/{name}", f["slots"]) for name, f in logged.files.items())
    folder, _, pattern = at.rpartition("/")
    if any(c in pattern for c in "*?["):
        found = [i for i in system.get_file_info(fs.FileSelector(folder, recursive=recursive)) if fnmatch(i.base_name, pattern)]
    else:
        own = system.get_file_info(at)
        if own.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = system.get_file_info(fs.FileSelector(at, recursive=recursive)) if own.type == fs.FileType.Directory else [own]
    base = len(folder if any(c in pattern for c in "*?[") else at)
    files = (i for i in found if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")) and "/_" not in i.path[base:])
    return sorted((scheme + i.path, i.size // SLOT) for i in files)


@dataclass
class Wanted:
    """What is asked of slots: bounds (inclusive) and sets by column."""

    low: dict[str, int] = field(default_factory=dict)
    high: dict[str, int] = field(default_factory=dict)
    among: dict[str, set] = field(default_factory=dict)

    def add(self, limit: Limit) -> None:
        name = limit.column
        if limit.among is not None:
            self.among[name] = self.among.get(name, set(limit.among)) & set(limit.among)
        if limit.low is not None:
            self.low[name] = max(self.low.get(name, limit.low), limit.low)
        if limit.high is not None:
            self.high[name] = min(self.high.get(name, limit.high), limit.high)

    def text(self) -> str:
        return json.dumps({"low": self.low, "high": self.high, "among": {c: sorted(v) for c, v in self.among.items()}})

    @classmethod
    def of(cls, text: str | None) -> Wanted | None:
        if not text:
            return None
        found = json.loads(text)
        return cls(found["low"], found["high"], {c: set(v) for c, v in found["among"].items()})

    def by_chunk(self) -> bool:
        """Whether chunk headers can rule chunks out."""
        return bool(self.among.keys() & {"pid", "severity"}) or "ts_ns" in self.low or ("rec_type" in self.among and REC_TYPES["TYPED"] not in self.among["rec_type"])

    def passes(self, pid: int, mask: int, flush: int) -> bool:
        """Whether a chunk can hold a wanted slot."""
        if "rec_type" in self.among and REC_TYPES["TYPED"] not in self.among["rec_type"]:
            return False
        if "pid" in self.among and pid not in self.among["pid"]:
            return False
        if "severity" in self.among and not any(mask >> n & 1 for n in self.among["severity"] if 0 <= n < 32):
            return False
        return flush >= self.low.get("ts_ns", flush)

    def file(self, about: dict) -> bool:
        """Whether a file can hold a wanted record, by what its folder's log says; only of those that ask for records alone."""
        if self.among.get("rec_type") != {REC_TYPES["TYPED"]}:
            return True
        return (
            about["low"] <= self.high.get("ts_ns", about["low"]) and about["high"] >= self.low.get("ts_ns", about["high"])
            and ("pid" not in self.among or bool(self.among["pid"] & set(about["pids"])))
            and ("severity" not in self.among or any(about["mask"] >> n & 1 for n in self.among["severity"] if 0 <= n < 32))
        )

    def zones(self, zones: np.ndarray) -> np.ndarray:
        """Which chunks can hold a wanted record."""
        keep = (zones["low"] <= self.high.get("ts_ns", 1 << 62)) & (zones["high"] >= self.low.get("ts_ns", -(1 << 62)))
        if "pid" in self.among:
            keep &= np.isin(zones["pid"], [p for p in self.among["pid"] if abs(p) < 1 << 31])
        if "severity" in self.among:
            keep &= zones["mask"] & sum(1 << n for n in self.among["severity"] if 0 <= n < 32) != 0
        return keep

    def rows(self, slots: np.ndarray, first: int) -> np.ndarray:
        """Which slots are wanted; ``first``: the position of the first one."""
        columns = {"pos": np.arange(first, first + len(slots)), "rec_type": slots["kinds"] >> 4, "severity": slots["kinds"] & 15, "pid": slots["pid"], "ts_ns": slots["ts_ns"].astype(np.int64)}
        keep = np.ones(len(slots), bool)
        for name, c in columns.items():
            if name in self.among:
                keep &= np.isin(c.astype(np.int64), [v for v in self.among[name] if v < 1 << 63])
            if name in self.low:
                keep &= c >= self.low[name]
            if name in self.high:
                keep &= c <= self.high[name]
        return keep


class Range(InputPartition):
    def __init__(self, file: str, begin: int, end: int, checked: bool, wanted: Wanted | None = None) -> None:
        self.file, self.begin, self.end, self.checked, self.wanted = file, begin, end, checked, wanted


class Several(InputPartition):
    """Ranges that one task reads, one after another."""

    def __init__(self, ranges: list[Range]) -> None:
        self.ranges, self.file = ranges, ranges[0].file


def packed(ranges: list[Range], most: int) -> list[Range | Several]:
    """Neighbouring ranges as one partition, up to ``most`` slots, so small files don't need a task each."""
    out: list[list[Range]] = []
    size = most
    for r in ranges:
        if size + r.end - r.begin > most:
            out.append([])
            size = 0
        out[-1].append(r)
        size += r.end - r.begin
    return [some[0] if len(some) == 1 else Several(some) for some in out]


def _ranges(file: str, begin: int, end: int, size: int, checked: bool, wanted: Wanted | None = None) -> list[Range]:
    return [Range(file, a, min(a + size, end), checked and a == 0, wanted) for a in range(begin, end, size)]


def extents(read_at, begin: int, end: int, wanted: Wanted | None) -> Iterator[tuple[int, bytes]]:
    """(position of the first, slots): all slots of a range but those of chunks that are ruled out."""
    by_chunk = wanted is not None and wanted.by_chunk()
    k, size = begin, HEAD if by_chunk else READ_SLOTS
    while k < end:
        data = read_at(k, min(size, end - k))
        n = len(data) // SLOT
        if not n:
            return
        heads = np.flatnonzero(np.frombuffer(data, LAYOUT)["kinds"] >> 4 == REC_TYPES["BUFFER_CHUNK"]) if by_chunk else ()
        if not len(heads):
            yield k, data
            k, size = k + n, min(size * 2, READ_SLOTS)
            continue
        at = int(heads[0])
        yield k, data[: (at + 1) * SLOT]
        header = np.frombuffer(data, LAYOUT, 1, at * SLOT)[0]
        payload = bytes(header["payload"]).ljust(44, b"\0")
        flush, n_records, mask = struct.unpack_from("<QII", payload, 16)
        first, size = k + at + 1, HEAD
        k = first + n_records
        if wanted.passes(int(header["pid"]), mask, flush):
            last = min(k, end)
            for p in range(first, last, READ_SLOTS):
                yield p, read_at(p, min(READ_SLOTS, last - p))


def zoned(read_at, begin: int, end: int, wanted: Wanted, zones: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(position of the first, slots) of the records in chunks that a zone map lets through."""
    for z in zones[wanted.zones(zones)]:
        first, last = max(int(z["at"]) + 1, begin), min(int(z["at"] + z["n"]) + 1, end)
        for k in range(first, last, READ_SLOTS):
            yield k, read_at(k, min(READ_SLOTS, last - k))


def _zones_of(system: fs.FileSystem, at: str) -> np.ndarray | None:
    folder, _, name = at.rpartition("/")
    path = f"{folder}/_zones/{name}.npy"
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), ZONES)


def _read(part: Range | Several) -> Iterator[pa.RecordBatch]:
    if isinstance(part, Several):
        for one in part.ranges:
            yield from _read(one)
        return
    if part.begin == part.end:
        return
    system, at, _ = _opened(part.file)
    # A zone map answers for records; headers are found by going from one to the next.
    zones = _zones_of(system, at) if part.wanted is not None and part.wanted.among.get("rec_type") == {REC_TYPES["TYPED"]} else None
    with system.open_input_file(at) as data:
        read_at = lambda k, n: data.read_at(n * SLOT, k * SLOT)
        for k, found in extents(read_at, part.begin, part.end, part.wanted) if zones is None else zoned(read_at, part.begin, part.end, part.wanted, zones):
            if part.checked and k == 0 and found[15] >> 4 != REC_TYPES["FILE_HEADER"]:
                raise ValueError(f"{part.file} does not begin with a file header")
            batch = decode_slots(found, part.file, k)
            if part.wanted is not None:
                batch = batch.filter(pa.array(part.wanted.rows(np.frombuffer(found, LAYOUT), k)))
            yield batch


class _Options:
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.per_partition = int(options.get("slotsPerPartition", 2_000_000))
        self.checked = str(options.get("requireHeader", "true")).lower() != "false"
        self.recursive = str(options.get("recursive", "false")).lower() == "true"
        self.wanted = Wanted.of(options.get("wanted"))
        self.latest = options.get("startingOffsets", "earliest") == "latest"
        self.per_batch = int(options.get("slotsPerBatch", 0))
        self.progress = options.get("progress")
        self.version = int(options["version"]) if "version" in options else None


class JournalReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = _Options(options)

    def partitions(self) -> list[Range]:
        o, w = self.options, self.options.wanted or Wanted()
        at = w.among.get("pos")
        begin = max(0, w.low.get("pos", 0), *([min(at)] if at else []))
        out = []
        logged = manifest.state(o.path, o.version)
        about = logged.files if logged is not None else {}
        for file, n in listed(o.path, o.recursive, logged.version if logged is not None else None):
            if (own := about.get(file.rpartition("/")[2])) is not None and not w.file(own):
                continue
            end = min(n, w.high.get("pos", n) + 1, *([max(at) + 1] if at else []))
            if file in w.among.get("file", {file}):
                out += _ranges(file, begin, end, o.per_partition, o.checked, o.wanted)
        return packed(out, min(PACKED, o.per_partition)) or [Range("", 0, 0, False)]

    def read(self, partition: Range | Several) -> Iterator[pa.RecordBatch]:
        return _read(partition)


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: where they are and where they go."""

    files: list[tuple[str, str]]


class JournalWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder, _ = _opened(self.path)
        system.create_dir(f"{folder}/_unfinished", recursive=True)
        files: list[tuple[str, str]] = []
        name, sink, at = None, None, 0
        for batch in iterator:
            names = batch.column("file").to_pylist()
            edges = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                some = batch.slice(a, b - a)
                if names[a] != name:
                    if sink is not None:
                        sink.close()
                    name, at = names[a], 0
                    files.append((f"{folder}/_unfinished/{uuid.uuid4().hex}", f"{folder}/{name.rpartition('/')[2]}"))
                    sink = system.open_output_stream(files[-1][0])
                if not np.array_equal(some.column("pos").to_numpy(), np.arange(at, at + len(some))):
                    raise ValueError(f"slots of {name} do not follow one another from 0")
                sink.write(encode_slots(some))
                at += len(some)
        if sink is not None:
            sink.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder, _ = _opened(self.path)
        for temporary, final in (f for m in messages if m for f in m.files):
            if not self.overwrite and system.get_file_info(final).type != fs.FileType.NotFound:
                raise FileExistsError(final)
            system.move(temporary, final)
        system.delete_dir(f"{folder}/_unfinished")

    def abort(self, messages: list[Written | None]) -> None:
        system, _, _ = _opened(self.path)
        for temporary, _ in (f for m in messages if m for f in m.files):
            system.delete_file(temporary)


@dataclass(frozen=True)
class Slots:
    """A journal that is read in parts."""

    spark: SparkSession
    path: str
    options: dict = field(default_factory=dict)

    def read(self, *limits: Limit) -> DataFrame:
        """The slots within all limits."""
        self.spark.dataSource.register(TraceJournal)
        wanted = Wanted()
        for limit in limits:
            wanted.add(limit)
        own = {"wanted": wanted.text()} if limits else {}
        return self.spark.read.format("trace_journal").options(**own, **self.options).load(self.path)


def write_journal(fragments: DataFrame, path: str, mode: str = "append") -> None:
    """Write slots as files of a journal, one for each ``file``, which one task writes: a file has its cap."""
    fragments.sparkSession.dataSource.register(TraceJournal)
    columns = [c.split()[0] for c in FRAGMENTS.split(", ")]
    fragments.select(*columns).repartition("file").sortWithinPartitions("file", "pos").write.format("trace_journal").mode(mode).save(path)


class JournalStreamReader(DataSourceStreamReader):
    """Offsets are whole slots by file."""

    def __init__(self, options: dict) -> None:
        self.options = _Options(options)
        self.planned: dict[str, int] | None = None

    def _there(self) -> dict[str, int]:
        return dict(listed(self.options.path, self.options.recursive))

    def initialOffset(self) -> dict:
        self.planned = self._there() if self.options.latest else {}
        return {"files": json.dumps(self.planned)}

    def latestOffset(self) -> dict:
        there = self._there()
        if self.options.per_batch:
            if self.planned is None:
                self.planned = self._kept()
            if self.planned is not None:
                there = bounded(self.planned, there, self.options.per_batch)
        return {"files": json.dumps(there)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        self.planned = after
        self._keep(end["files"])
        o = self.options
        return [r for file, n in sorted(after.items()) for r in _ranges(file, before.get(file, 0), n, o.per_partition, o.checked)] or [Range("", 0, 0, False)]

    def _kept(self) -> dict[str, int] | None:
        """The offset that was planned last, before a restart."""
        if not self.options.progress:
            return None
        system, at, _ = _opened(self.options.progress)
        if system.get_file_info(at).type == fs.FileType.NotFound:
            return None
        with system.open_input_file(at) as f:
            return json.loads(f.read())

    def _keep(self, offset: str) -> None:
        if self.options.progress:
            system, at, _ = _opened(self.options.progress)
            system.create_dir(at.rpartition("/")[0], recursive=True)
            with system.open_output_stream(f"{at}.new") as f:
                f.write(offset.encode())
            system.move(f"{at}.new", at)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(partition)


def bounded(before: dict[str, int], there: dict[str, int], most: int) -> dict[str, int]:
    """Offsets at most ``most`` slots past ``before``: an equal share for every file with more, what a file leaves goes to the next ones."""
    out, left = {f: before[f] for f in there if f in before}, most
    news = sorted(((n - before.get(f, 0), f) for f, n in there.items() if n > before.get(f, 0)))
    for k, (more, f) in enumerate(news):
        take = min(more, max(left // (len(news) - k), 1 if left else 0))
        if take:
            out[f] = before.get(f, 0) + take
            left -= take
    return out


class TraceJournal(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trace_journal"

    def schema(self) -> str:
        return FRAGMENTS

    def reader(self, schema: StructType) -> JournalReader:
        return JournalReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> JournalWriter:
        return JournalWriter(self.options, overwrite)

    def streamReader(self, schema: StructType) -> JournalStreamReader:
        return JournalStreamReader(self.options)
