"""Data source ``trace_records``: records written as a journal, in batch and as a stream.

    write_records(records, processes, "/logs")
    stream_records(stream, processes, "/logs", checkpoint)

``records``: pid, tid, ts_ns, nesting, severity, payload. ``processes``: (pid, blob), a table in the shared folder, of which a task reads the
processes that it meets. Every task cuts its records into chunks of one process of up to ``slotsPerChunk`` slots, dumps of such
chunks, and files of up to ``slotsPerFile`` slots, so neither a process nor a file is one task's, and what a task holds is bounded by ``HELD`` slots. A
file has its header and each process's metadata once. Beside it goes a zone map: place, size, process, severities, least and
greatest time of each chunk.

Files appear with the commit of the write or of the stream's batch, in one new version of the folder's log (``sources.manifest``). A batch that is run again changes
nothing. A record larger than a chunk or a file has one of its own; null payloads are empty. A slot whose
time is zero counts as never written, so a time that is zero or null becomes 1.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from recscope.schema import FIRST, LAST, REC_TYPES
from recscope.sources import manifest
from recscope.sources.journal import LAYOUT, ZONES, put_threads

COLUMNS = ("pid", "tid", "ts_ns", "nesting", "severity", "payload")
ROOM = 44
#: Slots that a task holds before it writes a dump.
HELD = 262_144


def slots_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(slots of all records, number of slots of each)."""
    of = {c: batch.column(batch.schema.get_field_index(c)) for c in COLUMNS}
    payload = of["payload"].fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(payload.buffers()[1], np.int64)[payload.offset : payload.offset + len(payload) + 1]
    size = np.diff(offsets)
    n = np.maximum(-(-size // ROOM), 1)
    first = np.cumsum(n) - n
    room = np.zeros(int(n.sum()) * ROOM, np.uint8)
    if size.sum():
        data = np.frombuffer(payload.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        room[np.arange(len(data)) + np.repeat(first * ROOM - (offsets[:-1] - offsets[0]), size)] = data
    out = np.zeros(int(n.sum()), LAYOUT)
    for name in ("pid", "ts_ns", "nesting"):
        out[name] = np.repeat(of[name].fill_null(0).to_numpy(zero_copy_only=False).astype(LAYOUT[name]), n)
    out["ts_ns"] = np.maximum(out["ts_ns"], 1)
    severity = of["severity"].fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint8)
    out["kinds"] = np.repeat((severity & 15) | REC_TYPES["TYPED"] << 4, n)
    out["bits"][first] |= FIRST
    out["bits"][first + n - 1] |= LAST
    put_threads(out, np.repeat(of["tid"].fill_null(0).to_numpy(zero_copy_only=False), n))
    out["payload"] = room.view("V44")
    return out, n


def _slot(rec_type: str, payload: bytes, pid: int = 0, ts_ns: int = 1, bits: int = FIRST | LAST) -> np.ndarray:
    out = np.zeros(1, LAYOUT)
    out["ts_ns"], out["pid"], out["bits"], out["kinds"] = ts_ns, pid, bits, REC_TYPES[rec_type] << 4
    out["payload"] = np.frombuffer(payload.ljust(ROOM, b"\0"), "V44")
    return out


def metadata_slots(pid: int, blob: bytes) -> np.ndarray:
    pieces = [_slot("METADATA_PAYLOAD", blob[k : k + ROOM], pid, bits=0) for k in range(0, len(blob), ROOM)]
    return np.concatenate([_slot("METADATA_HEADER", struct.pack("<I", len(blob)), pid, bits=FIRST), *pieces, _slot("METADATA_PAYLOAD", b"", pid, bits=LAST)])


@dataclass
class _File:
    """A file that is being written."""

    temporary: str
    sink: pa.NativeFile
    at: int = 0
    dump: int = 0
    metadata: dict[int, int] = field(default_factory=dict)
    zones: list[tuple] = field(default_factory=list)

    def put(self, slots: np.ndarray) -> None:
        self.sink.write(slots.tobytes())
        self.at += len(slots)


@dataclass
class Files(WriterCommitMessage):
    """Files of a task: temporary path and what the log says of them."""

    files: list[tuple[str, dict]]


class _Task:
    """The files of one task."""

    def __init__(self, options: dict) -> None:
        self.system, self.folder, _ = manifest.opened(options["path"])
        self.per_file = int(options.get("slotsPerFile", 4_000_000))
        self.per_chunk = min(int(options.get("slotsPerChunk", 65_536)), max(self.per_file // 2, 1))
        self.header = options.get("machine", "localhost").encode()[:23].ljust(24, b"\0") + struct.pack("<Q", int(options.get("bootTime", 0)))
        self.processes = options["processes"]
        self.held: dict[int, list[np.ndarray]] = {}
        self.n_held = 0
        self.blobs: dict[int, np.ndarray] = {}
        self.now: _File | None = None
        self.done: list[tuple[str, dict]] = []

    def blob(self, pid: int) -> np.ndarray:
        if pid not in self.blobs:
            system, at, _ = manifest.opened(self.processes)
            found = ds.dataset(at, filesystem=system, format="parquet").to_table(["blob"], filter=ds.field("pid") == pid).column("blob").to_pylist()
            if not found:
                raise ValueError(f"no metadata of process {pid}")
            self.blobs[pid] = metadata_slots(pid, found[0])
        return self.blobs[pid]

    def add(self, batch: pa.RecordBatch) -> None:
        slots, n = slots_of(batch)
        pids = slots["pid"][np.cumsum(n) - n]
        order = np.argsort(pids, kind="stable")
        # Records by process, each with all of its slots.
        first, n, pids = (np.cumsum(n) - n)[order], n[order], pids[order]
        upto = np.cumsum(n)
        slots = slots[np.arange(len(slots)) + np.repeat(first - (upto - n), n)]
        edges = np.flatnonzero(np.append(True, pids[1:] != pids[:-1]))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(pids)], strict=True):
            for x, y in self._cuts(n[a:b]):
                self.held.setdefault(int(pids[a]), []).append(slots[upto[a + x] - n[a + x] : upto[a + y - 1]])
        self.n_held += len(slots)
        if self.n_held >= HELD:
            self.flush()

    def _cuts(self, n: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of records whose slots fit a chunk."""
        a, size = 0, 0
        for k, x in enumerate(n.tolist()):
            if size and size + x > self.per_chunk:
                yield a, k
                a, size = k, 0
            size += x
        yield a, len(n)

    def flush(self) -> None:
        """Write what is held: chunks in dumps, a dump in one file."""
        chunks: list[tuple[int, np.ndarray]] = []
        for pid, runs in sorted(self.held.items()):
            own: list[np.ndarray] = []
            for run in runs:
                if own and sum(map(len, own)) + len(run) > self.per_chunk:
                    chunks.append((pid, np.concatenate(own)))
                    own = []
                own.append(run)
            chunks.append((pid, np.concatenate(own)))
        self.held.clear()
        self.n_held = 0
        while chunks:
            self._open(chunks[0])
            size, n, new = 1, 0, set()
            for pid, slots in chunks:
                more = len(slots) + 1 + (0 if pid in self.now.metadata or pid in new else len(self.blob(pid)))
                if n and self.now.at + size + more > self.per_file:
                    break
                size, n = size + more, n + 1
                new.add(pid)
            self._dump(chunks[:n])
            chunks = chunks[n:]

    def _open(self, chunk: tuple[int, np.ndarray]) -> None:
        """A file that has room for a chunk, or a new one."""
        if self.now is not None:
            need = 2 + len(chunk[1]) + (0 if chunk[0] in self.now.metadata else len(self.blob(chunk[0])))
            if self.now.at + need <= self.per_file:
                return
            self.close()
        self.system.create_dir(f"{self.folder}/_unfinished", recursive=True)
        temporary = f"{self.folder}/_unfinished/{uuid.uuid4().hex}"
        self.now = _File(temporary, self.system.open_output_stream(temporary))
        self.now.put(_slot("FILE_HEADER", self.header))

    def _dump(self, chunks: list[tuple[int, np.ndarray]]) -> None:
        file = self.now
        for pid, _ in chunks:
            if pid not in file.metadata:
                file.metadata[pid] = file.at
                file.put(self.blob(pid))
        at, previous = file.at, 0
        file.put(_slot("DUMP_HEADER", struct.pack("<III", file.dump, sum(len(s) + 1 for _, s in chunks), at + 1), ts_ns=int(min(s["ts_ns"].min() for _, s in chunks))))
        for pid, slots in chunks:
            here, low, high = file.at, int(slots["ts_ns"].min()), int(slots["ts_ns"].max())
            mask = int(np.bitwise_or.reduce(np.uint32(1) << (slots["kinds"] & 15).astype(np.uint32)))
            file.put(_slot("BUFFER_CHUNK", struct.pack("<IIIIQII", file.metadata[pid], previous, at, 0, high, len(slots), mask), pid))
            file.put(slots)
            file.zones.append((here, len(slots), pid, mask, low, high))
            previous = here
        file.dump = at

    def close(self) -> None:
        file = self.now
        file.sink.close()
        zones = np.array(file.zones, ZONES)
        with self.system.open_output_stream(f"{file.temporary}.npy") as f:
            f.write(zones.tobytes())
        about = {"slots": file.at, "low": int(zones["low"].min()), "high": int(zones["high"].max()), "pids": sorted(set(zones["pid"].tolist())), "mask": int(np.bitwise_or.reduce(zones["mask"]))}
        self.done.append((file.temporary, about))
        self.now = None

    def files(self) -> Files:
        if self.held:
            self.flush()
        if self.now is not None:
            self.close()
        return Files(self.done)


class _Writing:
    """What the batch and the stream writer share."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        task = _Task(self.options)
        for batch in iterator:
            if batch.num_rows:
                task.add(batch)
        return task.files()

    def _publish(self, messages: list[Files | None], name: str, query: str | None, epoch: int) -> None:
        system, folder, _ = manifest.opened(self.options["path"])
        now = manifest.state(self.options["path"])
        if query is not None and now is not None and now.epochs.get(query, -1) >= epoch:
            self._undo(messages)
            return
        add = []
        system.create_dir(f"{folder}/_zones", recursive=True)
        for k, (temporary, about) in enumerate(f for m in messages if m for f in m.files):
            own = f"trace.{name}.{k:05d}.dump"
            system.move(f"{temporary}.npy", f"{folder}/_zones/{own}.npy")
            system.move(temporary, f"{folder}/{own}")
            add.append({"name": own, **about})
        manifest.append(self.options["path"], add, query=query, epoch=epoch)

    def _undo(self, messages: list[Files | None]) -> None:
        system, _, _ = manifest.opened(self.options["path"])
        for temporary, _ in (f for m in messages if m for f in m.files):
            for p in (temporary, f"{temporary}.npy"):
                system.delete_file(p)


class BatchWriter(_Writing, DataSourceArrowWriter):
    def commit(self, messages: list[Files | None]) -> None:
        self._publish(messages, uuid.uuid4().hex[:12], None, 0)

    def abort(self, messages: list[Files | None]) -> None:
        self._undo(messages)


class StreamWriter(_Writing, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Files | None], batchId: int) -> None:  # noqa: N803
        query = self.options["query"]
        self._publish(messages, f"{query}.{batchId:08d}", query, batchId)

    def abort(self, messages: list[Files | None], batchId: int) -> None:  # noqa: N803
        self._undo(messages)


class TraceRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trace_records"

    def schema(self) -> str:
        return "pid int, tid int, ts_ns bigint, nesting int, severity int, payload binary"

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:  # noqa: N802
        return StreamWriter(self.options)


def write_records(records: DataFrame, processes: str, path: str, **options: str | int) -> None:
    """Add records to the journal in a folder, by ranges of time, so that chunks and files are narrow in time."""
    records.sparkSession.dataSource.register(TraceRecords)
    ranged = records.select(*COLUMNS).repartitionByRange("ts_ns", "pid", "tid").sortWithinPartitions("ts_ns")
    ranged.write.format("trace_records").mode("append").options(path=path, processes=processes, **options).save()


def stream_records(stream: DataFrame, processes: str, path: str, checkpoint: str, query: str = "live", **options: str | int) -> StreamingQuery:
    """Add a stream of records to the journal in a folder, a version for each batch; ``query`` names the stream in the folder's log."""
    stream.sparkSession.dataSource.register(TraceRecords)
    writer = stream.select(*COLUMNS).writeStream.format("trace_records").options(path=path, processes=processes, query=query, **options)
    return writer.option("checkpointLocation", checkpoint).start()


def zones(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(file, at, n, pid, mask, low, high): the chunks of a journal by its zone maps, as of a version; no record is read.

    A journal without a log has no zone maps, and no rows.
    """
    now = manifest.state(path, version)
    schema = "file string, at bigint, n bigint, pid int, mask bigint, low bigint, high bigint"
    if now is None or not now.files:
        return spark.createDataFrame([], schema)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                z = np.frombuffer(data.as_py(), ZONES)
                fields = [pa.array(np.ascontiguousarray(z[c]).astype(np.int32 if c == "pid" else np.int64)) for c in ZONES.names]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(z), pa.string()), *fields], names=["file", *ZONES.names])

    place = path if "://" in path else f"file://{path.removeprefix('file:')}"
    found = spark.read.format("binaryFile").load(f"{place}/_zones").select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("file"), "content")
    live = spark.createDataFrame([(name,) for name in now.files], "file string")
    return found.join(live, "file", "left_semi").mapInArrow(parsed, schema)
