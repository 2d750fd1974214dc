"""Dimensions of a journal: processes, descriptors and enumerators, decoded from its metadata slots.

A process writes its metadata as a header slot (with the size) and payload slots up to one marked LAST. A later blob of a
process id is another version under its own ``meta_pos``, so reused ids never mix; chunks name the version that they need.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recscope.operators.assemble import _u32
from recscope.schema import FLAGS, LAST, PARAM, REC_TYPES

NAME = 0x100
BLOBS = f"file string, meta_pos bigint, pid int, process_name string, descriptors array<struct<log_id:bigint,kind:int,severity:int,params:array<{PARAM}>>>, enums array<struct<type_id:bigint,type_name:string,idx:int,value:bigint,name:string>>"


def blobs(fragments: DataFrame) -> DataFrame:
    """(file, meta_pos, pid, blob): metadata of each process version; an error where its size isn't the announced one.

    Payload slots follow their header at consecutive positions of the same process id; a blob is at most a few megabytes.
    """
    meta = fragments.where(F.col("rec_type").isin(REC_TYPES["METADATA_HEADER"], REC_TYPES["METADATA_PAYLOAD"]))
    is_header = F.col("rec_type") == REC_TYPES["METADATA_HEADER"]
    own = Window.partitionBy("file", "pid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = meta.withColumn("meta_pos", F.last(F.when(is_header, F.col("pos")), ignorenulls=True).over(own)).where("meta_pos IS NOT NULL")
    # The slot that closes a blob holds no bytes of it.
    part = F.struct("pos", "payload", (~is_header & (F.col("termination").bitwiseAND(F.lit(LAST)) == 0)).alias("data"))
    joined = opened.groupBy("file", "pid", "meta_pos").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max(F.when(~is_header, F.col("termination").bitwiseAND(F.lit(LAST)))).alias("last"), F.max(F.when(is_header, _u32("payload", 0))).alias("size"))
    data = F.aggregate(F.filter("parts", lambda p: p["data"]), F.lit("").cast("binary"), lambda a, p: F.concat(a, p["payload"]))
    whole = joined.where("last <> 0").withColumn("data", data)
    short = F.raise_error(F.format_string("metadata of process %d at slot %d of %s is not as long as announced", "pid", "meta_pos", "file"))
    as_announced = (F.octet_length("data") >= F.col("size")) & (F.octet_length("data") < F.col("size") + 44)
    return whole.select("file", "meta_pos", "pid", F.when(as_announced, F.substring("data", F.lit(1), F.col("size").cast("int"))).otherwise(short.cast("binary")).alias("blob"))


def _text(data: bytes, at: int) -> str | None:
    if not 0 < at < len(data):
        return None
    return data[at : data.index(b"\0", at)].decode("utf-8", "replace")


def decode(data: bytes) -> tuple[str, list[dict], list[dict]]:
    """Process name, descriptors and enumerators of a blob; pointers are relative to the blob's own base address."""
    name = data[:NAME].split(b"\0")[0].decode("utf-8", "replace")
    base, n_logs, n_types = struct.unpack_from("<QQQ", data, NAME)
    at = NAME + 24
    logs = [struct.unpack_from("<iiQ", data, at + 16 * k) for k in range(n_logs)]
    types = [struct.unpack_from("<iIQQ", data, at + 16 * n_logs + 24 * k) for k in range(n_types)]
    descriptors = []
    for log_id, (kind, severity, params) in enumerate(logs):
        found, p = [], params - base
        while (entry := struct.unpack_from("<QQQQ", data, p))[0]:
            flags, type_id, param_name, text = entry
            shared = _text(data, text - base) if text else None
            constant = bool(flags & FLAGS["CSTR"])
            found.append({"flags": flags, "type_id": type_id, "param_name": _text(data, param_name - base) if param_name else None, "text": shared if constant else None, "type_name": None if constant else shared})
            p += 32
        descriptors.append({"log_id": log_id, "kind": kind, "severity": severity, "params": found})
    enums = []
    for type_id, (_, _, type_name, members) in enumerate(types):
        e, idx = members - base, 0
        while (entry := struct.unpack_from("<QQ", data, e))[0]:
            enums.append({"type_id": type_id, "type_name": _text(data, type_name - base), "idx": idx, "value": entry[1] & 0xFFFFFFFF, "name": _text(data, entry[0] - base)})
            e, idx = e + 16, idx + 1
    return name, descriptors, enums


def encode(name: str, logs: list[tuple[int, int, list[dict]]], types: list[tuple[str, list[tuple[str, int]]]], base: int = 0x7F0000000000) -> bytes:
    """The blob that ``decode`` reads: logs are (kind, severity, params), a param a dict of flags and maybe type_id, name and text (the
    constant, or the type's name); types are (name, enumerators with their values)."""
    at_params = NAME + 24 + 16 * len(logs) + 24 * len(types)
    at_enums = at_params + 32 * sum(len(p) + 1 for _, _, p in logs)
    at_text = at_enums + 16 * sum(len(m) + 1 for _, m in types)
    texts = bytearray(b"\0")

    def pointer(text: str | None) -> int:
        if text is None:
            return 0
        at = base + at_text + len(texts)
        texts.extend(text.encode() + b"\0")
        return at

    log_part, param_part, type_part, enum_part = bytearray(), bytearray(), bytearray(), bytearray()
    for kind, severity, params in logs:
        log_part += struct.pack("<iiQ", kind, severity, base + at_params + len(param_part))
        for p in params:
            param_part += struct.pack("<QQQQ", p["flags"], p.get("type_id", 0), pointer(p.get("name")), pointer(p.get("text")))
        param_part += bytes(32)
    for type_name, members in types:
        type_part += struct.pack("<iIQQ", 1, len(members), pointer(type_name), base + at_enums + len(enum_part))
        for member, value in members:
            enum_part += struct.pack("<QI4x", pointer(member), value)
        enum_part += bytes(16)
    return name.encode().ljust(NAME, b"\0") + struct.pack("<QQQ", base, len(logs), len(types)) + log_part + type_part + param_part + enum_part + texts


def dimensions(fragments: DataFrame) -> DataFrame:
    """(file, meta_pos, pid, process_name, descriptors, enums): a row for each version of a process."""

    def decoded(batches):
        for batch in batches:
            rows = []
            for file, meta_pos, pid, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name, descriptors, enums = decode(blob)
                rows.append({"file": file, "meta_pos": meta_pos, "pid": pid, "process_name": name, "descriptors": descriptors, "enums": enums})
            yield pa.RecordBatch.from_pylist(rows, schema=_schema())

    return blobs(fragments).mapInArrow(decoded, BLOBS)


def versions(known: DataFrame) -> DataFrame:
    """(digest, version, process_name, descriptors, enums): a row for each blob of its own among ``known`` (digest, blob), decoded once.

    Files of a journal repeat the metadata of their processes; what is equal has one number. Numbers hold for one reading of the rows, so they are to be stored.
    """

    def decoded(batches):
        for batch in batches:
            rows = []
            for digest, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name, descriptors, enums = decode(blob)
                rows.append({"digest": digest, "process_name": name, "descriptors": descriptors, "enums": enums})
            schema = _schema()
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("digest", pa.string()), *(schema.field(c) for c in ("process_name", "descriptors", "enums"))]))

    own = known.groupBy("digest").agg(F.first("blob").alias("blob"))
    return own.mapInArrow(decoded, f"digest string, {BLOBS.partition('pid int, ')[2]}").withColumn("version", F.monotonically_increasing_id())


def _schema() -> pa.Schema:
    param = pa.struct([("flags", pa.int64()), ("type_id", pa.int64()), ("param_name", pa.string()), ("text", pa.string()), ("type_name", pa.string())])
    log = pa.struct([("log_id", pa.int64()), ("kind", pa.int32()), ("severity", pa.int32()), ("params", pa.list_(param))])
    enum = pa.struct([("type_id", pa.int64()), ("type_name", pa.string()), ("idx", pa.int32()), ("value", pa.int64()), ("name", pa.string())])
    return pa.schema([("file", pa.string()), ("meta_pos", pa.int64()), ("pid", pa.int32()), ("process_name", pa.string()), ("descriptors", pa.list_(log)), ("enums", pa.list_(enum))])


def processes(dims: DataFrame) -> DataFrame:
    return dims.select("file", "meta_pos", "pid", "process_name")


def log_descriptors(dims: DataFrame, on: tuple[str, ...] = ("file", "meta_pos")) -> DataFrame:
    return dims.select(*on, F.explode("descriptors").alias("d")).select(*on, "d.*")


def enum_values(dims: DataFrame) -> DataFrame:
    return dims.select("file", "meta_pos", F.explode("enums").alias("e")).select("file", "meta_pos", "e.*")


def file_headers(fragments: DataFrame) -> DataFrame:
    """(file, machine_id, boot_time_us): attributes of the files that begin with a header."""
    head = fragments.where((F.col("pos") == 0) & (F.col("rec_type") == REC_TYPES["FILE_HEADER"]))
    machine = F.regexp_replace(F.decode(F.substring("payload", 1, 24), "UTF-8"), "\x00.*$", "")
    return head.select("file", machine.alias("machine_id"), (_u32("payload", 24) + _u32("payload", 28) * (1 << 32)).alias("boot_time_us"))
