"""Payloads to values: an Arrow function that reads records of one descriptor together (``sources.columns``), and walks a descriptor's
parameters over one record's bytes where it has a nested log.

Nested logs follow in pre-order with their depth. A nested log whose number is unknown, or bytes that end early, stop
the record's decoding; the values before them stay. Doubles and byte buffers are passed over in full.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recscope.functions.matchers import Limit, Matcher
from recscope.operators.assemble import accepted_chunks, chunks, described, in_chunks, reassemble, with_descriptor
from recscope.schema import FLAGS, ORDER_KEY, REC_TYPES, VALUE
from recscope.scratch import stored
from recscope.sources import columns, metadata
from recscope.sources.columns import VALUE_TYPES
from recscope.sources.journal import Slots

#: Bytes of descriptors and enumerators (written as JSON) that are broadcast, at most.
BROADCAST = 64_000_000
#: All slots but those of records.
HEADERS = Limit("rec_type", among=tuple(n for name, n in REC_TYPES.items() if name != "TYPED"))
INTEGERS = {"NUM_8": ("<B", "<b"), "NUM_16": ("<H", "<h"), "NUM_32": ("<I", "<i"), "NUM_64": ("<Q", "<q")}


def chunked(data: bytes, at: int) -> tuple[bytes, int]:
    """A byte string in pieces of up to 127 bytes, each after its length; the high bit says that another one follows."""
    out = b""
    while True:
        size = data[at]
        end = at + 1 + (size & 0x7F)
        if end > len(data):
            raise IndexError
        out += data[at + 1 : end]
        at = end
        if not size & 0x80:
            return out, at


def walk(data: bytes, at: int, params: list[dict], logs: Callable[[int], list[dict] | None], enums: dict, depth: int, out: list[dict]) -> int:
    """Append the values of ``params`` from ``data[at:]``; where the next one begins, or -1 if decoding stopped."""
    for idx, p in enumerate(params):
        flags = p["flags"]
        value = {"idx": idx, "depth": depth, "name": p["param_name"], "flags": flags, "type_name": p["type_name"]}
        try:
            if flags & FLAGS["NESTED_LOG"]:
                (log_id,) = struct.unpack_from("<I", data, at)
                inner = logs(log_id)
                if inner is None:
                    out.append(value | {"kind": "unknown_log", "u": Decimal(log_id)})
                    return -1
                out.append(value | {"kind": "nested"})
                at = walk(data, at + 4, inner, logs, enums, depth + 1, out)
                if at < 0:
                    return -1
            elif flags & FLAGS["CSTR"]:
                out.append(value | {"kind": "cstr", "s": p["text"]})
            elif flags & FLAGS["VARRAY"]:
                piece, at = chunked(data, at)
                out.append(value | ({"kind": "str", "s": piece.decode("utf-8", "replace"), "b": piece} if flags & FLAGS["STR"] else {"kind": "bytes", "b": piece}))
            elif flags & FLAGS["ENUM"]:
                (u,) = struct.unpack_from("<I", data, at)
                out.append(value | {"kind": "enum", "i": u, "u": Decimal(u), "s": enums.get((p["type_id"], u))})
                at += 4
            elif flags & FLAGS["DOUBLE"]:
                (d,) = struct.unpack_from("<d", data, at)
                out.append(value | {"kind": "double", "d": d})
                at += 8
            else:
                for name, (unsigned, signed) in INTEGERS.items():
                    if flags & FLAGS[name]:
                        (u,), (i,) = struct.unpack_from(unsigned, data, at), struct.unpack_from(signed, data, at)
                        out.append(value | {"kind": "int", "i": i, "u": Decimal(u)})
                        at += struct.calcsize(unsigned)
        except (struct.error, IndexError):
            return -1
    return at


def _version(logs: list[dict] | None, names: list[dict] | None) -> tuple[dict, dict]:
    """What ``walk`` asks of a process version: parameters by descriptor, enumerators by type and value."""
    return {x["log_id"]: x["params"] for x in logs or []}, {(x["type_id"], x["value"]): x["name"] for x in names or []}


def _values(data: bytes | None, log_id: int | None, version: tuple[dict, dict]) -> list[dict]:
    by_id, names = version
    out: list[dict] = []
    if log_id in by_id:
        walk(data or b"", 0, by_id[log_id], by_id.get, names, 0, out)
    return [{f: v.get(f) for f, _ in VALUE_TYPES} for v in out]


def with_values(records: DataFrame, dims: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``values`` to records of (file, meta_pos, log_id), or of (version, log_id) where ``dims`` are ``metadata.versions``: their decoded parameters;
    none for unknown descriptors.

    Dimensions of up to ``BROADCAST`` bytes are broadcast. Beyond that each record is joined with its own descriptor and the enumerators
    of its types; only records with a nested log carry the descriptors of their process.
    """
    size = dims.agg(F.coalesce(F.sum(F.length(F.to_json("descriptors")) + F.length(F.to_json("enums"))), F.lit(0))).first()[0]
    kind = pa.list_(pa.struct([(f, t) for f, t in VALUE_TYPES]))
    by_version = "version" in dims.columns
    on = ["version"] if by_version else ["file", "meta_pos"]
    if size <= BROADCAST:
        place = [F.lit(None).cast("string").alias("file"), F.col("version").alias("meta_pos")] if by_version else on
        known = {(r["file"], r["meta_pos"]): _version(r["descriptors"], r["enums"]) for r in dims.select(*place, "descriptors", "enums").toArrow().to_pylist()}
        shared = records.sparkSession.sparkContext.broadcast(known)

        @F.arrow_udf(f"array<{VALUE}>")
        def decoded(payloads: pa.Array, files: pa.Array, at: pa.Array, numbers: pa.Array) -> pa.Array:
            # A row's descriptor is a triple of codes; each distinct one is looked up once.
            names = files.dictionary_encode()
            key = np.stack([names.indices.fill_null(-1).to_numpy(), at.fill_null(-1).to_numpy(zero_copy_only=False), numbers.fill_null(-1).to_numpy(zero_copy_only=False)])
            some, groups = np.unique(key, axis=1, return_inverse=True)
            versions = [shared.value.get((names.dictionary[int(f)].as_py() if f >= 0 else None, int(m)), ({}, {})) for f, m, _ in some.T]
            known = [(v[0][int(n)], v[1]) if int(n) in v[0] else None for v, n in zip(versions, some[2], strict=True)]
            return columns.decoded(payloads, groups.ravel(), known, lambda data, k: _values(data, int(some[2, k]), versions[k]))

        return records.withColumn("values", decoded(payload, *([F.lit(None).cast("string"), "version"] if by_version else on), "log_id"))

    @F.arrow_udf(f"array<{VALUE}>")
    def decoded_by_row(payloads: pa.Array, numbers: pa.Array, own: pa.Array, names: pa.Array, logs: pa.Array) -> pa.Array:
        out = []
        for d, n, x, e, more in zip(payloads.to_pylist(), numbers.to_pylist(), own.to_pylist(), names.to_pylist(), logs, strict=True):
            version = _version(more.as_py() or ([] if x is None else [{"log_id": n, "params": x}]), e)
            out.append(_values(d, n, version))
        return pa.array(out, kind)

    each = metadata.log_descriptors(dims, tuple(on))
    nested = F.exists("params", lambda p: p["flags"].bitwiseAND(F.lit(FLAGS["NESTED_LOG"])) != 0)
    types = F.transform(F.filter("params", lambda p: p["flags"].bitwiseAND(F.lit(FLAGS["ENUM"])) != 0), lambda p: p["type_id"])
    enums = dims.select(*on, F.col("enums").alias("_enums"), F.col("descriptors").alias("_all"))
    facts = each.join(enums, on).select(
        *on, "log_id", F.col("params").alias("_own"), F.when(nested, F.col("_enums")).otherwise(F.filter("_enums", lambda e: F.array_contains(types, e["type_id"]))).alias("_names"), F.when(nested, F.col("_all")).alias("_logs")
    )
    joined = records.join(facts, [*on, "log_id"], "left")
    return joined.withColumn("values", decoded_by_row(payload, "log_id", "_own", "_names", "_logs")).drop("_own", "_names", "_logs")


def records_of(source: DataFrame | Slots, matcher: Matcher | None = None) -> DataFrame:
    """Log records of a journal: chunks pruned by ``matcher``, fragments re-assembled, joined with the dimensions, decoded and filtered.

    What the matcher says of descriptors is asked of the dimension, once each, and only records of those that can match are decoded.

    Metadata and chunk headers, small tables, are written once. Of a journal given as ``Slots`` only headers are read for
    them, and then only the chunks that can match. Equal metadata of many files is one version, decoded once, that records name by its number.

    Columns: file, dump_pos, chunk_idx, pos, ts_ns, pid, tid, nesting, severity, log_id, process_name, kind, function,
    const_strs, type_names, values.
    """
    parts = isinstance(source, Slots)
    heads = source.read(HEADERS) if parts else source
    fragments = source.read(Limit("rec_type", among=(REC_TYPES["TYPED"],)), *(matcher.limits if matcher else ())) if parts else source
    known = stored(metadata.blobs(heads).withColumn("digest", F.sha2("blob", 256)), "blobs")
    dims = stored(metadata.versions(known.select("digest", "blob")), "versions")
    named = chunks(heads).join(known.select("file", "meta_pos", "digest"), ["file", "meta_pos"]).join(dims.select("digest", "version", "process_name"), "digest").drop("digest")
    kept = stored(accepted_chunks(named, matcher) if matcher else named, "chunks")
    slots = in_chunks(fragments, kept, of="version")
    whole = reassemble(slots, carry=("dump_pos", "chunk_idx", "version", "nesting"))
    numbered = whole.select("*", F.conv(F.concat(*[F.hex(F.substring("payload", k, 1)) for k in (4, 3, 2, 1)]), 16, 10).cast("bigint").alias("log_id"))
    logs = described(metadata.log_descriptors(dims, ("version",))).drop("severity", "params")
    if matcher:
        logs = logs.where(matcher.of_logs()[0])
    joined = with_descriptor(numbered, logs, ("version", "log_id")).join(dims.select("version", "process_name"), "version")
    body = joined.withColumn("payload", F.substring("payload", F.lit(5), F.octet_length("payload")))
    columns = [*ORDER_KEY[:2], "chunk_idx", "pos", "ts_ns", "pid", "tid", "nesting", "severity", "log_id", "process_name", "kind", "function", "const_strs", "type_names", "values"]
    found = with_values(body, dims).select(*columns)
    return found.where(matcher.record) if matcher else found
