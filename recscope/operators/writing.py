"""From records to slots: the layout of a journal, as a frame that ``sources.journal.write_journal`` writes.

A file has its header, the metadata of its processes, then dumps; a dump has its header and chunks, a chunk its header and the
slots of its records. Positions come from running sums over the chunks of a file and, within a chunk, over its records,
so no window is larger than a chunk or the list of a file's chunks. Chunks should have some 65,536 slots at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recscope.functions.wire import little_endian
from recscope.schema import FIRST, LAST, REC_TYPES
from recscope.scratch import stored

#: Bytes of a slot's payload.
ROOM = 44
COLUMNS = ("file", "pos", "ts_ns", "pid", "tid", "nesting", "termination", "severity", "rec_type", "generation", "payload")


def _slots(df: DataFrame, rec_type: str, **columns) -> DataFrame:
    """Slots of one type; fields that aren't named are zero, and payloads are filled up."""
    zero = {"ts_ns": F.lit(1).cast("bigint"), "generation": F.lit(0).cast("bigint"), "termination": F.lit(FIRST | LAST)}
    own = zero | {c: F.lit(0) for c in COLUMNS if c not in (*zero, "file", "pos", "payload")} | columns | {"rec_type": F.lit(REC_TYPES[rec_type])}
    kinds = {"pos": "bigint", "ts_ns": "bigint", "generation": "bigint", "file": "string", "payload": "binary"}
    filled = F.unhex(F.rpad(F.hex(own.get("payload", F.col("payload"))), 2 * ROOM, "0"))
    return df.select(*[(filled if c == "payload" else own.get(c, F.col(c))).cast(kinds.get(c, "int")).alias(c) for c in COLUMNS])


def _split(data: str, n: str):
    """(k, piece) for each slot's piece of ``data``."""
    each = F.sequence(F.lit(0), F.col(n) - 1)
    return F.explode(F.transform(each, lambda k: F.struct(k.alias("k"), F.substring(F.col(data), k * ROOM + 1, F.lit(ROOM)).alias("payload")))).alias("piece")


def journal_slots(records: DataFrame, processes: DataFrame, machine: str = "localhost", boot_time_us: int = 0) -> DataFrame:
    """The slots of a journal.

    ``processes``: file, pid, blob (the metadata); ``records``: file, dump, chunk (numbers whose order is the file's), pid, tid, ts_ns,
    nesting, severity, payload. A chunk has one process. Records of a chunk are in order of time, then of thread and payload.
    """
    file_payload = F.concat(F.unhex(F.lit(machine.encode()[:23].ljust(24, b"\0").hex())), little_endian(F.lit(boot_time_us), 8))
    in_file = Window.partitionBy("file").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sized = processes.withColumn("n", F.ceil(F.octet_length("blob") / ROOM).cast("bigint"))
    placed = sized.withColumn("meta_pos", F.coalesce(F.sum(F.col("n") + 2).over(in_file), F.lit(0)) + 1)
    header = _slots(processes.select("file").distinct(), "FILE_HEADER", pos=F.lit(0), payload=file_payload)
    opened = _slots(placed, "METADATA_HEADER", pos=F.col("meta_pos"), termination=F.lit(FIRST), payload=little_endian(F.octet_length("blob"), 4), pid=F.col("pid"))
    body = _slots(placed.select("file", "pid", "meta_pos", _split("blob", "n")), "METADATA_PAYLOAD", pos=F.col("meta_pos") + 1 + F.col("piece.k"), termination=F.lit(0), payload=F.col("piece.payload"), pid=F.col("pid"))
    closed = _slots(placed, "METADATA_PAYLOAD", pos=F.col("meta_pos") + 1 + F.col("n"), termination=F.lit(LAST), payload=F.lit("").cast("binary"), pid=F.col("pid"))
    ends = placed.groupBy("file").agg(F.max(F.col("meta_pos") + 2 + F.col("n")).alias("base"))

    counted = stored(records.withColumn("n", F.greatest(F.ceil(F.octet_length("payload") / ROOM), F.lit(1)).cast("bigint")), "records")  # payloads are made once, not for each part
    bit = F.expr("shiftleft(1, severity)")
    chunks = counted.groupBy("file", "dump", "chunk", "pid").agg(F.sum("n").alias("n_records"), F.max("ts_ns").alias("flush"), F.bit_or(bit).alias("mask"))
    by_chunk = Window.partitionBy("file").orderBy("dump", "chunk")
    first = (F.coalesce(F.lag("dump").over(by_chunk), F.col("dump") - 1) != F.col("dump")).cast("bigint")
    chunks = chunks.withColumn("first", first)
    size = F.col("n_records") + 1 + F.col("first")
    chunks = chunks.withColumn("before", F.sum(size).over(by_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_records") - 1)
    chunks = chunks.join(ends, "file").withColumn("chunk_pos", F.col("base") + F.col("before"))
    in_dump = Window.partitionBy("file", "dump").orderBy("chunk")
    chunks = chunks.withColumn("dump_pos", F.min("chunk_pos").over(Window.partitionBy("file", "dump")) - 1).withColumn("previous", F.coalesce(F.lag("chunk_pos").over(in_dump), F.lit(0)))
    chunks = chunks.join(placed.select("file", "pid", "meta_pos"), ["file", "pid"])
    u32 = lambda c: little_endian(F.col(c), 4)
    chunk_payload = F.concat(u32("meta_pos"), u32("previous"), u32("dump_pos"), little_endian(F.lit(0), 4), little_endian(F.col("flush"), 8), u32("n_records"), u32("mask"))
    chunk_heads = _slots(chunks, "BUFFER_CHUNK", pos=F.col("chunk_pos"), payload=chunk_payload, pid=F.col("pid"))
    dumps = chunks.groupBy("file", "dump", "dump_pos").agg(F.sum(F.col("n_records") + 1).alias("n"), F.min("flush").alias("ts_ns"))
    dumps = dumps.withColumn("previous", F.coalesce(F.lag("dump_pos").over(Window.partitionBy("file").orderBy("dump")), F.lit(0)))
    dump_payload = F.concat(u32("previous"), u32("n"), little_endian(F.col("dump_pos") + 1, 4))
    dump_heads = _slots(dumps, "DUMP_HEADER", pos=F.col("dump_pos"), ts_ns=F.col("ts_ns"), payload=dump_payload)

    in_chunk = Window.partitionBy("file", "dump", "chunk", "pid").orderBy("ts_ns", "tid", "payload").rowsBetween(Window.unboundedPreceding, -1)
    lined = counted.withColumn("offset", F.coalesce(F.sum("n").over(in_chunk), F.lit(0)))
    at = lined.join(chunks.select("file", "dump", "chunk", "pid", "chunk_pos"), ["file", "dump", "chunk", "pid"])
    pieces = at.select("file", "pid", "tid", "ts_ns", "nesting", "severity", "chunk_pos", "offset", "n", _split("payload", "n"))
    ends_of = F.when(F.col("piece.k") == 0, FIRST).otherwise(0) + F.when(F.col("piece.k") == F.col("n") - 1, LAST).otherwise(0)
    same = {c: F.col(c) for c in ("ts_ns", "pid", "tid", "nesting", "severity")}
    typed = _slots(pieces, "TYPED", pos=F.col("chunk_pos") + 1 + F.col("offset") + F.col("piece.k"), termination=ends_of, payload=F.col("piece.payload"), **same)
    out = header
    for part in (opened, body, closed, dump_heads, chunk_heads, typed):
        out = out.unionByName(part)
    return out
