"""From slots to records: dumps, chunks, re-assembly of fragments, and joins with the dimensions.

The joins carry no broadcast hint: dimensions are small as a rule, and Spark broadcasts them by their measured size at run
time, or sorts and merges where they are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recscope.functions.matchers import Matcher
from recscope.schema import FIRST, KINDS, LAST, ORDER_KEY, REC_TYPES

#: Slots of a bucket in which chunks and slots meet.
BUCKET = 65_536
SLOT_KEY = ("file", "pid", "tid", "severity", "ts_ns")


def _u32(payload: str, at: int) -> Column:
    """A little-endian 32-bit number at a byte of the payload."""
    return F.conv(F.concat(*[F.hex(F.substring(payload, at + k, 1)) for k in (4, 3, 2, 1)]), 16, 10).cast("bigint")


def dumps(fragments: DataFrame) -> DataFrame:
    """(file, dump_pos, prev_dump_pos, first_chunk_pos, n_slots, ts_ns): dump headers."""
    return fragments.where(F.col("rec_type") == REC_TYPES["DUMP_HEADER"]).select(
        "file", F.col("pos").alias("dump_pos"), _u32("payload", 0).alias("prev_dump_pos"), _u32("payload", 8).alias("first_chunk_pos"), _u32("payload", 4).alias("n_slots"), "ts_ns"
    )


def chunks(fragments: DataFrame) -> DataFrame:
    """(file, dump_pos, chunk_idx, chunk_pos, pid, flush_ts_ns, n_records, severity_mask, meta_pos): chunk headers."""
    at = fragments.where(F.col("rec_type") == REC_TYPES["BUFFER_CHUNK"]).select(
        "file", _u32("payload", 8).alias("dump_pos"), F.col("pos").alias("chunk_pos"), "pid", "ts_ns", _u32("payload", 24).alias("n_records"), _u32("payload", 28).cast("int").alias("severity_mask"), _u32("payload", 0).alias("meta_pos"),
        (_u32("payload", 16) + _u32("payload", 20) * (1 << 32)).alias("flush_ts_ns"),
    )
    ranked = Window.partitionBy("file", "dump_pos").orderBy("chunk_pos")  # a dump has three chunks for each process
    return at.withColumn("chunk_idx", F.row_number().over(ranked) - 1).select("file", "dump_pos", "chunk_idx", "chunk_pos", "pid", "flush_ts_ns", "n_records", "severity_mask", "meta_pos")


def accepted_chunks(chunks_: DataFrame, matcher: Matcher) -> DataFrame:
    """Chunks that can hold a matching record, by their headers alone."""
    return chunks_.where(matcher.may)


def in_chunks(fragments: DataFrame, chunks_: DataFrame, of: str = "meta_pos") -> DataFrame:
    """Typed slots within the extent of one of ``chunks_``, with the chunk's dump, index and metadata (``of``: the column that names it).

    A range join: chunks are listed under every bucket of slots that they touch, so slots meet only chunks of
    their own bucket. A slot whose time is zero has never been written.
    """
    first, last = F.col("chunk_pos") + 1, F.col("chunk_pos") + F.col("n_records")
    spread = chunks_.where("n_records > 0").select("file", "dump_pos", "chunk_idx", "chunk_pos", of, last.alias("last_pos"), F.explode(F.sequence(F.call_function("div", first, F.lit(BUCKET)), F.call_function("div", last, F.lit(BUCKET)))).alias("bucket"))
    typed = fragments.where((F.col("rec_type") == REC_TYPES["TYPED"]) & (F.col("ts_ns") != 0)).withColumn("bucket", F.call_function("div", F.col("pos"), F.lit(BUCKET)))
    met = typed.join(spread, ["file", "bucket"]).where("pos > chunk_pos AND pos <= last_pos")
    return met.drop("bucket", "chunk_pos", "last_pos")


def reassemble(fragments: DataFrame, key: tuple[str, ...] = SLOT_KEY, order: str = "pos", carry: tuple[str, ...] = ()) -> DataFrame:
    """Records from fragments: one from each FIRST up to the next LAST of its key, payloads joined in order.

    Fragments before a FIRST or after a LAST, and records without a LAST, are dropped. Records of a single fragment
    don't take part in the shuffle. ``carry``: columns taken from the first fragment. Repeated ``order`` within a
    key is broken by payload. A key holds one record's fragments as a rule (all of one nanosecond of one thread).
    """
    bits = F.col("termination")
    whole = bits.bitwiseAND(F.lit(FIRST | LAST)) == FIRST | LAST
    columns = [*key, order, *carry]
    own = Window.partitionBy(*key).orderBy(order, "payload").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = fragments.where(~whole)
    opened = parts.withColumn("_n", F.count_if(bits.bitwiseAND(F.lit(FIRST)) != 0).over(own)).where("_n > 0")
    within = Window.partitionBy(*key, "_n").orderBy(order, "payload").rowsBetween(Window.unboundedPreceding, -1)
    inside = opened.withColumn("_closed", F.coalesce(F.count_if(bits.bitwiseAND(F.lit(LAST)) != 0).over(within), F.lit(0))).where("_closed = 0")
    part = F.struct(F.col(order).alias("at"), F.col("payload").alias("payload"), *[F.col(c) for c in carry])
    joined = inside.groupBy(*key, "_n").agg(F.array_sort(F.collect_list(part)).alias("_parts"), F.max(bits.bitwiseAND(F.lit(LAST))).alias("_last")).where("_last <> 0")
    first = F.col("_parts")[0]
    empty = F.lit("").cast(fragments.schema["payload"].dataType)
    payload = F.aggregate(F.col("_parts"), empty, lambda a, p: F.concat(a, p["payload"]))
    many = joined.select(*key, first["at"].alias(order), *[first[c].alias(c) for c in carry], payload.alias("payload"), F.size("_parts").alias("n_fragments"))
    return fragments.where(whole).select(*columns, "payload", F.lit(1).alias("n_fragments")).unionByName(many)


def with_descriptor(records: DataFrame, descriptors: DataFrame, on: tuple[str, ...] = ("file", "meta_pos", "log_id")) -> DataFrame:
    """Records joined with their descriptor; those of an unknown descriptor are dropped: they match no filter."""
    own = set(records.columns) - set(on)
    return records.join(descriptors.drop(*[c for c in descriptors.columns if c in own]), list(on))


def with_enum_names(values: DataFrame, enums: DataFrame, on: tuple[str, ...], value: str, out: str = "enum_name") -> DataFrame:
    """Add ``out``: the enumerator of a value, looked up by value; ``<? enum>`` if there is none. Of several the last defined counts."""
    last = enums.groupBy(*on, F.col("value").alias(value)).agg(F.max_by("name", "idx").alias(out))
    return values.join(last, [*on, value], "left").withColumn(out, F.coalesce(out, F.lit("<? enum>")))


def enum_value(enums: DataFrame, name: str) -> int | None:
    """The value of an enumerator anywhere in the metadata; of several definitions the last one counts."""
    found = enums.where(F.col("name") == name).orderBy(F.col("file").desc(), F.col("meta_pos").desc(), F.col("idx").desc()).select("value").first()
    return None if found is None else found[0]


def enumerator(name: str, enums: DataFrame) -> int:
    """The value that a filter by an enumerator's name asks for, as ``any_param`` and ``named_param`` take it; unknown names are an error."""
    value = enum_value(enums, name)
    if value is None:
        raise ValueError(f"no enumerator is named {name!r}")
    return value


def described(descriptors: DataFrame) -> DataFrame:
    """Add what filters ask of a descriptor, once for each: ``function``, ``const_strs``, ``type_names``."""
    is_call = F.col("kind").isin(KINDS["FUNC_ENTRY"], KINDS["FUNC_LEAVE"])
    texts = F.filter(F.transform("params", lambda p: p["text"]), lambda t: t.isNotNull())
    types = F.filter(F.transform("params", lambda p: p["type_name"]), lambda t: t.isNotNull())
    return descriptors.withColumns({"function": F.when(is_call, F.get(F.col("params"), F.lit(0))["text"]), "const_strs": texts, "type_names": types})


def functions_of(descriptors: DataFrame) -> DataFrame:
    """(file, function): names of traced functions."""
    return described(descriptors).where((F.col("kind") == KINDS["FUNC_ENTRY"]) & F.col("function").isNotNull()).select("file", "function").distinct()


def known_names(descriptors: DataFrame, prefix: str = "") -> DataFrame:
    """(name,): constant texts and function names, those that begin with ``prefix``."""
    own = described(descriptors)
    names = own.select(F.explode("const_strs").alias("name")).union(own.where("function IS NOT NULL").select("function")).distinct()
    return names.where(F.startswith("name", F.lit(prefix)))


def in_order(records: DataFrame, key: tuple[str, ...] = ORDER_KEY) -> DataFrame:
    return records.orderBy(*key)
