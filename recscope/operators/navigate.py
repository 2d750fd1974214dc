"""Order and navigation: next and previous records, searches, callers, seeking by time.

A cursor is a record's place, a dict of the order's columns. One step is a filter and a bounded ``orderBy().limit()``, which
Spark runs as the best rows of each partition and then of all; no full sort. Backward is the exact mirror of forward.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recscope.functions.matchers import Matcher, anything
from recscope.operators.buckets import nearest
from recscope.schema import ORDER_KEY

SECOND = 1_000_000_000


def beyond(cursor: dict, key: tuple[str, ...] = ORDER_KEY, forward: bool = True) -> Column:
    """Whether a row lies strictly after (or before) the cursor, column by column."""
    out, same = F.lit(False), F.lit(True)
    for c in key:
        step = F.col(c) > F.lit(cursor[c]) if forward else F.col(c) < F.lit(cursor[c])
        out, same = out | (same & step), same & (F.col(c) == F.lit(cursor[c]))
    return out


def step(records: DataFrame, cursor: dict | None, n: int = 1, matcher: Matcher | None = None, key: tuple[str, ...] = ORDER_KEY, forward: bool = True) -> DataFrame:
    """The next (or previous) ``n`` matching records from the cursor, nearest first; without a cursor from the start (or end)."""
    found = records.where((matcher or anything()).record)
    if cursor is not None:
        found = found.where(beyond(cursor, key, forward))
    return found.orderBy(*[F.col(c) if forward else F.col(c).desc() for c in key]).limit(n)


def find(records: DataFrame, cursor: dict | None, expression: Matcher, installed: Matcher | None = None, key: tuple[str, ...] = ORDER_KEY, forward: bool = True) -> DataFrame:
    """The first record that passes both the installed filter and the expression; empty on a miss."""
    return step(records, cursor, 1, expression & installed if installed else expression, key, forward)


def find_text(records: DataFrame, line: Column, text: str, cursor: dict | None, key: tuple[str, ...] = ORDER_KEY, forward: bool = True) -> DataFrame:
    """The first record whose written line contains ``text``."""
    return step(records.where(line.contains(text)), cursor, 1, None, key, forward)


def nearest_match(records: DataFrame, matcher: Matcher, by: tuple[str, ...], order: tuple[str, ...], out: str, width: int, time: str = "ts_ns", forward: bool = True) -> DataFrame:
    """Add ``out``: for each record the last column of ``order`` of the nearest matching one of the same ``by``."""
    targets = records.where(matcher.record).select(*by, *order, F.col(order[-1]).alias(out))
    return nearest(records, targets, list(by), list(order), [out], F.call_function("div", F.col(time), F.lit(width)), forward)


def same_level(records: DataFrame, order: tuple[str, ...], out: str, width: int, time: str = "ts_ns", thread: tuple[str, ...] = ("tid",)) -> DataFrame:
    """Add ``out``: the next record of the same thread at the same nesting (of a call: its return)."""
    targets = records.select(*thread, "nesting", *order, F.col(order[-1]).alias(out))
    return nearest(records, targets, [*thread, "nesting"], list(order), [out], F.call_function("div", F.col(time), F.lit(width)), True)


def caller(records: DataFrame, order: tuple[str, ...], out: str, width: int, time: str = "ts_ns", thread: tuple[str, ...] = ("tid",), forward: bool = False) -> DataFrame:
    """Add ``out``: the latest earlier (or next later) record of the same thread one level up."""
    seekers = records.withColumn("_level", F.col("nesting") - 1)
    targets = records.select(*thread, F.col("nesting").alias("_level"), *order, F.col(order[-1]).alias(out))
    return nearest(seekers, targets, [*thread, "_level"], list(order), [out], F.call_function("div", F.col(time), F.lit(width)), forward).drop("_level")


def from_time(records: DataFrame, ts_ns: int) -> DataFrame:
    """Records from a time on; with files sorted by time, those before are skipped by their statistics."""
    return records.where(F.col("ts_ns") >= ts_ns)


def first_dump(dumps: DataFrame, ts_ns: int) -> DataFrame:
    """(file, dump_pos) of the last dump of each file that begins at or before a time, or else its first one."""
    place = F.struct("ts_ns", "dump_pos")
    return dumps.groupBy("file").agg(F.coalesce(F.max_by("dump_pos", F.when(F.col("ts_ns") <= ts_ns, place)), F.min_by("dump_pos", place)).alias("dump_pos"))


def ends(records: DataFrame, key: tuple[str, ...] = ORDER_KEY) -> DataFrame:
    """One row: the least and the greatest place, and the position columns of both."""
    place = F.struct(*key)
    return records.agg(F.min(place).alias("first"), F.max(place).alias("last"))


def headers_around(fragments: DataFrame, rec_type: int, width: int = 65_536) -> DataFrame:
    """Slots with ``header_pos``: the nearest earlier slot of a type in the same file."""
    targets = fragments.where(F.col("rec_type") == rec_type).select("file", "pos", F.col("pos").alias("header_pos"))
    return nearest(fragments, targets, ["file"], ["pos"], ["header_pos"], F.call_function("div", F.col("pos"), F.lit(width)))


def tagged(*streams: DataFrame) -> DataFrame:
    """Several inputs as one, each with its number as ``stream``."""
    return reduce(DataFrame.unionByName, [s.withColumn("stream", F.lit(k)) for k, s in enumerate(streams)])


def merged(*streams: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Several ordered inputs as one in order; of equal keys the earlier input comes first."""
    return tagged(*streams).orderBy(*key, "stream")
