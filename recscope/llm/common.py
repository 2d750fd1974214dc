"""What the corpus operators share: scratch tables, folds, slices of texts and the memory of worker processes."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recscope.scratch import stored

#: Rows of a small table that one task writes, about; tasks that any table gets at least.
ROWS, TASKS = 5_000, 6
_remembered: dict[str, dict] = {}
__all__ = ["bits_for", "cut", "few", "fold", "kept_memory", "looked_up", "released", "remembered", "stored", "text_or_empty", "unused"]

_libc = ctypes.CDLL(None)
_SPACE = re.compile(r"\s")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remembered(operator: str) -> dict:
    """What this worker process keeps for an operator. Asking for it forgets what all others have kept: a worker is used
    again by later stages, whose tables would add up."""
    if operator not in _remembered:
        _remembered.clear()
        gc.collect()
        released()
        _remembered[operator] = {}
    return _remembered[operator]


def released() -> None:
    """Give freed memory back: it would stay this process's, beside the memory of its executor and of other workers."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def kept_memory(most: int = 64_000_000) -> None:
    """Have this process use freed memory again for arrays of up to ``most`` bytes, which it would otherwise map and clear anew each time."""
    if hasattr(_libc, "mallopt"):
        _libc.mallopt(-3, most)  # M_MMAP_THRESHOLD
        _libc.mallopt(-1, 2 * most)  # M_TRIM_THRESHOLD


def cut(text: str, size: int = 2_000_000) -> Iterator[str]:
    """A text in slices of about ``size`` characters, cut at white space."""
    at = 0
    while len(text) - at > size and (m := _SPACE.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def bits_for(n: int, per_bucket: int, least: int = 0) -> int:
    """Bits of a prefix that leaves about ``per_bucket`` of ``n`` items in a bucket."""
    bits = least
    while n > per_bucket << bits:
        bits += 1
    return bits


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows, in one partition for ``ROWS`` of them at most: before it is written or shuffled anew. Each task writes three
    files for a shuffle and two for a table, so many partitions of few rows take more disk than what is in them."""
    return df.coalesce(max(TASKS, -(-rows // ROWS)))


def looked_up(rows: DataFrame, facts: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` (a stored table) joined with ``facts``, whose keys are unique.

    Keys that over a thousandth of the rows ask for are joined by broadcast; there are a thousand of them at most. All other keys
    are shuffled, a thousandth of the rows each at most.
    """
    asked = rows.groupBy(*on).agg(F.count("*").alias("_asked"))
    hot = asked.where(F.col("_asked") > max(1000, rows.count() // 1000)).select(*on)
    hot_facts = stored(facts.join(F.broadcast(hot), on, "left_semi"), "hot")
    by_hot = rows.join(F.broadcast(hot_facts), on)
    cold = rows.join(F.broadcast(hot_facts.select(*on)), on, "left_anti").join(facts, on, how)
    return by_hot.unionByName(cold)
