"""Counts by template, occupancy, rates, load-shedding, rotation and retention."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recscope.functions.formatting import least_severity
from recscope.operators.buckets import numbered
from recscope.schema import SLOT

#: Worst severity; seconds that a raised level is held at least.
WORST, HOLD = 6, 10


def template_counts(records: DataFrame, templates: DataFrame, on: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, template, occurrences), rarest first: counted by descriptor, then joined with its text and added up by text."""
    counted = records.groupBy(*on).agg(F.count("*").alias("n"))
    named = counted.join(templates.select(*on, "template"), on)
    return named.groupBy(*(by or []), "template").agg(F.sum("n").alias("occurrences")).orderBy("occurrences", *(by or []), "template")


def template_totals(counts: DataFrame) -> DataFrame:
    """(n_templates, n_records) of the counts by template."""
    return counts.agg(F.count("*").alias("n_templates"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("n_records"))


def ring_occupancy(slots: DataFrame, flushed: DataFrame, by: list[str], capacity: Column) -> DataFrame:
    """Unflushed slots of each ring, their percentage of ``capacity``, and its band: green below 50, yellow below 80, red.

    ``flushed``: ``by`` and ``flushed_ns``; slots of a ring without one are all unflushed. Percentages are of whole
    hundredths, as the capacity div 100 goes.
    """
    met = slots.join(flushed, by, "left").where("ts_ns <> 0")
    counted = met.groupBy(*by).agg(F.count_if(F.col("ts_ns") > F.coalesce("flushed_ns", F.lit(0))).alias("n_unflushed"), F.first(capacity).alias("capacity"))
    percent = F.call_function("div", F.col("n_unflushed"), F.greatest(F.call_function("div", F.col("capacity"), F.lit(100)), F.lit(1)))
    return counted.withColumn("percent", percent).withColumn("band", F.when(F.col("percent") < 50, "green").when(F.col("percent") < 80, "yellow").otherwise("red"))


def occupancy_bar(unflushed: DataFrame, by: list[str], index: str, capacity: int, cells: int = 59) -> DataFrame:
    """(by, bar): a cell is ``#`` if a slot of its range is unflushed, else ``_``."""
    size = max(1, capacity // (cells + 1))
    cell = F.least(F.call_function("div", F.greatest(F.col(index) - 1, F.lit(0)), F.lit(size)), F.lit(cells - 1))
    full = unflushed.groupBy(*by).agg(F.collect_set(cell).alias("_full"))
    return full.select(*by, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda k: F.when(F.array_contains("_full", k), "#").otherwise("_")), "").alias("bar"))


def rates(records: DataFrame, by: list[str], seconds: int = 1, time: str = "ts_ns") -> DataFrame:
    """(by, second, n): records of each interval that has any; ``second`` is its begin since the epoch."""
    begin = F.call_function("div", F.col(time), F.lit(seconds * 1_000_000_000)) * seconds
    return records.groupBy(*by, begin.alias("second")).agg(F.count("*").alias("n"))


def shedding(counts: DataFrame, by: list[str], limit: int) -> DataFrame:
    """(by, second, n, level): the least severity level let through after each interval.

    An interval of more than ``limit`` records raises the level by one, to 6 at most, and holds it for ten seconds; later
    ones below the limit lower it by one. The fold runs over one session (``by``, a day say): an entry for each interval,
    86,400 a day and no record of them.
    """
    kinds = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in by)

    def fold(key: tuple, session: pa.Table) -> pa.Table:
        session = session.sort_by("second")
        levels, level, until = [], 0, -1
        for second, n in zip(session.column("second").to_pylist(), session.column("n").to_pylist(), strict=True):
            if n > limit:
                level, until = min(level + 1, WORST), second + HOLD
            elif level and second > until:
                level -= 1
            levels.append(level)
        return session.append_column("level", pa.array(levels, pa.int32()))

    own = counts.select(*by, F.col("second").cast("bigint").alias("second"), F.col("n").cast("bigint").alias("n"))
    return own.groupBy(*by).applyInArrow(fold, f"{kinds}, second bigint, n bigint, level int")


def shed(records: DataFrame, levels: DataFrame, by: list[str], mask: Column, seconds: int = 1, time: str = "ts_ns") -> DataFrame:
    """Records that are let through: those of a ring (severities ``mask``) are skipped while its least severity, plus one, is not above the
    level that the session's intervals before have led to.

    ``levels``: what ``shedding`` returns. Before the first interval the level is zero.
    """
    before = levels.select(*by, "second", F.coalesce(F.lag("level").over(Window.partitionBy(*by).orderBy("second")), F.lit(0)).alias("_level"))
    begin = F.call_function("div", F.col(time), F.lit(seconds * 1_000_000_000)) * seconds
    met = records.withColumn("second", begin).join(before, [*by, "second"], "left")
    return met.where(least_severity(mask) > F.coalesce("_level", F.lit(0))).drop("second", "_level")


def directory_records(files: DataFrame, by: list[str], size: str = "size") -> DataFrame:
    """(by, n_files, n_records): files whose size is no multiple of a slot count nothing."""
    whole = F.when(F.pmod(F.col(size), F.lit(SLOT)) == 0, F.call_function("div", F.col(size), F.lit(SLOT))).otherwise(F.lit(0))
    return files.groupBy(*by).agg(F.count("*").alias("n_files"), F.sum(whole).alias("n_records"))


def oldest_file(files: DataFrame, by: list[str], time: str = "file_time", path: str = "path") -> DataFrame:
    """(by, path) of the least time; ties go to the least path; files without a time don't count."""
    known = files.where(F.col(time).isNotNull())
    return known.groupBy(*by).agg(F.min_by(path, F.struct(time, path)).alias(path))


def retained(files: DataFrame, by: list[str], quota: int, size: str = "size", time: str = "file_time", path: str = "path") -> DataFrame:
    """Files that stay when the oldest go until the rest is within the quota. A directory has few files; its window is small."""
    newest = Window.partitionBy(*by).orderBy(F.col(time).desc(), F.col(path).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return files.withColumn("kept_size", F.sum(size).over(newest)).where(F.col("kept_size") <= quota)


def segments(records: DataFrame, by: list[str], order: list[str], bucket: Column, most: int) -> DataFrame:
    """Add ``segment``: the file that a record is in when one is begun after each ``most`` records."""
    return numbered(records, by, order, bucket, "_n").withColumn("segment", F.call_function("div", F.col("_n") - 1, F.lit(most))).drop("_n")
