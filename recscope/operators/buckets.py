"""Ordered operators that don't put one key's rows into one task: by buckets of the order.

A bucket is a monotone function of the order (a time div a width). Windows run within (key, bucket); what crosses
buckets, a count or the last match, is summed up by bucket first, so a hot key costs a row for each of its buckets and no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recscope.scratch import stored


def width(df: DataFrame, order: str, most: int = 250_000) -> int:
    """The width of buckets of ``order`` that leaves about ``most`` rows in each, were all rows of one key and evenly spread."""
    n, low, high = df.agg(F.count(order), F.min(order), F.max(order)).first()
    return max(1, -(-(high - low + 1) // -(-n // most))) if n else 1


def numbered(df: DataFrame, by: list[str], order: list[str], bucket: Column, out: str = "n") -> DataFrame:
    """Add ``out``: the row's number from 1 within ``by``, in ``order``; null keys are keys like any other."""
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    within = Window.partitionBy(*by, "_bucket").orderBy(*order)
    local = rows.withColumn(out, F.row_number().over(within))
    return _join(local, offsets, [*by, "_bucket"]).withColumn(out, F.col(out) + F.col("_offset")).drop("_offset", "_bucket")


def numbered_by_ranges(df: DataFrame, by: list[str], order: list[str], out: str = "n", most: int = 250_000, parts: int | None = None) -> DataFrame:
    """``numbered`` with buckets whose bounds are measured: ranges of (by, order), by samples of all rows.

    A burst, a hot key or many equal times are spread like all else, as long as ``order`` tells rows apart in the end. Ranges have about ``most``
    rows each (``parts``: so many ranges); the ranged rows are written once.
    """
    n = parts or max(1, -(-df.count() // most))
    ranged = df.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id())
    kept = stored(ranged, "ranges")
    return numbered(kept, by, order, F.col("_range"), out).drop("_range")


def nearest(seekers: DataFrame, targets: DataFrame, by: list[str], order: list[str], payload: list[str], bucket: Column, forward: bool = False) -> DataFrame:
    """``seekers`` with ``payload`` of the nearest target of the same ``by`` strictly before (or after) them; null if none.

    Both frames have the columns ``by`` and ``order``; a seeker's other columns stay. Null keys match nothing.
    """
    found = F.struct(*[F.col(c) for c in payload])
    columns = seekers.columns
    left = seekers.select(*by, *order, F.struct(*columns).alias("_row"), F.lit(None).cast(targets.select(found).schema[0].dataType).alias("_found"), F.lit(0).alias("_is"))
    right = targets.where(_all_known(by)).select(*by, *order, F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), found.alias("_found"), F.lit(1).alias("_is"))
    both = left.unionByName(right).withColumn("_bucket", bucket)
    place = F.struct(*[F.col(c) for c in order])
    nearest_of = (F.min_by if forward else F.max_by)("_found", F.when(F.col("_is") == 1, place))
    carried = both.groupBy(*by, "_bucket").agg(nearest_of.alias("_edge"))
    turn = (lambda c: F.col(c).desc()) if forward else (lambda c: F.col(c).asc())
    across = Window.partitionBy(*by).orderBy(turn("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.withColumn("_carry", F.last("_edge", ignorenulls=True).over(across)).drop("_edge")
    # Of one place the seekers come first: a target there is not strictly before them.
    within = Window.partitionBy(*by, "_bucket").orderBy(*map(turn, order), "_is").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = both.withColumn("_near", F.last("_found", ignorenulls=True).over(within)).where("_is = 0")
    near = F.coalesce("_near", "_carry")
    joined = _join(local, carried, [*by, "_bucket"])
    return joined.select("_row.*", *[near[c].alias(c) for c in payload])


def _all_known(by: list[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(c).isNotNull()
    return out


def _join(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """An inner join on keys that may be null."""
    renamed = small.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in small.columns])
    condition = F.lit(True)
    for c in on:
        condition = condition & rows[c].eqNullSafe(renamed[f"_on_{c}"])
    return rows.join(renamed, condition).drop(*[f"_on_{c}" for c in on])
