"""Numbers by measured ranges: right for any distribution, and no range far larger than the others."""

from __future__ import annotations

import random
from collections import Counter
from statistics import median

from pyspark.sql import functions as F

from recscope.operators import buckets


def test_a_burst_is_spread(spark, monkeypatch):
    draw = random.Random(3)
    # Nine tenths of the rows are of one key and one second; some rows have no key or no time.
    rows = [("hot" if k % 10 else draw.choice(["a", "b", None]), 7 if k % 10 else draw.choice([None, *range(1000)]), k) for k in range(8000)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, second int, id long").repartition(6)
    kept: list = []
    real = buckets.stored
    monkeypatch.setattr(buckets, "stored", lambda d, name: kept.append(real(d, name)) or kept[-1])
    got = buckets.numbered_by_ranges(df, ["key"], ["second", "id"], parts=16).collect()
    sizes = [r["count"] for r in kept[0].groupBy("_range").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 3 * median(sizes)
    places: Counter = Counter()
    expected = []
    for key, second, k in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        places[key] += 1
        expected.append((key, second, k, places[key]))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_empty_and_equal_rows(spark):
    df = spark.createDataFrame([(1, 1)] * 5, "key int, t int")
    assert sorted(r["n"] for r in buckets.numbered_by_ranges(df, ["key"], ["t"], parts=3).collect()) == [1, 2, 3, 4, 5]
    assert not buckets.numbered_by_ranges(df.where(F.lit(False)), ["key"], ["t"]).collect()
