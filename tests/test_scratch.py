"""Scratch tables of an application and their end."""

from __future__ import annotations

from pathlib import Path

from recscope import scratch


def test_tables_lie_in_one_folder_that_can_be_cleared(spark):
    kept = spark.range(3)
    table = scratch.stored(kept, "numbers")
    folder = Path(scratch.own_dir(spark).removeprefix("file://"))
    assert table.count() == 3 and any(p.name.startswith("numbers-") for p in folder.iterdir())
    scratch.clear(spark)
    assert not folder.exists()
    scratch.clear(spark)
    assert scratch.stored(kept, "numbers").count() == 3
