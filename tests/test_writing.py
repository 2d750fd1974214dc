"""Journals written by Spark and read back; filters pushed into the reader, and what it then reads."""

from __future__ import annotations

import pytest
from journal_writer import flag
from pyspark.sql import functions as F

from recscope.functions import matchers as m
from recscope.functions.matchers import Limit
from recscope.functions.wire import double_bytes, little_endian, payload, text_bytes
from recscope.journal import Journal
from recscope.operators import assemble
from recscope.operators.writing import journal_slots
from recscope.schema import SLOT
from recscope.sources import journal as source
from recscope.sources import metadata, values

LOGS = [(2, 3, [{"flags": flag("CSTR"), "text": "said"}, {"flags": flag("NUM_64", "NAMED_PARAM"), "name": "n"}, {"flags": flag("VARRAY", "STR")}])]


def made(spark, n: int = 600):
    blob = metadata.encode("app", LOGS, [])
    processes = spark.createDataFrame([(f"trace.{k}.dump", p, blob) for k in (1, 2) for p in (4, 5)], "file string, pid int, blob binary")
    r = spark.range(n).select(
        F.concat(F.lit("trace."), (F.col("id") % 2 + 1).cast("string"), F.lit(".dump")).alias("file"),
        F.call_function("div", F.col("id"), F.lit(100)).alias("dump"),
        (F.col("id") % 4).alias("chunk"),
        (F.lit(4) + F.call_function("div", F.col("id") % 4, F.lit(2))).cast("int").alias("pid"),
        (F.col("id") % 7).cast("int").alias("tid"),
        (F.col("id") * 10 + 1000).alias("ts_ns"),
        F.lit(0).alias("nesting"),
        (F.lit(3) + F.col("id") % 2).cast("int").alias("severity"),
        payload(F.lit(0), little_endian(F.col("id") - 5, 8), text_bytes(F.repeat(F.lit("é"), (F.col("id") % 150).cast("int")))).alias("payload"),
    )
    return journal_slots(r, processes, "host", 99)


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("written") / "logs")
    source.write_journal(made(spark), out)
    return out


def test_round_trip(spark, path):
    source_ = source.Slots(spark, path, {"slotsPerPartition": 97})
    fragments = source_.read()
    assert fragments.groupBy("file").agg((F.max("pos") + 1 == F.count("*")).alias("x")).where("NOT x").count() == 0
    assert {tuple(r) for r in metadata.file_headers(fragments).select("machine_id", "boot_time_us").collect()} == {("host", 99)}
    got = values.records_of(source_).select("ts_ns", "pid", "tid", "severity", "process_name", F.col("values")[1]["i"].alias("n"), F.col("values")[2]["s"].alias("s")).collect()
    assert sorted(map(tuple, got)) == [(k * 10 + 1000, 4 + k % 4 // 2, k % 7, 3 + k % 2, "app", k - 5, "é" * (k % 150)) for k in range(600)]
    dumps = assemble.dumps(fragments).orderBy("file", "dump_pos").collect()
    assert len(dumps) == 12 and all(b["prev_dump_pos"] == a["dump_pos"] for a, b in zip(dumps, dumps[1:], strict=False) if a["file"] == b["file"])


def test_written_files_are_whole(spark, path, tmp_path):
    assert [f.rpartition("/")[2] for f, _ in source.listed(path)] == ["trace.1.dump", "trace.2.dump"]
    with pytest.raises(Exception, match=r"trace\.1\.dump|exist"):
        source.write_journal(made(spark, 10), path)
    with pytest.raises(Exception, match="do not follow"):
        source.write_journal(made(spark, 10).where("pos <> 1"), str(tmp_path / "holes"))


MATCHERS = {
    "all": m.anything,
    "late": lambda: m.time_between(6000, 1 << 60),
    "early": lambda: m.time_between(0, 1500),
    "process": lambda: m.pid(5),
    "not_process": lambda: ~m.pid(5),
    "severity": lambda: m.severity("WARN") & m.tid(3),
    "other_severity": lambda: ~m.severity("WARN") | m.pid(4),
    "thread_or_time": lambda: m.tid(2) | m.time_between(1000, 1100),
    "value": lambda: m.named_param("n", 20),
    "nothing": m.nothing,
}


@pytest.mark.parametrize("name", MATCHERS)
@pytest.mark.parametrize("size", [50, 100_000])
def test_pushed_filters_find_the_same(spark, path, name, size):
    matcher = MATCHERS[name]()
    pruned = source.Slots(spark, path, {"slotsPerPartition": size})
    plain = spark.read.format("trace_journal").load(path)
    columns = ["file", "dump_pos", "pos", "ts_ns", "pid"]
    expected = values.records_of(plain).where(matcher.record).select(*columns).collect()
    assert sorted(values.records_of(pruned, matcher).select(*columns).collect()) == sorted(expected)
    assert len(expected) > 0 or name == "nothing"


def read_slots(path: str, wanted: source.Wanted, size: int) -> tuple[int, int]:
    """(slots read, slots there) of a journal's files."""
    n = total = 0
    for file, slots in source.listed(path):
        with open(file, "rb") as f:

            def read_at(k, count, f=f):
                nonlocal n
                f.seek(k * SLOT)
                data = f.read(count * SLOT)
                n += len(data) // SLOT
                return data

            for part in source._ranges(file, 0, slots, size, True):
                for _ in source.extents(read_at, part.begin, part.end, wanted):
                    pass
        total += slots
    return n, total


def test_only_accepted_chunks_are_read(path, monkeypatch):
    monkeypatch.setattr(source, "HEAD", 2)
    wanted = source.Wanted(low={"ts_ns": 6900})
    n, total = read_slots(path, wanted, 1 << 20)
    assert n < total / 3
    headers = source.Wanted(among={"rec_type": {6}})
    assert read_slots(path, headers, 1 << 20)[0] < total / 3
    assert read_slots(path, source.Wanted(), 1 << 20)[0] == total


def test_pos_and_file_ranges(spark, path):
    slots = source.Slots(spark, path, {"slotsPerPartition": 64})
    some = slots.read(Limit("pos", 130, 199))
    assert sorted(r["pos"] for r in some.collect()) == sorted([*range(130, 200)] * 2)
    assert some.rdd.getNumPartitions() <= 4
    one = source.listed(path)[0][0]
    assert [r["file"] for r in slots.read(Limit("file", among=(one,))).select("file").distinct().collect()] == [one]
    # Two parts of one journal in one plan don't mix.
    assert slots.read(Limit("pos", 0, 9)).crossJoin(slots.read(Limit("pos", 50, 52)).select(F.col("pos").alias("p"))).count() == 20 * 6


def test_nested_folders(spark, path, tmp_path):
    import shutil

    shutil.copytree(path, tmp_path / "a" / "b")
    assert source.listed(str(tmp_path)) == [] and len(source.listed(str(tmp_path), True)) == 2
    assert Journal.open(spark, str(tmp_path), recursive="true").fragments.count() > 0


def test_wire(spark):
    row = spark.range(1).select(little_endian(F.lit(-2), 8).alias("a"), little_endian(F.lit(258), 2).alias("b"), double_bytes(F.lit(2.5)).alias("c"), text_bytes(F.lit("x" * 127)).alias("d"), text_bytes(F.lit("x" * 128)).alias("e"), text_bytes(F.lit("")).alias("f")).first()
    assert bytes(row["a"]) == (-2).to_bytes(8, "little", signed=True) and bytes(row["b"]) == b"\x02\x01" and bytes(row["c"]) == bytes.fromhex("0000000000000440")
    assert bytes(row["d"]) == b"\x7f" + b"x" * 127 and bytes(row["e"]) == b"\xff" + b"x" * 127 + b"\x01x" and bytes(row["f"]) == b"\x00"
