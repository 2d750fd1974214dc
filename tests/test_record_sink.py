"""Journals written by tasks and streams: capped files, replays, snapshots, and what a seek reads."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from recscope.functions import matchers as m
from recscope.functions import wire
from recscope.journal import Journal
from recscope.schema import FLAGS, REC_TYPES
from recscope.sources import journal, manifest, metadata, record_sink
from recscope.streaming import live

S = 1_000_000_000


def processes(spark, tmp_path, pids=(1, 2, 70)) -> str:
    param = [{"flags": FLAGS["CSTR"], "text": "said"}, {"flags": FLAGS["VARRAY"] | FLAGS["STR"], "name": None}]
    rows = [(p, metadata.encode(f"proc_{p}", [(2, 3, param)], [])) for p in pids]
    path = str(tmp_path / "processes")
    spark.createDataFrame(rows, "pid int, blob binary").coalesce(1).write.parquet(path)
    return path


def records(spark, n=3000):
    """Nine tenths of the records are of one process and second."""
    draw = random.Random(2)
    rows = [(1 if k % 10 else draw.choice([2, 70]), k % 5, (5 * S + k) if k % 10 else k * S or 1, k % 3, 3 + k % 3, "t" * draw.randrange(0, 300)) for k in range(n)]
    df = spark.createDataFrame(rows, "pid int, tid int, ts_ns bigint, nesting int, severity int, text string")
    return df.select("pid", "tid", "ts_ns", "nesting", "severity", wire.payload(F.lit(0), wire.text_bytes(F.col("text"))).alias("payload"), "text")


def read_back(found):
    said = F.filter("values", lambda v: v["kind"] == "str")[0]["s"]
    return sorted(map(tuple, found.select("pid", "tid", "ts_ns", "nesting", "severity", said.alias("text")).collect()))


def expected(df):
    return sorted(map(tuple, df.select("pid", "tid", "ts_ns", "nesting", "severity", "text").collect()))


def test_batch_files_are_capped_and_read_back(spark, tmp_path):
    df, path = records(spark), str(tmp_path / "logs")
    record_sink.write_records(df, processes(spark, tmp_path), path, slotsPerFile=900, slotsPerChunk=64)
    found = journal.listed(path)
    assert len(found) > 8 and all(n <= 900 for _, n in found)
    assert sum(n for _, n in found) < 1.3 * sum(-(-(4 + len(r["text"]) + 1 + len(r["text"]) // 127) // 44) for r in df.collect()) + 400
    opened = Journal.open(spark, path)
    assert read_back(opened.records()) == expected(df)
    heads = opened.source.read(journal.Limit("rec_type", among=(REC_TYPES["FILE_HEADER"],)))
    assert heads.count() == len(found)


def test_a_seek_reads_its_files_and_chunks_only(spark, tmp_path, monkeypatch):
    df, path = records(spark), str(tmp_path / "logs")
    record_sink.write_records(df, processes(spark, tmp_path), path, slotsPerFile=900, slotsPerChunk=64)
    read: list[tuple[str, int]] = []

    def counted(part):
        for batch in real(part):
            read.append((part.file, batch.num_rows))
            yield batch

    real, zoned = journal._read, journal.zoned
    fetched = [0]

    def seen(read_at, begin, end, wanted, zones):
        def own(k, n):
            fetched[0] += n
            return read_at(k, n)

        return zoned(own, begin, end, wanted, zones)

    monkeypatch.setattr(journal, "zoned", seen)
    wanted = journal.Wanted()
    for limit in (journal.Limit("rec_type", among=(1,)), *(m.time_between(1000 * S, 1100 * S) & m.pid(70)).limits):
        wanted.add(limit)
    reader = journal.JournalReader({"path": path, "wanted": wanted.text()})
    parts = reader.partitions()
    rows = sum(b.num_rows for p in parts for b in counted(p))
    total = sum(n for _, n in journal.listed(path))
    assert len(parts) < len(journal.listed(path)) / 2 and rows <= fetched[0] < total / 20
    found = Journal.open(spark, path).with_filter(m.time_between(1000 * S, 1100 * S) & m.pid(70)).records()
    assert read_back(found) == expected(df.where(f"pid = 70 AND ts_ns > {1000 * S} AND ts_ns < {1100 * S}"))


def test_stream_and_replayed_epoch(spark, tmp_path):
    df, path = records(spark, 600), str(tmp_path / "logs")
    for k in range(3):
        df.where(f"ts_ns % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/k={k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/k=*"))
    table = processes(spark, tmp_path)
    for _ in range(2):  # a restart finds nothing new
        live.drained(record_sink.stream_records(stream, table, path, str(tmp_path / "checkpoint"), slotsPerFile=300, slotsPerChunk=50))
    state = manifest.state(path)
    assert state.epochs == {"live": 2} and all(f["slots"] <= 300 for f in state.files.values())
    assert read_back(Journal.open(spark, path).records()) == expected(df)
    # The last epoch once more: its files go, the journal stays as it was.
    writer = record_sink.StreamWriter({"path": path, "processes": table, "query": "live"})
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([1], pa.int32()), pa.array([7]), pa.array([0], pa.int32()), pa.array([3], pa.int32()), pa.array([b"\0\0\0\0"])], names=list(record_sink.COLUMNS))
    writer.commit([writer.write(iter([batch])), None], 2)
    assert manifest.state(path) == state and not list((tmp_path / "logs" / "_unfinished").iterdir())
    writer.commit([writer.write(iter([batch]))], 3)
    assert len(manifest.state(path).files) == len(state.files) + 1


def test_snapshots_outlive_retirement(spark, tmp_path):
    df, path = records(spark), str(tmp_path / "logs")
    record_sink.write_records(df, processes(spark, tmp_path), path, slotsPerFile=900, slotsPerChunk=64)
    before = manifest.state(path).version
    begun = Journal.open(spark, path, version=before).records()
    gone = manifest.retire(path, most_slots=3000)
    assert gone and sum(n for _, n in journal.listed(path)) <= 3000
    assert read_back(begun) == expected(df)
    left = manifest.state(path)
    assert manifest.vacuum(path, left.version) == []
    assert manifest.vacuum(path, left.version + 1) == sorted(gone)
    assert not any((tmp_path / "logs" / g).exists() for g in gone) and manifest.state(path).retired == {}
    kept = Journal.open(spark, path).records()
    assert kept.count() == sum(int(np.frombuffer((tmp_path / "logs" / n).read_bytes(), journal.LAYOUT)["bits"][np.frombuffer((tmp_path / "logs" / n).read_bytes(), journal.LAYOUT)["kinds"] >> 4 == 1].astype(int).__and__(1).sum()) for n in left.files)


def test_log_has_whole_states(tmp_path):
    path = str(tmp_path)
    for k in range(45):
        assert manifest.append(path, [{"name": f"f{k}", "slots": k, "low": k, "high": k, "pids": [], "mask": 0}], query="q", epoch=k)
        assert not manifest.append(path, [], query="q", epoch=k)
    assert len(manifest.state(path).files) == 45 and len(manifest.state(path, 9).files) == 10
    manifest.retire(path, before_ns=30)
    assert sorted(manifest.state(path).files) == sorted(f"f{k}" for k in range(30, 45))
    assert len(manifest.state(path, 44).files) == 45 and manifest.state(str(tmp_path / "none")) is None


def test_zone_maps_as_a_table(spark, tmp_path):
    df, path = records(spark, 500), str(tmp_path / "logs")
    assert record_sink.zones(spark, path).count() == 0
    record_sink.write_records(df, processes(spark, tmp_path), path, slotsPerFile=300, slotsPerChunk=64)
    before = manifest.state(path).version
    got = record_sink.zones(spark, path).groupBy("pid").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or("mask").alias("mask")).collect()
    expected = df.groupBy("pid").agg(F.min("ts_ns"), F.max("ts_ns"), F.bit_or(F.expr("shiftleft(1L, severity)"))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected))
    manifest.retire(path, most_slots=500)
    assert record_sink.zones(spark, path).count() < record_sink.zones(spark, path, before).count()
