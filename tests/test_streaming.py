"""A growing journal followed as a stream, against the batch result."""

from __future__ import annotations

import struct

from journal_writer import Journal, chunked, flag, metadata, record
from pyspark.sql import functions as F

from recscope.functions import matchers as m
from recscope.operators import assemble, stats
from recscope.sources.journal import TraceJournal
from recscope.streaming import live


def grown(tmp_path):
    """A journal cut in the middle of a record of many fragments, and the rest of it."""
    j = Journal()
    j.process(1, metadata("app", [(2, 3, [{"flags": flag("VARRAY", "STR")}])], []))
    rows = [s for k in range(20) for s in record(0, chunked(b"y" * (30 * k)), 1000 + k, 1, k % 3, 0, 3 + k % 2)]
    j.add_dump([(1, 0x78, 2000, rows)])
    data = b"".join(j.slots)
    return data, (len(j.slots) - 7) * 64


def test_assembly_across_batches(spark, tmp_path):
    data, cut = grown(tmp_path)
    path, out = tmp_path / "trace.1.dump", str(tmp_path / "out")
    path.write_bytes(data[:cut])
    counts: list[int] = []

    def run():
        stream = live.assembled(live.follow(spark, str(path)))
        live.written(stream, str(tmp_path / "checkpoint"), live.parquet_sink(out), lambda b, k: counts.append(b.count()), available_now=True).awaitTermination()

    run()
    path.write_bytes(data)
    run()
    spark.dataSource.register(TraceJournal)
    fragments = spark.read.format("trace_journal").load(str(path))
    typed = fragments.where("rec_type = 1")
    expected = assemble.reassemble(typed).select("ts_ns", "tid", "pos", "payload", "n_fragments").collect()
    got = spark.read.parquet(out).select("ts_ns", "tid", "pos", "payload", "n_fragments").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected)) and len(got) == 20
    assert [n > 0 for n in counts] == [True, True] and sum(counts) == 20


def test_view_rates_and_text_sink(spark, tmp_path):
    data, _ = grown(tmp_path)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "trace.1.dump").write_bytes(data)
    stream = live.assembled(live.follow(spark, str(tmp_path / "in")))
    shown = live.shown(stream, m.severity("WARN"))
    line = F.concat_ws(" ", "ts_ns", "tid")
    live.written(shown, str(tmp_path / "c"), live.text_sink(str(tmp_path / "text"), line), available_now=True).awaitTermination()
    got = sorted(r["value"] for r in spark.read.text(str(tmp_path / "text")).collect())
    assert got == sorted(f"{1000 + k} {k % 3}" for k in range(20) if k % 2)
    query = live.rates(live.follow(spark, str(tmp_path / "in")).where("rec_type = 1")).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    n_slots = (len(data) // 64) - struct.unpack_from("<I", data, 0)[0] * 0
    typed = sum(data[k * 64 + 15] >> 4 == 1 for k in range(n_slots))
    assert [r["n"] for r in spark.table("rates").collect()] == [typed]


def test_shedding_as_a_stream_is_that_in_batch(spark, tmp_path):
    rows = [(d, s, (s * 7 + d) % 5) for d in (1, 2) for s in range(60)]
    df = spark.createDataFrame(rows, "day int, second bigint, n bigint")
    for k in range(3):
        df.where(f"second div 20 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    live.written(live.shed(stream, "day", 2), str(tmp_path / "c"), live.parquet_sink(out), available_now=True).awaitTermination()
    expected = stats.shedding(df, ["day"], 2).select("day", "second", "n", "level").collect()
    got = spark.read.parquet(out).select("day", "second", "n", "level").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected))
