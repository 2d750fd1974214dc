"""Live decoding: metadata that comes late, restarts, fragments out of order and given up, bounded batches."""

from __future__ import annotations

from journal_writer import Journal, chunked, flag, metadata, metadata_slots, record
from pyspark.sql import functions as F

from recscope.functions import formatting as fmt
from recscope.functions import matchers as m
from recscope.journal import Journal as Opened
from recscope.schema import FIRST, FRAGMENTS, LAST
from recscope.sources.journal import bounded
from recscope.streaming import live

TEXT = [{"flags": flag("CSTR"), "text": "said"}, {"flags": flag("VARRAY", "STR", "NAMED_PARAM"), "name": "what"}]
NUMBER = [{"flags": flag("CSTR"), "text": "count"}, {"flags": flag("NUM_32"), "name": None}]


def late_journal() -> list[bytes]:
    """Two versions of one process, the first one's metadata after the chunk that needs it, and a record of many slots."""
    j = Journal()
    rows = [s for k in range(6) for s in record(0, chunked(b"y" * (90 * k)), 1000 + k, 1, k % 3, 0, 3 + k % 2)]
    at = len(j.slots) + 2 + len(rows)
    j.meta[1] = at
    j.add_dump([(1, 0x78, 2000, rows)])
    assert len(j.slots) == at
    j.slots += metadata_slots(metadata("first", [(2, 3, TEXT)], []), 1)
    j.process(1, metadata("second", [(2, 3, NUMBER)], []))
    j.add_dump([(1, 0x78, 3000, [s for k in range(5) for s in record(0, bytes([k, 0, 0, 0]), 2000 + k, 1, k, 0, 3)])])
    return j.slots


def test_lines_are_those_of_the_batch(spark, tmp_path):
    slots = late_journal()
    path, out = tmp_path / "in" / "trace.1.dump", str(tmp_path / "out")
    path.parent.mkdir()
    options = fmt.FormatOptions(times="raw")
    sizes: list[int] = []

    def run():
        follow = live.follow(spark, str(path.parent), slotsPerBatch=5, progress=str(tmp_path / "progress" / "at.json"))
        found = live.lines(live.records(follow, m.severities(), lanes=3), options)
        live.drained(live.written(found, str(tmp_path / "checkpoint"), live.parquet_sink(out), lambda b, k: sizes.append(k)))

    for upto in (9, len(slots) - 4, len(slots)):  # each run is a restart
        path.write_bytes(b"".join(slots[:upto]))
        run()
    got = spark.read.parquet(out)
    expected = Opened.open(spark, str(path)).with_filter(m.severities()).with_options(times="raw").lines()
    assert sorted(r["value"] for r in got.where("event = 'record'").collect()) == sorted(r["value"] for r in expected.collect())
    assert got.where("event = 'record'").count() == 11
    assert sorted((r["pid"], r["process_name"]) for r in got.where("event = 'metadata'").collect()) == [(1, "first"), (1, "second")]
    assert len(set(sizes)) >= len(slots) // 5
    names = {r["process_name"] for r in got.where(m.process_name("second").record & (F.col("event") == "record")).collect()}
    assert names == {"second"}


def batches_of(spark, tmp_path, *rows):
    """A stream with a batch for each list of (tid, ts, pos, termination, payload)."""
    for k, some in enumerate(rows):
        full = [("f", pos, ts, 1, tid, 0, bits, 3, 1, 0, data) for tid, ts, pos, bits, data in some]
        spark.createDataFrame(full, FRAGMENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/k={k}"))
    return lambda: spark.readStream.schema(FRAGMENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/k=*"))


def test_fragments_across_batches_and_a_restart(spark, tmp_path):
    s = 1_000_000_000
    one = [(1, s, 5, FIRST, b"a"), (2, s, 3, LAST, b"z"), (3, s, 8, FIRST, b"lost"), (4, s, 9, FIRST | LAST, b"whole")]
    two = [(1, s, 6, 0, b"b"), (2, s, 1, FIRST, b"x"), (5, 90 * s, 30, FIRST | LAST, b"late clock")]
    three = [(1, s, 7, LAST, b"c"), (3, s, 10, LAST, b"too late"), (5, 90 * s, 31, FIRST, b"p"), (5, 90 * s, 32, LAST, b"q")]
    stream = batches_of(spark, tmp_path, one, two, three)
    out, at = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    # With one lane, the clock of thread 5 gives up what waits from the first second: after 60 s, not after 100.
    expected = {60 * s: {(2, b"xz"), (4, b"whole"), (5, b"late clock"), (5, b"pq")}, 100 * s: {(1, b"abc"), (2, b"xz"), (3, b"losttoo late"), (4, b"whole"), (5, b"late clock"), (5, b"pq")}}
    for wait, rows in expected.items():
        for _ in range(2):  # the second run finds nothing new
            whole = live.decode.through(stream(), live.decode.Assembler(wait), live.decode.WHOLE, 1)
            live.written(whole, f"{at}{wait}", live.parquet_sink(f"{out}{wait}"), available_now=True).awaitTermination()
        got = spark.read.parquet(f"{out}{wait}").select("tid", "payload").collect()
        assert {(r["tid"], bytes(r["payload"])) for r in got} == rows and len(got) == len(rows)


def test_batches_are_bounded():
    assert bounded({}, {"a": 10, "b": 3}, 6) == {"a": 3, "b": 3}
    assert bounded({"a": 3, "b": 3}, {"a": 10, "b": 3}, 6) == {"a": 9, "b": 3}
    assert bounded({"a": 10}, {"a": 10}, 6) == {"a": 10}
    assert bounded({"gone": 4}, {"a": 1}, 6) == {"a": 1}
    at, steps = {}, 0
    there = {f"f{k}": 97 * k for k in range(9)}
    while at != {f: n for f, n in there.items() if n}:
        new = bounded(at, there, 50)
        assert 0 < sum(new.values()) - sum(at.values()) <= 50
        at, steps = new, steps + 1
    assert steps == -(-sum(there.values()) // 50)
