"""Journals written slot by slot, read back as records."""

from __future__ import annotations

import random
import struct

import pytest
from journal_writer import Journal, chunked, flag, metadata, record, slot
from pyspark.sql import functions as F

from recscope.functions import formatting as fmt
from recscope.functions import matchers as m
from recscope.journal import Journal as Journal_
from recscope.operators import assemble, navigate
from recscope.schema import ORDER_KEY, REC_TYPES
from recscope.sources import metadata as md
from recscope.sources import values
from recscope.sources.journal import TraceJournal

LOGS = [
    (0, 1, [{"flags": flag("CSTR"), "text": "paint"}, {"flags": flag("NUM_32", "NAMED_PARAM"), "name": "width"}, {"flags": flag("ENUM", "NAMED_PARAM"), "type_id": 0, "name": "colour", "text": "Colour"}]),
    (1, 1, [{"flags": flag("CSTR"), "text": "paint"}, {"flags": flag("NUM_16")}]),
    (2, 4, [{"flags": flag("CSTR"), "text": "disk is 90% full:"}, {"flags": flag("VARRAY", "STR")}, {"flags": flag("DOUBLE")}, {"flags": flag("NUM_64", "UNSIGNED")}]),
    (2, 5, [{"flags": flag("CSTR"), "text": "object"}, {"flags": flag("NESTED_LOG"), "text": "Thing"}, {"flags": flag("NUM_8", "HEX")}]),
    (2, 3, [{"flags": flag("CSTR"), "text": "id"}, {"flags": flag("NUM_32")}]),
    (2, 3, [{"flags": flag("VARRAY", "NUM_8", "HEX", "UNSIGNED")}, {"flags": flag("NUM_32")}]),
]
TYPES = [("Colour", [("RED", 1), ("GREEN", 5), ("BLUE", 9)])]
NESTED = struct.pack("<I", 4) + struct.pack("<i", -3)


def journal() -> Journal:
    j = Journal()
    j.process(7, metadata("app", LOGS, TYPES))
    j.process(8, metadata("tool", LOGS[:2], TYPES))
    long = "disk one é " * 30
    rows = {
        "calls": record(0, struct.pack("<iI", -640, 5), 100, 7, 1, 0, 1) + record(1, struct.pack("<h", -2), 140, 7, 1, 0, 1),
        "other": record(2, chunked(long.encode()) + struct.pack("<dQ", 2.5, 2**64 - 1), 120, 7, 2, 1, 4) + record(3, NESTED + b"\xfe", 130, 7, 1, 1, 5),
        "tool": record(0, struct.pack("<iI", 3, 4), 110, 8, 1, 0, 1),
    }
    j.add_dump([(7, 1 << 1, 150, rows["calls"]), (7, 0x78, 150, rows["other"]), (8, 1 << 1, 150, rows["tool"])])
    orphan = record(2, chunked(b"x" * 100) + struct.pack("<dQ", 1.0, 1), 200, 7, 3, 0, 4)[1:]
    unknown = record(99, b"", 210, 7, 1, 0, 3)
    j.add_dump([(7, 0x78, 300, orphan + unknown + record(5, chunked(bytes(range(200))) + struct.pack("<i", 4), 90, 7, 1, 0, 3) + [slot(b"", "TYPED", ts=0, pid=7, severity=3)])])
    j.process(7, metadata("app2", LOGS[:2], []))
    j.add_dump([(7, 1 << 1, 400, record(1, struct.pack("<h", 9), 350, 7, 1, 0, 1))])
    return j


@pytest.fixture(scope="module")
def fragments(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("journal") / "trace.1.dump"
    journal().write(path)
    with open(path, "ab") as f:
        f.write(b"cut slot")
    spark.dataSource.register(TraceJournal)
    return spark.read.format("trace_journal").option("slotsPerPartition", 10).load(str(path))


def lines(fragments, matcher=None, **options):
    r = values.records_of(fragments, matcher)
    o = fmt.FormatOptions(**options)
    return [x[0] for x in navigate.step(r, None, 100).select(fmt.body_text(F.col("kind"), F.col("values"), o)).collect()]


LONG = "disk one é " * 30
BODIES = [
    "--> paint(width = -640, colour = GREEN)",
    "--> paint(width = 3, colour = <? enum>)",
    'disk is 90% full: "' + LONG.replace("é", "\\xc3\\xa9") + '" 2.500000 18446744073709551615',
    "object { id -3 } 0xfe",
    "<-- paint(-2)",
    bytes(range(200)).hex() + " 4",
    "<-- paint(9)",
]


def test_records_in_order(fragments):
    assert lines(fragments) == BODIES
    processes = [r["process_name"] for r in values.records_of(fragments).orderBy(*ORDER_KEY).collect()]
    assert processes == ["app", "tool", "app", "app", "app", "app", "app2"]


def test_dimensions_by_join_equal_those_by_broadcast(fragments, monkeypatch):
    monkeypatch.setattr(values, "BROADCAST", 0)
    assert lines(fragments) == BODIES


def test_headers(spark, fragments):
    assert [tuple(r) for r in md.file_headers(fragments).select("machine_id", "boot_time_us").collect()] == [("testhost", 77)]
    dumps = assemble.dumps(fragments).orderBy("dump_pos").collect()
    assert [d["n_slots"] for d in dumps][:1] == [sum(1 for _ in range(3)) + 2 + (len(chunked(LONG.encode())) + 20 + 43) // 44 + 1 + 1]
    assert dumps[1]["prev_dump_pos"] == dumps[0]["dump_pos"] and dumps[0]["first_chunk_pos"] == dumps[0]["dump_pos"] + 1
    around = navigate.headers_around(fragments, REC_TYPES["DUMP_HEADER"], 7).where(F.col("rec_type") == REC_TYPES["TYPED"])
    assert {r["header_pos"] for r in around.collect()} == {d["dump_pos"] for d in dumps}
    assert md.enum_values(md.dimensions(fragments)).where("name = 'BLUE'").count() == 2
    assert assemble.enum_value(md.enum_values(md.dimensions(fragments)), "GREEN") == 5
    assert {r["function"] for r in assemble.functions_of(md.log_descriptors(md.dimensions(fragments))).collect()} == {"paint"}


@pytest.mark.parametrize(
    ("matcher", "found"),
    [
        (lambda: ~m.tid(1), [2]),
        (lambda: ~m.severity("WARN"), [0, 1, 3, 4, 5, 6]),
        (lambda: ~(m.severity("FUNC_TRACE") & m.pid(7)), [1, 2, 3, 5]),
        (lambda: m.call("paint", 640 - 1280 + (1 << 32)), [0]),
        (lambda: m.call("paint", colour="GREEN"), [0]),
        (lambda: m.any_param("RED"), []),
        (lambda: m.named_param("width", 3), [1]),
        (lambda: m.any_param(2**64 - 1), [2]),
        (lambda: m.any_param(-640), []),
        (lambda: m.const_substring("90%"), [2]),
        (lambda: m.type_name("Colour"), [0, 1]),
        (lambda: m.process_name("app") & m.time_between(100, 140), [2, 3]),
        (lambda: ~m.process_name("app"), [1, 6]),
        (lambda: m.time_between(160, 1000), [6]),
        (lambda: m.nothing(), []),
    ],
)
def test_pruned_reading_finds_what_matches(fragments, matcher, found):
    assert lines(fragments, matcher()) == [BODIES[k] for k in found]


def test_random_records_survive_splitting(spark, tmp_path):
    draw = random.Random(11)
    j = Journal()
    j.process(1, metadata("app", [(2, 3, [{"flags": flag("VARRAY", "STR")}])], []))
    expected, ts = [], 1000
    for _ in range(6):
        chunks = []
        for _ in range(draw.randrange(1, 4)):
            pending = []
            for _ in range(draw.randrange(0, 9)):
                ts += draw.choice([0, 1])
                text = "".join(draw.choices("abc", k=draw.choice([0, 39, 40, 127, 128, 300])))
                tid = draw.randrange(3) * 100 + len(expected)
                expected.append((ts, tid, text))
                pending.append(record(0, chunked(text.encode()), ts, 1, tid, 0, 3))
            rows = []
            while pending:  # fragments of several threads interleave
                k = draw.randrange(len(pending))
                rows.append(pending[k].pop(0))
                pending = [p for p in pending if p]
            chunks.append((1, 0x78, ts, rows))
        j.add_dump(chunks)
    j.write(tmp_path / "trace.2.dump")
    spark.dataSource.register(TraceJournal)
    r = values.records_of(spark.read.format("trace_journal").option("slotsPerPartition", 7).load(str(tmp_path)))
    got = [(x["ts_ns"], x["tid"], x["values"][0]["s"]) for x in r.collect()]
    assert sorted(got) == sorted(expected)


def test_bad_files(spark, tmp_path):
    spark.dataSource.register(TraceJournal)
    (tmp_path / "trace.3.dump").write_bytes(slot(b"", "TYPED") * 3)
    with pytest.raises(Exception, match="file header"):
        spark.read.format("trace_journal").load(str(tmp_path / "trace.3.dump")).collect()
    assert spark.read.format("trace_journal").option("requireHeader", "false").load(str(tmp_path / "trace.3.dump")).count() == 3
    (tmp_path / "trace.4.dump").write_bytes(b"")
    assert spark.read.format("trace_journal").load(str(tmp_path / "trace.4.dump")).count() == 0


def test_short_metadata_is_an_error(spark, tmp_path):
    j = Journal()
    j.process(1, metadata("app", LOGS, TYPES))
    del j.slots[3]
    j.write(tmp_path / "trace.5.dump")
    spark.dataSource.register(TraceJournal)
    with pytest.raises(Exception, match="not as long as announced"):
        md.dimensions(spark.read.format("trace_journal").load(str(tmp_path))).collect()


def test_reader_verbs(fragments, tmp_path):
    j = Journal_(fragments)
    shown = j.with_filter(m.severities()).with_options(times="raw")
    lines = [r["value"] for r in shown.lines().collect()]
    assert lines[0].startswith("WARN  app                  120 [    2] : disk is") and len(lines) == 3
    assert [r["value"] for r in j.with_filter(m.anything()).with_options(times="hidden").lines().collect()][2].startswith("WARN  app                   [    2] :     disk")
    shown.dump(str(tmp_path / "text"))
    assert sorted(x for f in (tmp_path / "text").glob("part*") for x in f.read_text().splitlines()) == sorted(lines)
    counts = {r["template"]: r["occurrences"] for r in j.statistics().collect()}
    assert counts["app                  ----- [    7] <012*>: --> paint(width = <int>, colour = <Colour>)"] == 1
    assert sum(counts.values()) == 7
    assert j.metadata_lines().count() == 6 + 2 + 2
    first = j.step(None).first()
    cursor = {c: first[c] for c in ORDER_KEY}
    assert j.find(cursor, m.function("paint")).first()["process_name"] == "tool"
    assert j.find(cursor, m.function("paint"), forward=False).count() == 0
    assert j.find_text(None, "90% full").first()["ts_ns"] == 120
    assert [r["name"] for r in j.names("pa").collect()] == ["paint"]
