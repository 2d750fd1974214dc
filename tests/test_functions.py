"""Formatting, times, buckets, statistics and the algebra of matchers on small frames."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recscope import schema
from recscope.functions import formatting as fmt
from recscope.functions import matchers as m
from recscope.operators import assemble, buckets, navigate, stats


def column(spark, rows, ddl, make):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(make).collect()]


def test_severities(spark):
    assert column(spark, [(k,) for k in range(8)], "s int", fmt.severity_label(F.col("s"))) == ["-----", "-----", "DEBUG", "INFO ", "WARN ", "ERROR", "FATAL", "???"]
    assert column(spark, [("WARN",), ("warn",), (None,)], "s string", fmt.severity_value(F.col("s"))) == [4, 0, 0]
    assert column(spark, [(0,), (0b1000100,)], "s int", fmt.severity_mask_text(F.col("s"))) == ["", "DEBUG, FATAL"]
    assert column(spark, [(0,), (1,), (0b100,)], "s int", fmt.least_severity(F.col("s"))) == [None, 1, 3]
    with pytest.raises(ValueError, match="unknown severity"):
        schema.severity_number("LOUD")


def test_times(spark):
    ns = 1_767_607_200 * fmt.SECOND + 123
    assert column(spark, [(ns,)], "t bigint", fmt.timestamp_text(F.col("t"))) == ["Mon Jan  5 10:00:00 2026:123       "]
    assert column(spark, [(ns,)], "t bigint", fmt.timestamp_text(F.col("t"), "compact")) == ["05/01 10:00:00"]
    assert column(spark, [(ns,)], "t bigint", fmt.timestamp_text(F.col("t"), "raw")) == [str(ns)]
    assert fmt.absolute_ns("Mon Jan  5 10:00:00 2026:123") == ns
    assert fmt.absolute_ns("Mon Jan  5 10:00:00 2026") == ns - 123
    hour = 3600 * fmt.SECOND
    assert fmt.partial_ns("11:00", ns) == ns - 123 + hour
    assert fmt.partial_ns("10:00:07:55", ns) == ns - 123 + 7 * fmt.SECOND + 55
    assert fmt.partial_ns(":55", ns) == ns - 123 + 55
    assert fmt.partial_ns("6/1", ns) == ns - 123 + 14 * hour
    with pytest.raises(ValueError, match="not a time"):
        fmt.partial_ns("soon", ns)


def test_escapes_every_byte(spark):
    text = "".join(map(chr, range(1, 128))) + "é🙂"
    expected = "".join({9: "\\t", 10: "\\n", 13: "\\r", 34: '\\"', 92: "\\\\"}.get(b, chr(b) if 32 <= b < 127 else f"\\x{b:02x}") for b in text.encode())
    assert column(spark, [(text,), ("plain",), ("",), (None,)], "s string", fmt.escaped(F.col("s"))) == [f'"{expected}"', '"plain"', '""', None]


def test_names_and_numbers(spark):
    assert column(spark, [("/a/trace.17.dump",), ("trace.5.x",), ("/trace.7.d/other",), ("x",)], "p string", fmt.file_time(F.col("p"))) == [17, 5, None, None]
    assert column(spark, [("_trace_shm_12_static",), ("x_12_",)], "p string", fmt.buffer_pid(F.col("p"), "_trace_shm_")) == [12, None]
    assert column(spark, [(5, 4), (4, 5), (1, (1 << 32) - 1), (7, 7)], "a bigint, b bigint", fmt.newer_generation(F.col("a"), F.col("b"))) == [True, False, True, False]
    assert column(spark, [(1.5,), (0.0,), (-1.0,)], "d double", fmt.hex_float(F.col("d"))) == ["0x1.8p+0", "0x0p+0", "-0x1p+0"]
    assert fmt.quota_records("%50", 6400, 0) == 50 and fmt.quota_records("6400", 0, 0) == 100


def test_colours(spark):
    text = "\x1b[1;31mERROR\x1b[0m plain"
    assert column(spark, [(text,)], "s string", fmt.without_colours(F.col("s"))) == ["ERROR plain"]
    assert [tuple(x) for x in column(spark, [(text,)], "s string", fmt.colour_runs(F.col("s")))[0]] == [("1;31", "ERROR"), ("0", " plain")]


@pytest.mark.parametrize("forward", [False, True])
def test_nearest_is_that_of_a_plain_search(spark, forward):
    draw = random.Random(5)
    rows = [(draw.choice([1, 1, 1, 2, None]), draw.randrange(200), k, draw.random() < 0.2) for k in range(400)]
    df = spark.createDataFrame(rows, "g int, t bigint, id bigint, hit boolean")
    targets = df.where("hit").select("g", "t", "id", F.col("id").alias("found"))
    got = {r["id"]: r["found"] for r in buckets.nearest(df, targets, ["g"], ["t", "id"], ["found"], F.call_function("div", F.col("t"), F.lit(7)), forward).collect()}
    for g, t, k, _ in rows:
        places = [(x[1], x[2]) for x in rows if x[3] and x[0] == g and g is not None and ((x[1], x[2]) > (t, k) if forward else (x[1], x[2]) < (t, k))]
        assert got[k] == ((min(places) if forward else max(places))[1] if places else None)
    assert len(got) == 400


def test_numbered(spark):
    rows = [(k % 3 or None, (k * 37) % 50, k) for k in range(120)]
    got = buckets.numbered(spark.createDataFrame(rows, "g int, t bigint, id bigint"), ["g"], ["t", "id"], F.call_function("div", F.col("t"), F.lit(9)))
    expected = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: x[1:]), 1):
            expected[r[2]] = n
    assert {r["id"]: r["n"] for r in got.collect()} == expected


def test_navigation_round_trip(spark):
    rows = [("f", d, t, c, p) for p, (d, t, c) in enumerate((d, t, c) for d in (1, 2) for t in (9, 5, 5) for c in (0, 1))]
    df = spark.createDataFrame(rows, "file string, dump_pos bigint, ts_ns bigint, chunk_idx int, pos bigint")
    order = [tuple(r) for r in assemble.in_order(df).collect()]
    assert order == sorted(rows)
    forward, cursor = [], None
    while found := navigate.step(df, cursor).collect():
        cursor = found[0].asDict()
        forward.append(tuple(found[0]))
    assert forward == order
    back = [tuple(r) for r in navigate.step(df, None, 100, forward=False).collect()]
    assert back == order[::-1]
    assert navigate.find(df, cursor, m.nothing()).count() == 0


def test_pruning_by_headers_never_loses_a_match(spark):
    draw = random.Random(8)
    rows = [(k // 10, draw.choice([1, 2]), 100 + k) for k in range(300)]
    chunk_pid = {c: draw.choice([1, 2]) for c in range(30)}
    rows = [(c, chunk_pid[c], draw.choice([3, 4] if c % 2 else [1]), t) for c, _, t in rows]
    df = spark.createDataFrame(rows, "c int, pid int, severity int, ts_ns bigint").withColumns({"process_name": F.concat(F.lit("p"), "pid"), "tid": F.col("ts_ns") % 5})
    heads = df.groupBy("c", "pid", "process_name").agg(F.max("ts_ns").alias("flush_ts_ns"), F.bit_or(F.expr("shiftleft(1, severity)")).alias("severity_mask"))
    leaves = [lambda: m.pid(1), lambda: m.severity("INFO"), lambda: m.severities(["INFO", "WARN"]), lambda: m.time_between(150, 320), lambda: m.process_name("p2"), lambda: m.tid(3), m.anything, m.nothing]

    def tree(depth):
        if not depth:
            return draw.choice(leaves)()
        kind = draw.choice("&|~")
        return ~tree(depth - 1) if kind == "~" else tree(depth - 1) & tree(depth - 1) if kind == "&" else tree(depth - 1) | tree(depth - 1)

    for _ in range(12):
        matcher = tree(3)
        whole = Counter(m.where(df, matcher).select("ts_ns").toPandas()["ts_ns"])
        kept = assemble.accepted_chunks(heads, matcher).select("c")
        assert Counter(m.where(df.join(kept, "c", "left_semi"), matcher).select("ts_ns").toPandas()["ts_ns"]) == whole


def test_levels_decide_on_indentation():
    assert not m.severities().shows_calls() and m.severities(["FUNC_TRACE", "INFO"]).shows_calls()
    assert (~m.severity("INFO")).shows_calls() and m.anything().shows_calls() and (~m.tid(1)).shows_calls()
    assert m.online_severities() == ("INFO", "WARN", "ERROR", "FATAL") and m.online_severities(error=True) == ("ERROR", "FATAL")


def test_shedding_levels(spark):
    n = {0: 9, 1: 9, 2: 1, 11: 1, 12: 1, 13: 9}
    got = stats.shedding(spark.createDataFrame([(1, s, c) for s, c in n.items()], "day int, second bigint, n bigint"), ["day"], 5).orderBy("second").collect()
    assert [r["level"] for r in got] == [1, 2, 2, 2, 1, 2]


def test_template_counts_and_bar(spark):
    r = spark.createDataFrame([(k % 4,) for k in range(10)], "log_id bigint")
    t = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "log_id bigint, template string")
    assert [tuple(x) for x in stats.template_counts(r, t, ["log_id"]).collect()] == [("b", 3), ("a", 5)]
    bar = stats.occupancy_bar(spark.createDataFrame([(1, 0), (1, 119)], "pid int, j int"), ["pid"], "j", 120).first()["bar"]
    assert len(bar) == 59 and bar[0] == "#" == bar[58] and bar.count("#") == 2


def test_a_call_without_values_and_missing_values(spark):
    v = f"array<{schema.VALUE}>"
    rows = [(0, [(0, 0, None, "cstr", 32, None, None, None, "f", None, None)]), (2, []), (2, None)]
    got = column(spark, rows, f"kind int, values {v}", F.coalesce(fmt.body_text(F.col("kind"), F.col("values")), F.lit("<?>")))
    assert got == ["--> f()", "", "<?>"]
