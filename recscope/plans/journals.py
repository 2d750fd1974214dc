"""Registered queries over journals: ``events`` written as a journal, read back and queried, with the same result in SQL.

A process of events is a file of its own, a day is a dump, and severity classes are chunks. A record has the event's number,
``k``, cents, the value, its severity class as an enumerator, and a text of up to 128 bytes, so records take one to four slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recscope.functions import formatting as fmt
from recscope.functions import matchers as m
from recscope.functions import wire
from recscope.functions.matchers import Limit
from recscope.journal import Journal
from recscope.operators import assemble, navigate, stats, writing
from recscope.plans import views
from recscope.plans.queries import DAY_NS, LATE, MID, query
from recscope.schema import FLAGS, ORDER_KEY, REC_TYPES
from recscope.scratch import fresh
from recscope.sources import manifest, metadata, values
from recscope.sources.journal import listed, write_journal
from recscope.sources.record_sink import stream_records, write_records, zones
from recscope.streaming import live

RINGS = [("CALL", 0), ("DEBUG", 1), ("OTHER", 7)]
KINDS = 3


def _flags(*names: str) -> int:
    return sum(FLAGS[n] for n in names)


def _logs() -> list[tuple[int, int, list[dict]]]:
    """A descriptor for each type of event and kind of record."""
    named = [("event", ("NUM_64",)), ("k", ("NUM_8", "UNSIGNED")), ("cents", ("NUM_64",)), ("value", ("DOUBLE",))]
    out = []
    for name in views.TYPES:
        params = [{"flags": FLAGS["CSTR"], "text": name}, *({"flags": _flags(*f, "NAMED_PARAM"), "name": n} for n, f in named)]
        params += [{"flags": _flags("ENUM", "NAMED_PARAM"), "name": "ring", "text": "Ring", "type_id": 0}, {"flags": _flags("VARRAY", "STR", "NAMED_PARAM"), "name": "note"}]
        out += [(kind, views.SEVERITY_OF[name], params) for kind in range(KINDS)]
    return out


def _file():
    return F.format_string("trace.%d.dump", "pid")


def _payload():
    """A record's payload: its descriptor and values."""
    ring = views.ring(F.col("severity"))
    number = F.when(ring == 2, 7).otherwise(ring)
    note = F.repeat("function", (F.col("k") % 17).cast("int"))
    return wire.payload(F.col("log_id") * KINDS + F.col("kind"), wire.little_endian(F.col("event_id"), 8), wire.little_endian(F.col("k"), 1), wire.little_endian(F.col("cents"), 8), wire.double_bytes(F.col("cents") / 100.0), wire.little_endian(number, 4), wire.text_bytes(note))


def _processes(r: DataFrame) -> DataFrame:
    """(file, pid, blob): the metadata of each process."""
    logs = _logs()
    blob = F.udf(lambda pid: metadata.encode(f"proc_{pid}", logs, [("Ring", RINGS)]), "binary")  # a row for each process
    return r.select("pid").distinct().select(_file().alias("file"), "pid", blob("pid").alias("blob"))


def written(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a journal of ``events``."""
    r = views.records(spark, sf_dir)
    ring = views.ring(F.col("severity"))
    records = r.select(_file().alias("file"), F.col("day").alias("dump"), ring.alias("chunk"), "pid", F.col("tid").cast("int").alias("tid"), "ts_ns", "nesting", "severity", _payload().alias("payload"))
    path = fresh(spark, "journal").removeprefix("file://")
    write_journal(writing.journal_slots(records, _processes(r), "events", 1), path)
    return path


def processes_table(spark: SparkSession, sf_dir: str) -> str:
    """The path of a stored table (pid, blob)."""
    path = fresh(spark, "processes")
    _processes(views.records(spark, sf_dir)).select("pid", "blob").write.parquet(path)
    return path


def by_time(spark: SparkSession, sf_dir: str, **options: int) -> str:
    """The folder of a journal of ``events`` whose files are ranges of time, with zone maps and a log."""
    records = views.records(spark, sf_dir).select("pid", F.col("tid").cast("int").alias("tid"), "ts_ns", "nesting", "severity", _payload().alias("payload"))
    path = fresh(spark, "journal").removeprefix("file://")
    write_records(records, processes_table(spark, sf_dir), path, machine="events", bootTime=1, **options)
    return path


def opened(spark: SparkSession, sf_dir: str) -> Journal:
    return Journal.open(spark, written(spark, sf_dir))


def _value(name: str, part: str):
    return F.filter("values", lambda v: v["name"] == name)[0][part]


NOTE_SQL = "repeat(function, (k % 17)::INT)"
COLUMNS_SQL = f"'trace.' || pid || '.dump' AS file, event_id, ts_ns, pid, tid, nesting, severity, log_id * 3 + kind AS log_id, process_name, kind, CASE WHEN kind < 2 THEN function END AS function, k, cents, cents / 100.0 AS value, CASE ring WHEN 0 THEN 'CALL' WHEN 1 THEN 'DEBUG' ELSE 'OTHER' END AS ring, {NOTE_SQL} AS note"


def _shown(found: DataFrame) -> DataFrame:
    """The columns of ``COLUMNS_SQL``."""
    own = [_value("event", "i").alias("event_id"), _value("k", "i").alias("k"), _value("cents", "i").alias("cents"), _value("value", "d").alias("value"), _value("ring", "s").alias("ring"), _value("note", "s").alias("note")]
    return found.select(F.element_at(F.split("file", "/"), -1).alias("file"), "ts_ns", "pid", "tid", "nesting", "severity", "log_id", "process_name", "kind", "function", *own)


@query(f"SELECT {COLUMNS_SQL} FROM r")
def journal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of the journal, re-assembled, joined with their metadata and decoded."""
    return _shown(opened(spark, sf_dir).records())


@query(f"SELECT {COLUMNS_SQL} FROM r WHERE NOT (severity = 2 OR pid = 0) AND ts_ns > {MID} AND ts_ns < {LATE} AND NOT tid = 5")
def journal_filter_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter that rules out chunks by their headers and slots by their fields."""
    matcher = ~(m.severity("DEBUG") | m.pid(0)) & m.time_between(MID, LATE) & ~m.tid(5)
    return _shown(opened(spark, sf_dir).with_filter(matcher).records())


@query(f"SELECT {COLUMNS_SQL} FROM r WHERE (ring = 0 AND k = 42) OR (process_name = 'proc_3' AND ring = 2 AND contains(function, 'ur'))")
def journal_filter_enumerators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enumerators by name, resolved through the catalogue, and parameters by name, at once."""
    j = opened(spark, sf_dir)
    ring = assemble.enumerator("CALL", metadata.enum_values(j.dimensions))
    other = m.process_name("proc_3") & m.params(ring="OTHER") & m.const_substring("ur")
    return _shown(j.with_filter((m.named_param("ring", ring) & m.named_param("k", 42)) | other).records())


@query(f"SELECT {COLUMNS_SQL} FROM r WHERE (contains(function, 'ur') AND NOT kind = 2) OR (kind < 2 AND function = 'view' AND k = 7)")
def journal_filter_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constant texts and functions, decided by descriptors: records of other descriptors are not decoded."""
    explicit = m.any_of(m.log_id(k) for k in range(2, len(views.TYPES) * KINDS, KINDS))
    matcher = (m.const_substring("ur") & ~explicit) | (m.function("view") & m.named_param("k", 7))
    return _shown(opened(spark, sf_dir).with_filter(matcher).records())


TEMPLATES_SQL = """t AS (SELECT process_name, pid, x.name AS function, x.log_id * 3 + q.kind AS log_id, q.kind, x.severity,
  rpad(process_name, 20, ' ') || ' ' || CASE x.severity WHEN 1 THEN '-----' WHEN 2 THEN 'DEBUG' WHEN 3 THEN 'INFO ' WHEN 4 THEN 'WARN ' ELSE 'ERROR' END || ' [' || lpad(pid::VARCHAR, 5, ' ') || '] <026 >: '
  || CASE q.kind WHEN 0 THEN '--> ' || x.name || '(event = <long long>, k = <char>, cents = <long long>, value = <double>, ring = <Ring>, note = <vstr>)'
     WHEN 1 THEN '<-- ' || x.name || '(<long long> <char> <long long> <double> <Ring> <vstr>)' ELSE x.name || ' <long long> <char> <long long> <double> <Ring> <vstr>' END AS template
  FROM (SELECT DISTINCT pid, process_name FROM r) p,
  (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS name, unnest([0, 1, 2, 3, 4]) AS log_id, unnest([1, 5, 4, 3, 2]) AS severity) x, (SELECT unnest([0, 1, 2]) AS kind) q)"""


@query("SELECT '(' || lpad(log_id::VARCHAR, 5, '0') || ') ' || template AS value FROM t", f"{views.RECORDS_SQL},{TEMPLATES_SQL}")
def journal_metadata_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number and template of every descriptor."""
    return opened(spark, sf_dir).metadata_lines()


@query("SELECT 'trace.' || pid || '.dump' AS file, template, count(event_id) AS occurrences FROM t JOIN (SELECT event_id, pid, log_id * 3 + kind AS log_id FROM r) USING (pid, log_id) GROUP BY pid, template", f"{views.RECORDS_SQL},{TEMPLATES_SQL}")
def journal_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of each template of each file."""
    found = opened(spark, sf_dir).statistics(by_file=True)
    return found.withColumn("file", F.element_at(F.split("file", "/"), -1))


@query("SELECT pid, process_name, 'Ring' AS type_name, unnest(['CALL', 'DEBUG', 'OTHER']) AS name, unnest([0, 1, 7]) AS value FROM (SELECT DISTINCT pid, process_name FROM r)")
def journal_enumerators(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = opened(spark, sf_dir).dimensions
    named = metadata.processes(dims).join(metadata.enum_values(dims), ["file", "meta_pos"])
    return named.select("pid", "process_name", "type_name", "name", "value")


@query("SELECT 'trace.' || pid || '.dump' AS file, 'events' AS machine_id, 1 AS boot_time_us FROM r GROUP BY pid")
def journal_file_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metadata.file_headers(opened(spark, sf_dir).source.read(values.HEADERS))
    return found.withColumn("file", F.element_at(F.split("file", "/"), -1))


@query(
    f"SELECT day, pid, ring AS chunk, max(ts_ns) AS flush_ts_ns, bit_or(1 << severity)::INT AS severity_mask, sum((34 + strlen({NOTE_SQL}) + (CASE WHEN strlen({NOTE_SQL}) > 127 THEN 1 ELSE 0 END) + 43) // 44)::BIGINT AS n_records FROM r GROUP BY day, pid, ring",
)
def journal_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk headers, with the day of their dump and the place of their class."""
    found = assemble.chunks(opened(spark, sf_dir).source.read(values.HEADERS))
    day = F.call_function("div", F.col("flush_ts_ns"), F.lit(DAY_NS))
    chunk = views.ring(F.floor(F.log2("severity_mask")))
    return found.select(day.alias("day"), "pid", chunk.alias("chunk"), "flush_ts_ns", "severity_mask", "n_records")


@query(
    "SELECT event_id, max(x.ts_ns) OVER (PARTITION BY pid, day) AS last_ns, min(x.ts_ns) OVER (PARTITION BY pid, day, ring) AS first_ns FROM r x",
)
def journal_dump_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each record the greatest time of its dump and the least time of its chunk."""
    r = opened(spark, sf_dir).records()
    dumps = r.groupBy("file", "dump_pos").agg(F.max("ts_ns").alias("last_ns"))
    chunks = r.groupBy("file", "dump_pos", "chunk_idx").agg(F.min("ts_ns").alias("first_ns"))
    return r.join(dumps, ["file", "dump_pos"]).join(chunks, ["file", "dump_pos", "chunk_idx"]).select(_value("event", "i").alias("event_id"), "last_ns", "first_ns")


BODY_SQL = f"""CASE kind WHEN 0 THEN '--> ' || function || '(event = ' || event_id || ', k = ' || k || ', cents = ' || cents || ', value = ' || printf('%.6f', (cents / 100.0)::DOUBLE) || ', ring = ' || CASE ring WHEN 0 THEN 'CALL' WHEN 1 THEN 'DEBUG' ELSE 'OTHER' END || ', note = "' || {NOTE_SQL} || '")'
 ELSE CASE kind WHEN 1 THEN '<-- ' || function || '(' ELSE function || ' ' END || event_id || ' ' || k || ' ' || cents || ' ' || printf('%.6f', (cents / 100.0)::DOUBLE) || ' ' || CASE ring WHEN 0 THEN 'CALL' WHEN 1 THEN 'DEBUG' ELSE 'OTHER' END || ' "' || {NOTE_SQL} || '"' || CASE kind WHEN 1 THEN ')' ELSE '' END END"""
LABEL_SQL = "CASE severity WHEN 1 THEN '-----' WHEN 2 THEN 'DEBUG' WHEN 3 THEN 'INFO ' WHEN 4 THEN 'WARN ' ELSE 'ERROR' END"


@query(f"SELECT {LABEL_SQL} || ' ' || rpad(process_name, 20, ' ') || ' ' || ts_ns || ' [' || lpad(tid::VARCHAR, 5, ' ') || '] : ' || {BODY_SQL} AS value FROM r WHERE severity IN (3, 4, 5, 6)")
def journal_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the default severities with raw times."""
    j = opened(spark, sf_dir).with_filter(m.severities()).with_options(times="raw")
    return j.lines().select("value")


@query(f"SELECT {LABEL_SQL} || ' ' || rpad(process_name, 20, ' ') || '  [' || lpad(tid::VARCHAR, 5, ' ') || '] : ' || repeat('    ', nesting) || {BODY_SQL} AS value FROM r WHERE kind = 0 AND pid = 2")
def journal_format_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of one process without times, indented by nesting, read from the text files of a dump."""
    j = opened(spark, sf_dir).with_filter(m.pid(2)).with_options(times="hidden", indent=True)
    path = fresh(spark, "lines")
    j.dump(path)
    return spark.read.text(path).where(F.col("value").contains("--> "))


@query(f"(SELECT {COLUMNS_SQL} FROM r WHERE pid = (SELECT max(pid) FROM r) AND severity IN (3, 4, 5, 6) ORDER BY day DESC, ts_ns DESC LIMIT 25)")
def journal_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last records of the journal, from its end."""
    return _shown(opened(spark, sf_dir).with_filter(m.severities()).step(None, 25, forward=False))


@query(f"(SELECT {COLUMNS_SQL} FROM r WHERE pid = 3 AND contains({BODY_SQL}, 'k = 7') ORDER BY ts_ns LIMIT 1)")
def journal_find_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record of a process whose written line contains a text."""
    return _shown(opened(spark, sf_dir).with_filter(m.pid(3)).find_text(None, "k = 7"))


@query("SELECT rec_type, count(*) AS n FROM (SELECT 2 AS rec_type FROM (SELECT DISTINCT pid FROM r) UNION ALL SELECT 5 FROM (SELECT DISTINCT pid, day FROM r) UNION ALL SELECT 6 FROM (SELECT DISTINCT pid, day, ring FROM r)) GROUP BY 1")
def journal_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers by type; every slot between them belongs to the nearest one before."""
    kinds = tuple(REC_TYPES[n] for n in ("FILE_HEADER", "DUMP_HEADER", "BUFFER_CHUNK"))
    near = navigate.headers_around(opened(spark, sf_dir).source.read(Limit("rec_type", among=kinds)), REC_TYPES["FILE_HEADER"])
    return near.where("header_pos = 0 OR pos = 0").groupBy("rec_type").agg(F.count("*").alias("n"))


@query(f"SELECT ts_ns, pid, tid, severity, ((34 + strlen({NOTE_SQL}) + (CASE WHEN strlen({NOTE_SQL}) > 127 THEN 1 ELSE 0 END) + 43) // 44)::INT AS n_fragments FROM r WHERE severity IN (3, 4, 5, 6)")
def journal_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal followed as a stream, re-assembled with state and written by two sinks."""
    path, out = written(spark, sf_dir), fresh(spark, "captured")
    stream = live.shown(live.assembled(live.follow(spark, path)), m.severities())
    line = F.concat_ws(" ", "ts_ns", "pid", "tid", "severity", "n_fragments")
    live.written(stream, fresh(spark, "offsets"), live.parquet_sink(f"{out}-rows"), live.text_sink(f"{out}-lines", line), available_now=True).awaitTermination()
    rows = spark.read.parquet(f"{out}-rows").select("ts_ns", "pid", "tid", "severity", "n_fragments")
    lines = spark.read.text(f"{out}-lines").select("value").distinct()
    return rows.withColumn("value", line).join(lines, "value", "left_semi").drop("value")


LINES_SQL = f"SELECT {LABEL_SQL} || ' ' || rpad(process_name, 20, ' ') || ' ' || ts_ns || ' [' || lpad(tid::VARCHAR, 5, ' ') || '] : ' || {BODY_SQL} AS value FROM r"


def _followed(spark: SparkSession, path: str, batches: int = 4) -> tuple[DataFrame, str]:
    """A journal as a stream of about so many batches, and the folder of its checkpoint."""
    slots = sum(n for _, n in listed(path))
    offsets = fresh(spark, "offsets")
    return live.follow(spark, path, slotsPerBatch=-(-slots // batches), progress=f"{offsets}/planned/offset.json"), f"{offsets}/query"


@query(f"{LINES_SQL} WHERE severity IN (3, 4, 5, 6) AND (pid = 3 OR contains(function, 'ur') OR k = 7)")
def journal_stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written lines of a journal that is followed in bounded batches: process, descriptors and values come from the stream itself."""
    out = fresh(spark, "live")
    slots, offsets = _followed(spark, written(spark, sf_dir))
    wanted = m.severities() & (m.process_name("proc_3") | m.const_substring("ur") | m.named_param("k", 7))
    found = live.lines(live.records(slots, wanted), fmt.FormatOptions(times="raw")).where("event = 'record'")
    live.drained(live.written(found, offsets, live.text_sink(out, F.col("value"))))
    return spark.read.text(out).select("value")


@query("SELECT DISTINCT pid, process_name FROM r")
def journal_stream_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream tells of new processes while it is followed."""
    out = fresh(spark, "news")
    slots, offsets = _followed(spark, written(spark, sf_dir))
    news = live.records(slots, m.nothing()).where("event = 'metadata'").select("pid", "process_name")
    live.drained(live.written(news, offsets, live.parquet_sink(out)))
    return spark.read.parquet(out).select("pid", "process_name")


NO_FILE_SQL = COLUMNS_SQL.partition(", ")[2]
#: Slots of a chunk and of a file of the journals by time: small, so that there are many at every scale.
SMALL = {"slotsPerChunk": 512, "slotsPerFile": 8192}


@query(f"SELECT {NO_FILE_SQL} FROM r")
def journal_recaptured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal followed as a stream and written by the streaming sink, in files of bounded size, a version of the log for each batch."""
    slots, offsets = _followed(spark, written(spark, sf_dir))
    path = fresh(spark, "recaptured").removeprefix("file://")
    live.drained(stream_records(live.assembled(slots), processes_table(spark, sf_dir), path, offsets, **SMALL))
    return _shown(Journal.open(spark, path).records()).drop("file")


@query(f"SELECT {NO_FILE_SQL} FROM r WHERE ts_ns > {MID} AND ts_ns < {MID + DAY_NS // 4} AND severity IN (3, 4, 5, 6)")
def journal_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of a day of a journal by time: only its files are opened, and of those only the chunks that a zone map lets through."""
    wanted = m.time_between(MID, MID + DAY_NS // 4) & m.severities()
    return _shown(Journal.open(spark, by_time(spark, sf_dir, **SMALL)).with_filter(wanted).records()).drop("file")


@query(f"SELECT event_id, ts_ns, ts_ns > {MID} AS kept FROM r")
def journal_retired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that end before a time are retired: later records are still there, and a reader of the version before sees all of them."""
    path = by_time(spark, sf_dir, **SMALL)
    before = manifest.state(path).version
    manifest.retire(path, before_ns=MID)
    now = _shown(Journal.open(spark, path).with_filter(m.time_between(MID, 1 << 62)).records()).select("event_id", "ts_ns", F.lit(True).alias("kept"))
    then = _shown(Journal.open(spark, path, version=before).records()).where(F.col("ts_ns") <= MID).select("event_id", "ts_ns", F.lit(False).alias("kept"))
    return now.unionByName(then)


FRAGMENTS_SQL = f"(34 + strlen({NOTE_SQL}) + (CASE WHEN strlen({NOTE_SQL}) > 127 THEN 1 ELSE 0 END) + 43) // 44"


@query(f"SELECT pid, sum({FRAGMENTS_SQL})::BIGINT AS n_slots, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, bit_or(1 << severity)::BIGINT AS severity_mask FROM r GROUP BY pid")
def journal_zone_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a journal has of each process, from its zone maps alone."""
    z = zones(spark, by_time(spark, sf_dir, **SMALL))
    return z.groupBy("pid").agg(F.sum("n").alias("n_slots"), F.min("low").alias("first_ns"), F.max("high").alias("last_ns"), F.bit_or("mask").alias("severity_mask"))


@query(f"SELECT TRUE AS any_file, TRUE AS capped, sum({FRAGMENTS_SQL})::BIGINT AS n_slots FROM r")
def journal_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a journal's folder: whether there are any, whether each is within its cap, and the slots of their records."""
    path = by_time(spark, sf_dir, **SMALL)
    files = zones(spark, path).groupBy("file").agg(F.sum("n").alias("n"), F.count("*").alias("chunks"))
    return files.agg((F.count("*") > 0).alias("any_file"), (F.max(F.col("n") + F.col("chunks")) <= SMALL["slotsPerFile"]).alias("capped"), F.sum("n").alias("n_slots"))


def _nested_logs() -> list[tuple[int, int, list[dict]]]:
    """A record that has a record of an event that has one of a thread."""
    inner = {"flags": FLAGS["NESTED_LOG"]}
    return [
        (2, 3, [{"flags": FLAGS["CSTR"], "text": "checked"}, inner, {"flags": _flags("NUM_8", "UNSIGNED")}]),
        (2, 3, [{"flags": FLAGS["CSTR"], "text": "event"}, {"flags": FLAGS["NUM_64"]}, inner]),
        (2, 3, [{"flags": FLAGS["CSTR"], "text": "by"}, {"flags": FLAGS["NUM_32"]}]),
    ]


def nested_journal(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a journal of ``events`` as nested records; those of kind 1 name an inner record that no metadata has."""
    r = views.records(spark, sf_dir)
    by = wire.payload(F.lit(2), wire.little_endian(F.col("tid"), 4))
    event = wire.payload(F.lit(1), wire.little_endian(F.col("event_id"), 8), by)
    data = wire.payload(F.lit(0), F.when(F.col("kind") == 1, wire.payload(F.lit(9))).otherwise(event), wire.little_endian(F.col("k"), 1))
    records = r.select("pid", F.col("tid").cast("int").alias("tid"), "ts_ns", "nesting", "severity", data.alias("payload"))
    logs = _nested_logs()
    blob = F.udf(lambda pid: metadata.encode(f"proc_{pid}", logs, []), "binary")  # a row for each process
    processes, path = fresh(spark, "processes"), fresh(spark, "nested").removeprefix("file://")
    r.select("pid").distinct().select("pid", blob("pid").alias("blob")).write.parquet(processes)
    write_records(records, processes, path, **SMALL)
    return path


NESTED_SQL = "CASE kind WHEN 1 THEN 'checked L? 9' ELSE 'checked { event ' || event_id || ' { by ' || tid || ' } } ' || k END"


@query(f"SELECT pid, ts_ns, {NESTED_SQL} AS value FROM r")
def journal_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records within records, through writer, reader and format; an unknown inner record ends its line."""
    found = Journal.open(spark, nested_journal(spark, sf_dir)).records()
    return found.select("pid", "ts_ns", fmt.body_text(F.col("kind"), F.col("values")).alias("value"))


@query(f"SELECT pid, ts_ns, {NESTED_SQL} AS value FROM r WHERE kind <> 1 AND (event_id % 5 = 2 AND tid = 7 OR k = 3)")
def journal_nested_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters see the values of inner records."""
    wanted = (m.any_param(7) | m.any_param(3)) & ~m.log_id(1)
    found = Journal.open(spark, nested_journal(spark, sf_dir)).with_filter(wanted).records()
    number = lambda depth: F.get(F.filter("values", lambda v: (v["depth"] == depth) & (v["kind"] == "int")), F.lit(0))["i"]
    k, event, thread = map(number, range(3))
    exact = found.where(((event % 5 == 2) & (thread == 7)) | ((k == 3) & event.isNotNull()))
    return exact.select("pid", "ts_ns", fmt.body_text(F.col("kind"), F.col("values")).alias("value"))


@query("SELECT pid, ts_ns // 60000000000 * 60 AS second, count(*) AS n FROM r WHERE severity > 2 GROUP BY ALL")
def journal_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = opened(spark, sf_dir).with_filter(m.severities()).records()
    return stats.rates(found, ["pid"], 60)
