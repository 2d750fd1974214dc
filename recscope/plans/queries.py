"""The registered queries: each applies operators to whole tables; ``ORACLES`` has the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recscope.functions import formatting as fmt
from recscope.functions import matchers as m
from recscope.operators import assemble, buckets, navigate, stats
from recscope.plans import views
from recscope.plans.views import CHUNKS_SQL, FILES_SQL, RECORDS_SQL, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DAY_NS = 86_400 * fmt.SECOND
#: The place of a record of ``events``.
PLACE = ("ts_ns", "event_id")
#: 2024-01-15 and 2024-02-01, in nanoseconds.
MID, LATE = 1_705_276_800 * fmt.SECOND, 1_706_745_600 * fmt.SECOND
SHOWN = "event_id, ts_ns, pid, tid, nesting, severity"


def query(sql: str | None = None, views_sql: str = RECORDS_SQL):
    """Register a function under its name, with its SQL after the views that it names."""

    def registered(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {views_sql}\n{sql}" if views_sql else sql
        return f

    return registered


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*SHOWN.split(", "))


def _matching(spark: SparkSession, sf_dir: str, matcher: m.Matcher) -> DataFrame:
    return _shown(m.where(views.records(spark, sf_dir), matcher))


def _where(condition: str) -> str:
    return f"SELECT {SHOWN} FROM r WHERE {condition}"


TEMPLATE_SQL = "format('{{:<20s}} {{}} [{{:5d}}] ', process_name, CASE severity WHEN 1 THEN '-----' WHEN 2 THEN 'DEBUG' WHEN 3 THEN 'INFO ' WHEN 4 THEN 'WARN ' ELSE 'ERROR' END, pid) || function".replace("{{", "{").replace("}}", "}")


@query(f"SELECT {TEMPLATE_SQL} AS template, count(*) AS occurrences FROM r WHERE severity IN (3, 4, 5, 6) GROUP BY 1")
def flagship_template_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of each template among the records of the default severities."""
    r = m.where(views.records(spark, sf_dir), m.severities())
    key = ["pid", "process_name", "severity", "function"]
    text = F.concat(F.format_string("%-20s %s [%5d] ", "process_name", fmt.severity_label(F.col("severity")), "pid"), "function")
    return stats.template_counts(r, r.select(*key).distinct().withColumn("template", text), key)


@query(f"SELECT count(*) AS n_templates, sum(n)::BIGINT AS n_records FROM (SELECT {TEMPLATE_SQL} AS template, count(*) AS n FROM r WHERE severity IN (3, 4, 5, 6) GROUP BY 1)")
def template_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.template_totals(flagship_template_stats(spark, sf_dir))


@query(_where("(pid = 3 AND nesting = 2) OR (tid = 12 AND NOT log_id = 0)"))
def filter_pid_tid_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matching(spark, sf_dir, (m.pid(3) & m.nesting(2)) | (m.tid(12) & ~m.log_id(0)))


@query(_where("NOT (severity = 5 OR tid = 5) AND NOT (pid = 1 AND nesting = 0)"))
def filter_not_demorgan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matching(spark, sf_dir, ~(m.severity("ERROR") | m.tid(5)) & ~(m.pid(1) & m.nesting(0)))


@query(_where("severity IN (2, 3, 4, 5, 6)"))
def filter_severity_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matching(spark, sf_dir, m.severities(("DEBUG", *m.DEFAULT_SEVERITIES)))


@query(_where("FALSE OR NOT FALSE"))
def filter_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matching(spark, sf_dir, m.nothing() | m.anything())


@query(_where(f"ts_ns > {MID} AND ts_ns < {LATE}"))
def filter_time_open_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(m.where(views.records(spark, sf_dir, MID, LATE), m.time_between(MID, LATE)))


@query(_where("kind IN (0, 1) AND function = 'click' AND severity = 1 AND (k = 42 OR cents = 42)"))
def filter_function_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matching(spark, sf_dir, m.call("click", 42))


@query(_where("k = 77 OR cents = 77"))
def filter_any_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matching(spark, sf_dir, m.any_param(77))


@query(_where("k = 77"))
def filter_named_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matching(spark, sf_dir, m.named_param("k", 77))


@query("SELECT doc_id, source FROM documents WHERE contains(text, '%')", "")
def filter_const_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as constant texts; the sign is meant literally."""
    d = table(spark, sf_dir, "documents").withColumn("const_strs", F.array("text"))
    return m.where(d, m.const_substring("%")).select("doc_id", "source")


@query(_where("function = 'signup'"))
def filter_typename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matching(spark, sf_dir, m.type_name("type_signup"))


@query(_where("process_name = 'proc_6'"))
def filter_procname(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matching(spark, sf_dir, m.process_name("proc_6"))


@query(_where("contains(function, 'ur') AND severity IN (3, 4, 5, 6)"))
def filter_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matching(spark, sf_dir, m.grep("ur"))


@query(_where("(function = 'view' AND kind IN (0, 1)) OR ((k = 5 OR cents = 5) AND k = 5 AND severity = 5 AND process_name <> 'proc_2') OR (contains(function, 'pur') AND nesting = 4 AND pid = 7)"))
def filter_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = m.params(5, k=5) & m.severity("ERROR") & ~m.process_name("proc_2")
    return _matching(spark, sf_dir, m.any_of([m.function("view"), named, m.all_of([m.const_substring("pur"), m.nesting(4), m.pid(7)])]))


@query(f"SELECT {SHOWN} FROM r WHERE process_name NOT IN ('proc_1', 'proc_4')")
def exclude_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the processes of a deny list, however long it is."""
    denied = spark.createDataFrame([("proc_1",), ("proc_4",)], "process_name string")
    return _shown(views.records(spark, sf_dir).join(denied, "process_name", "left_anti"))


@query(
    f"SELECT {SHOWN.replace('pid', 'r.pid')} FROM r WHERE NOT (severity = 2 OR pid = 0) AND ts_ns > {MID} AND NOT (tid = 5)",
    f"{RECORDS_SQL},{CHUNKS_SQL}",
)
def chunk_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only chunks whose headers allow for a match are read; negations prune soundly."""
    matcher = ~(m.severity("DEBUG") | m.pid(0)) & m.time_between(MID, 1 << 62) & ~m.tid(5)
    kept = assemble.accepted_chunks(views.chunks(spark, sf_dir), matcher).select(F.col("dump_pos").alias("day"), "pid", "ring")
    r = views.records(spark, sf_dir).withColumn("ring", views.ring(F.col("severity")))
    return _shown(m.where(r.join(kept, ["day", "pid", "ring"], "left_semi"), matcher))


@query(
    "SELECT severity_mask & 62 AS severity_mask, array_to_string(list_filter(['FUNC_TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR'], lambda x, i: severity_mask & (1 << i) <> 0), ', ') AS names, "
    "(CASE WHEN severity_mask & 2 <> 0 THEN 2 WHEN severity_mask & 4 <> 0 THEN 3 WHEN severity_mask & 8 <> 0 THEN 4 WHEN severity_mask & 16 <> 0 THEN 5 ELSE 6 END) AS least, count(*) AS n FROM c GROUP BY ALL",
    f"{RECORDS_SQL},{CHUNKS_SQL}",
)
def severity_mask_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.chunks(spark, sf_dir)
    counted = c.groupBy("severity_mask").agg(F.count("*").alias("n"))
    return counted.select("severity_mask", fmt.severity_mask_text(F.col("severity_mask")).alias("names"), fmt.least_severity(F.col("severity_mask")).alias("least"), "n")


@query("SELECT event_id, row_number() OVER (PARTITION BY day ORDER BY ts_ns, chunk_idx, event_id) AS place, day FROM (SELECT *, pid * 3 + ring AS chunk_idx FROM r)")
def merge_sorted_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each record in its dump when the chunks are merged by time."""
    r = views.records(spark, sf_dir).withColumn("chunk_idx", F.col("pid") * 3 + views.ring(F.col("severity")))
    return buckets.numbered_by_ranges(r.select("day", "ts_ns", "chunk_idx", "event_id"), ["day"], ["ts_ns", "chunk_idx", "event_id"], "place").select("event_id", "place", "day")


@query(
    "SELECT day, stream, id, row_number() OVER (PARTITION BY day ORDER BY stream, id) AS place FROM (SELECT o_orderdate AS day, 0 AS stream, o_orderkey AS id FROM orders UNION ALL SELECT l_shipdate, 1, l_orderkey * 10 + l_linenumber FROM lineitem)",
    "",
)
def merge_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ordered inputs with many equal times: of a time the first input's rows come first."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("day"), F.col("o_orderkey").alias("id"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("day"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return buckets.numbered_by_ranges(navigate.tagged(o, li), ["day"], ["stream", "id"], "place").select("day", "stream", "id", "place")


@query(f"SELECT {SHOWN} FROM r WHERE severity = 5 AND ts_ns > {MID} ORDER BY ts_ns, event_id LIMIT 20")
def next_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(navigate.step(views.records(spark, sf_dir, after_ns=MID), {"ts_ns": MID, "event_id": 1 << 60}, 20, m.severity("ERROR"), PLACE))


@query(f"SELECT {SHOWN} FROM r WHERE severity = 5 AND ts_ns < {MID} ORDER BY ts_ns DESC, event_id DESC LIMIT 20")
def prev_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(navigate.step(views.records(spark, sf_dir, before_ns=MID), {"ts_ns": MID, "event_id": -1}, 20, m.severity("ERROR"), PLACE, forward=False))


@query(f"(SELECT 'next' AS way, {SHOWN} FROM r WHERE ts_ns > {MID} AND severity IN (3, 4, 5, 6) AND k = 42 ORDER BY ts_ns LIMIT 1) UNION ALL (SELECT 'previous', {SHOWN} FROM r WHERE ts_ns < {MID} AND severity IN (3, 4, 5, 6) AND k = 42 ORDER BY ts_ns DESC LIMIT 1)")
def find_by_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest records on both sides of a cursor that pass the installed filter and the expression."""
    r = views.records(spark, sf_dir)
    each = [navigate.find(r, {"ts_ns": MID, "event_id": edge}, m.named_param("k", 42), m.severities(), PLACE, forward).select(F.lit(way).alias("way"), *SHOWN.split(", ")) for way, forward, edge in (("next", True, 1 << 60), ("previous", False, -1))]
    return each[0].unionByName(each[1])


@query("SELECT event_id, (SELECT min_by(x.event_id, (x.ts_ns, x.event_id)) FROM r x WHERE x.pid = r.pid AND x.severity = 5 AND (x.ts_ns, x.event_id) > (r.ts_ns, r.event_id)) AS next_error FROM r")
def find_next_error_per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.records(spark, sf_dir)
    return navigate.nearest_match(r, m.severity("ERROR"), ("pid",), PLACE, "next_error", buckets.width(r, "ts_ns")).select("event_id", "next_error")


@query("SELECT event_id, (SELECT max_by(x.event_id, (x.ts_ns, x.event_id)) FROM r x WHERE x.tid = r.tid AND x.nesting = r.nesting - 1 AND (x.ts_ns, x.event_id) < (r.ts_ns, r.event_id)) AS caller FROM r")
def find_caller(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.records(spark, sf_dir)
    return navigate.caller(r, PLACE, "caller", buckets.width(r, "ts_ns")).select("event_id", "caller")


@query("SELECT event_id, lead(event_id) OVER (PARTITION BY tid, nesting ORDER BY ts_ns, event_id) AS same_level FROM r")
def find_same_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.records(spark, sf_dir)
    return navigate.same_level(r, PLACE, "same_level", buckets.width(r, "ts_ns")).select("event_id", "same_level")


@query(f"SELECT {SHOWN}, day = (SELECT max(day) FROM (SELECT day, min(ts_ns) AS t FROM r GROUP BY day) WHERE t <= {MID}) AS in_first_dump FROM r WHERE ts_ns >= {MID}")
def seek_to_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from a time on, and whether they are in the dump that a seek would land in."""
    r = views.records(spark, sf_dir)
    dumps = r.groupBy(F.col("day").alias("dump_pos")).agg(F.min("ts_ns").alias("ts_ns")).withColumn("file", F.lit("events"))
    first = navigate.first_dump(dumps, MID).select(F.col("dump_pos").alias("first_day"))
    found = navigate.from_time(views.records(spark, sf_dir, after_ns=MID), MID).join(first, F.col("day") == F.col("first_day"), "left")
    return found.select(*SHOWN.split(", "), F.col("first_day").isNotNull().alias("in_first_dump"))


@query("SELECT min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, min_by(event_id, (ts_ns, event_id)) AS first_id, max_by(event_id, (ts_ns, event_id)) AS last_id FROM r")
def first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = navigate.ends(views.records(spark, sf_dir), PLACE)
    return found.select(F.col("first.ts_ns").alias("first_ns"), F.col("last.ts_ns").alias("last_ns"), F.col("first.event_id").alias("first_id"), F.col("last.event_id").alias("last_id"))


@query("SELECT conv_id, min(turn) AS turn, string_agg(text, '' ORDER BY turn) AS payload, count(*)::INT AS n_fragments FROM conversations GROUP BY conv_id", "")
def assemble_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations from their turns, as records are re-assembled from fragments."""
    return assemble.reassemble(views.fragments(spark, sf_dir), ("conv_id",), "turn").select("conv_id", "turn", "payload", "n_fragments")


@query("SELECT conv_id, min(turn) AS turn, string_agg(text, '' ORDER BY turn) AS payload, count(*)::INT AS n_fragments FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS z FROM conversations WHERE turn <> 0 OR conv_id % 3 <> 0) WHERE conv_id % 3 <> 0 GROUP BY conv_id", "")
def assemble_without_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third conversation lost its first turn: its other fragments are orphans and go."""
    lost = views.fragments(spark, sf_dir).where((F.col("turn") != 0) | (F.col("conv_id") % 3 != 0))
    return assemble.reassemble(lost, ("conv_id",), "turn").select("conv_id", "turn", "payload", "n_fragments")


@query(
    "SELECT event_id, d.name AS descriptor FROM r JOIN (SELECT unnest([0, 1, 2, 3]) AS log_id, unnest(['click', 'error', 'purchase', 'signup']) AS name) d USING (log_id)",
)
def join_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of an unknown descriptor (here those of ``view``) are dropped."""
    dim = spark.createDataFrame([(k, t) for k, t in enumerate(views.TYPES[:4])], "log_id bigint, descriptor string")
    return assemble.with_descriptor(views.records(spark, sf_dir), dim, ("log_id",)).select("event_id", "descriptor")


@query("SELECT c_custkey, coalesce(n_name, '<? enum>') AS nation FROM (SELECT c_custkey, c_nationkey + CASE WHEN c_custkey % 10 = 0 THEN 100 ELSE 0 END AS k FROM customer) LEFT JOIN nation ON n_nationkey = k", "")
def join_enum_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enumerators by value; values without one keep their row."""
    enums = table(spark, sf_dir, "nation").select(F.lit(0).alias("type_id"), F.col("n_nationkey").alias("value"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("idx"))
    own = table(spark, sf_dir, "customer").select("c_custkey", F.lit(0).alias("type_id"), (F.col("c_nationkey") + F.when(F.col("c_custkey") % 10 == 0, 100).otherwise(0)).alias("v"))
    return assemble.with_enum_names(own, enums, ("type_id",), "v", "nation").select("c_custkey", "nation")


@query("SELECT p_partkey, (4 + CASE p_size % 5 WHEN 0 THEN 1 + 8 WHEN 1 THEN 2 + 1 WHEN 2 THEN 4 + 4 WHEN 3 THEN 0 ELSE 0 END)::INT AS size, p_size % 5 IN (0, 2, 4) AS exact FROM part", "")
def descriptor_min_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least wire size of descriptors made up from parts: numbers, arrays, enumerators, nested logs and doubles."""
    p = table(spark, sf_dir, "part")
    flags = F.when(F.col("p_size") % 5 == 0, F.array(F.lit(0x1), F.lit(0x8))).when(F.col("p_size") % 5 == 1, F.array(F.lit(0x2), F.lit(0x10))).when(F.col("p_size") % 5 == 2, F.array(F.lit(0x800), F.lit(0x4))).when(F.col("p_size") % 5 == 3, F.array(F.lit(0x8), F.lit(0x1000))).otherwise(F.array(F.lit(0x40000)))
    made = fmt.min_wire_size(F.transform(flags, lambda f: F.struct(f.cast("bigint").alias("flags"))))
    return p.select("p_partkey", made["size"].alias("size"), made["exact"].alias("exact"))


_NUMBERS_SQL = "'k = ' || k || ', value_cents = ' || cents"
LINE_SQL = (
    "CASE severity WHEN 1 THEN '-----' WHEN 2 THEN 'DEBUG' WHEN 3 THEN 'INFO ' WHEN 4 THEN 'WARN ' ELSE 'ERROR' END || ' ' || rpad(process_name, 20, ' ') || ' ' || "
    "strftime(make_timestamp(ts_ns // 1000), '%a %b ') || lpad(day(make_timestamp(ts_ns // 1000))::VARCHAR, 2, ' ') || strftime(make_timestamp(ts_ns // 1000), ' %H:%M:%S %Y') || ':' || rpad((ts_ns % 1000000000)::VARCHAR, 10, ' ') || "
    f"' [' || lpad(tid::VARCHAR, 5, ' ') || '] : ' || repeat('    ', nesting) || CASE kind WHEN 0 THEN '--> ' || function || '(' || {_NUMBERS_SQL} || ')' WHEN 1 THEN '<-- ' || function || '(' || k || ' ' || cents || ')' ELSE function || ' ' || k || ' ' || cents END"
)


@query(f"SELECT event_id, {LINE_SQL} AS line FROM r")
def format_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = fmt.FormatOptions(indent=True)
    r = views.records(spark, sf_dir)
    return r.select("event_id", fmt.line_text(fmt.body_text(F.col("kind"), F.col("values"), options), options).alias("line"))


@query("SELECT event_id, CASE severity WHEN 1 THEN '-----' WHEN 2 THEN 'DEBUG' WHEN 3 THEN 'INFO ' WHEN 4 THEN 'WARN ' ELSE 'ERROR' END || ' ' || strftime(make_timestamp(ts_ns // 1000), '%d/%m %H:%M:%S') || ' [' || lpad(pid::VARCHAR, 5, ' ') || ':' || lpad(tid::VARCHAR, 5, ' ') || '] : ' || CASE kind WHEN 0 THEN '--> ' || function || '(k = 0x' || printf('%x', k) || ', value_cents = 0x' || printf('%x', cents) || ')' WHEN 1 THEN '<-- ' || function || '(k = 0x' || printf('%x', k) || ' value_cents = 0x' || printf('%x', cents) || ')' ELSE function || ' k = 0x' || printf('%x', k) || ' value_cents = 0x' || printf('%x', cents) END AS line FROM r")
def format_compact_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = fmt.FormatOptions(compact=True, always_hex=True, field_names=True)
    r = views.records(spark, sf_dir)
    return r.select("event_id", fmt.line_text(fmt.body_text(F.col("kind"), F.col("values"), options), options).alias("line"))


@query(f"SELECT {SHOWN} FROM r WHERE contains({LINE_SQL}, 'k = 99, value_cents = 1')")
def search_formatted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose written line contains a text."""
    options = fmt.FormatOptions(indent=True)
    r = views.records(spark, sf_dir)
    return _shown(r.where(fmt.line_text(fmt.body_text(F.col("kind"), F.col("values"), options), options).contains("k = 99, value_cents = 1")))


@query(
    """SELECT doc_id, '"' || array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h:
 CASE h WHEN '09' THEN '\\t' WHEN '0A' THEN '\\n' WHEN '0D' THEN '\\r' WHEN '22' THEN '\\"' WHEN '5C' THEN '\\\\'
 ELSE CASE WHEN h >= '20' AND h < '7F' THEN chr(('0x' || h)::INT) ELSE '\\x' || lower(h) END END), '') || '"' AS escaped FROM documents""",
    "",
)
def escape_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fmt.escaped(F.col("text")).alias("escaped"))


@query(
    f"SELECT pid, ring, count(*) FILTER (ts_ns > {MID}) AS n_unflushed, 2000 AS capacity, count(*) FILTER (ts_ns > {MID}) // 20 AS percent, CASE WHEN count(*) FILTER (ts_ns > {MID}) // 20 < 50 THEN 'green' WHEN count(*) FILTER (ts_ns > {MID}) // 20 < 80 THEN 'yellow' ELSE 'red' END AS band FROM r GROUP BY pid, ring",
)
def ring_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.records(spark, sf_dir).withColumn("ring", views.ring(F.col("severity")))
    flushed = r.groupBy("pid", "ring").agg(F.lit(MID).alias("flushed_ns"))
    return stats.ring_occupancy(r, flushed, ["pid", "ring"], F.lit(2000))


@query("SELECT pid, ts_ns // 60000000000 * 60 AS second, count(*) AS n FROM r GROUP BY ALL")
def records_per_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rates(views.records(spark, sf_dir), ["pid"], 60)


@query(
    """
c AS (SELECT day, ts_ns // 1000000000 AS second, count(*) AS n FROM r GROUP BY ALL),
s AS (SELECT day, second, n, row_number() OVER (PARTITION BY day ORDER BY second) AS i FROM c),
f AS (SELECT day, 0::BIGINT AS i, 0::BIGINT AS second, 0::BIGINT AS n, 0 AS level, (-1)::BIGINT AS until FROM s WHERE i = 1
 UNION ALL SELECT s.day, s.i, s.second, s.n, CASE WHEN s.n > 1 THEN least(level + 1, 6) WHEN level > 0 AND s.second > until THEN level - 1 ELSE level END, CASE WHEN s.n > 1 THEN s.second + 10 ELSE until END FROM f JOIN s ON s.day = f.day AND s.i = f.i + 1)
SELECT day, second, n, level FROM f WHERE i > 0""",
    f"RECURSIVE {RECORDS_SQL},",
)
def overload_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The severity level let through after each second of a day, when more than one record a second is too much."""
    return stats.shedding(stats.rates(views.records(spark, sf_dir), ["day"]), ["day"], 1)


@query("SELECT directory, path, size, kept_size FROM (SELECT *, sum(size) OVER (PARTITION BY directory ORDER BY file_time DESC, path DESC)::BIGINT AS kept_size FROM f) WHERE kept_size <= 20000", FILES_SQL)
def retention_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.files(spark, sf_dir).withColumn("file_time", fmt.file_time(F.col("path")))
    return stats.retained(files, ["directory"], 20_000).select("directory", "path", "size", "kept_size")


@query("SELECT directory, min_by(path, (file_time, path)) AS path FROM f GROUP BY directory", FILES_SQL)
def oldest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.oldest_file(views.files(spark, sf_dir).withColumn("file_time", fmt.file_time(F.col("path"))), ["directory"])


@query("SELECT directory, count(*) AS n_files, sum(CASE WHEN size % 64 = 0 THEN size // 64 ELSE 0 END)::BIGINT AS n_records FROM f GROUP BY directory", FILES_SQL)
def dir_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.directory_records(views.files(spark, sf_dir), ["directory"])


@query("SELECT event_id, pid, (row_number() OVER (PARTITION BY pid ORDER BY ts_ns, event_id) - 1) // 500 AS segment FROM r")
def rotation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.records(spark, sf_dir)
    part = F.call_function("div", F.col("ts_ns"), F.lit(buckets.width(r, "ts_ns")))
    return stats.segments(r, ["pid"], list(PLACE), part, 500).select("event_id", "pid", "segment")


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT DISTINCT event_type FROM events", "")
def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir)


@query("SELECT name FROM (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT DISTINCT event_type FROM events) WHERE starts_with(name, 'NATION_1')", "")
def complete_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir, "NATION_1")


def _names(spark: SparkSession, sf_dir: str, prefix: str = "") -> DataFrame:
    each = [table(spark, sf_dir, t).select(F.col(c).alias("text")) for t, c in (("nation", "n_name"), ("region", "r_name"), ("events", "event_type"))]
    texts = each[0].union(each[1]).union(each[2]).distinct()
    param = F.struct(F.lit(0x20).cast("bigint").alias("flags"), "text", F.lit(None).cast("string").alias("type_name"))
    return assemble.known_names(texts.select(F.lit(2).alias("kind"), F.array(param).alias("params")), prefix)


@query("SELECT DISTINCT 'events' AS file, event_type AS function FROM events", "")
def function_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = table(spark, sf_dir, "events").select("event_type").distinct()
    param = F.struct(F.lit(0x20).cast("bigint").alias("flags"), F.col("event_type").alias("text"), F.lit(None).cast("string").alias("type_name"))
    return assemble.functions_of(types.select(F.lit("events").alias("file"), F.lit(0).alias("kind"), F.array(param).alias("params")))


@query("SELECT DISTINCT pid, rpad(process_name, 20, ' ') || ' ' || CASE severity WHEN 1 THEN '-----' WHEN 2 THEN 'DEBUG' WHEN 3 THEN 'INFO ' WHEN 4 THEN 'WARN ' ELSE 'ERROR' END || ' [' || lpad(pid::VARCHAR, 5, ' ') || '] <020*>: --> ' || function || '(k = <long long>, value_cents = <long long>)' AS template FROM r")
def descriptor_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template of each descriptor, as entries of a function of two 64-bit numbers."""
    own = views.records(spark, sf_dir).select("pid", "process_name", "severity", "function").distinct()
    param = lambda flags, name, text: F.struct(F.lit(flags).cast("bigint").alias("flags"), name.cast("string").alias("param_name"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("type_name"))
    params = F.array(param(0x20, F.lit(None), F.col("function")), param(0x10008, F.lit("k"), F.lit(None)), param(0x10008, F.lit("value_cents"), F.lit(None)))
    return own.select("pid", fmt.template_text(F.col("process_name"), F.col("severity"), F.col("pid"), F.lit(0), params).alias("template"))


@query("SELECT event_id, (SELECT min_by(x.event_id, (x.ts_ns, x.event_id)) FROM r x WHERE x.tid = r.tid AND x.nesting = r.nesting - 1 AND (x.ts_ns, x.event_id) > (r.ts_ns, r.event_id)) AS leave FROM r")
def find_caller_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next record of the thread one level up: where its caller goes on."""
    r = views.records(spark, sf_dir)
    return navigate.caller(r, PLACE, "leave", buckets.width(r, "ts_ns"), forward=True).select("event_id", "leave")


@query(
    """
c AS (SELECT day, ts_ns // 1000000000 AS second, count(*) AS n FROM r GROUP BY ALL),
s AS (SELECT day, second, n, row_number() OVER (PARTITION BY day ORDER BY second) AS i FROM c),
f AS (SELECT day, 0::BIGINT AS i, 0::BIGINT AS second, 0 AS before, 0 AS level, (-1)::BIGINT AS until FROM s WHERE i = 1
 UNION ALL SELECT s.day, s.i, s.second, level, CASE WHEN s.n > 1 THEN least(level + 1, 6) WHEN level > 0 AND s.second > until THEN level - 1 ELSE level END, CASE WHEN s.n > 1 THEN s.second + 10 ELSE until END FROM f JOIN s ON s.day = f.day AND s.i = f.i + 1)
SELECT event_id, ts_ns, pid, severity FROM r JOIN f ON r.day = f.day AND f.i > 0 AND ts_ns // 1000000000 = second
WHERE (CASE ring WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 4 END) > before""",
    f"RECURSIVE {RECORDS_SQL},",
)
def overload_shed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records let through while more than one record a second raises the level."""
    r = views.records(spark, sf_dir)
    levels = stats.shedding(stats.rates(r, ["day"]), ["day"], 1)
    ring = views.ring(F.col("severity"))
    mask = F.when(ring == 0, 1 << 1).when(ring == 1, 1 << 2).otherwise(sum(1 << n for n in (3, 4, 5, 6)))
    return stats.shed(r, levels, ["day"], mask).select("event_id", "ts_ns", "pid", "severity")


_CELL = "least(greatest(place - 1, 0) // 33, 58)"


@query(
    f"SELECT pid, string_agg(CASE WHEN full_ THEN '#' ELSE '_' END, '' ORDER BY cell) AS bar FROM (SELECT pid, cell, coalesce(bool_or(c = cell), FALSE) AS full_ FROM (SELECT pid, {_CELL} AS c FROM (SELECT pid, ts_ns, row_number() OVER (PARTITION BY pid ORDER BY ts_ns, event_id) AS place FROM r) WHERE ts_ns > {MID}), (SELECT unnest(range(59)) AS cell) GROUP BY pid, cell) GROUP BY pid",
)
def ring_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the unflushed slots of each process's ring of 2,000 lie."""
    r = views.records(spark, sf_dir)
    part = F.call_function("div", F.col("ts_ns"), F.lit(buckets.width(r, "ts_ns")))
    placed = buckets.numbered(r.select("pid", "ts_ns", "event_id"), ["pid"], list(PLACE), part, "place")
    return stats.occupancy_bar(placed.where(F.col("ts_ns") > MID), ["pid"], "place", 2000)


@query("SELECT event_id, ts_ns::VARCHAR AS raw, '' AS hidden, strftime(make_timestamp(ts_ns // 1000), '%d/%m %H:%M:%S') AS compact FROM r")
def format_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.records(spark, sf_dir)
    return r.select("event_id", *[fmt.timestamp_text(F.col("ts_ns"), style).alias(style) for style in ("raw", "hidden", "compact")])


@query(
    "SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 3 WHEN 'Brand#2' THEN 4 WHEN 'Brand#3' THEN 5 ELSE 0 END AS severity FROM part",
    "",
)
def parse_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severities by name; other names are invalid."""
    brand = F.col("p_brand")
    name = F.when(brand == "Brand#1", "INFO").when(brand == "Brand#2", "WARN").when(brand == "Brand#3", "ERROR").otherwise(brand)
    return table(spark, sf_dir, "part").select("p_partkey", fmt.severity_value(name).alias("severity"))


_PLAIN_SQL = "CASE severity WHEN 1 THEN '-----' WHEN 2 THEN 'DEBUG' WHEN 3 THEN 'INFO ' WHEN 4 THEN 'WARN ' ELSE 'ERROR' END"
_COLOUR_SQL = "CASE severity WHEN 1 THEN '90' WHEN 2 THEN '37' WHEN 3 THEN '1;32' WHEN 4 THEN '1;33' ELSE '1;31' END"


@query(f"SELECT event_id, {_COLOUR_SQL} AS codes, {_PLAIN_SQL} AS label, {_PLAIN_SQL} || ' ' || rpad(process_name, 20, ' ') || '  [' || lpad(tid::VARCHAR, 5, ' ') || '] : ' || function AS line FROM r")
def coloured_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coloured lines as runs of colours (the first one is the severity's), and without them."""
    line = fmt.line_text(F.col("function"), fmt.FormatOptions(times="hidden", colour=True))
    r = views.records(spark, sf_dir).withColumn("coloured", line)
    runs = fmt.colour_runs(F.col("coloured"))
    return r.select("event_id", runs[0]["codes"].alias("codes"), runs[0]["text"].alias("label"), fmt.without_colours(F.col("coloured")).alias("line"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN (o_custkey % 1000)::INT END AS pid FROM orders", "")
def buffer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process ids in names of buffers; names of another form have none."""
    o = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("ring_"), (F.col("o_custkey") % 1000).cast("string"), F.lit("_dynamic"))).otherwise(F.concat(F.lit("other_"), F.col("o_custkey").cast("string")))
    return o.select("o_orderkey", fmt.buffer_pid(name, "ring_").alias("pid"))


@query("SELECT l_orderkey, l_linenumber, (l_partkey * 2147483 - l_suppkey * 3000017 + 17592186044416) % 4294967296 BETWEEN 1 AND 2147483647 AS newer FROM lineitem", "")
def generation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two 32-bit lap counters is the later one, across their wrap."""
    a, b = F.pmod(F.col("l_partkey") * 2147483, F.lit(1 << 32)), F.pmod(F.col("l_suppkey") * 3000017, F.lit(1 << 32))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fmt.newer_generation(a, b).alias("newer"))


@query(
    "SELECT p_partkey, lpad(printf('%x', p_size), 16, '0') AS padded, p_size::VARCHAR AS unsigned, '0x' || printf('%x', p_size) AS hexed, printf('%.6f', p_retailprice) AS number FROM part",
    "",
)
def number_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers padded with zeros, unsigned, in hexadecimal, and doubles."""
    p = table(spark, sf_dir, "part")

    def value(flags: int, kind: str, d=None):
        n = F.col("p_size").cast("bigint")
        return F.struct(F.lit(kind).alias("kind"), F.lit(flags).cast("bigint").alias("flags"), n.alias("i"), n.cast("decimal(20,0)").alias("u"), (F.lit(None) if d is None else d).cast("double").alias("d"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("binary").alias("b"))

    shown = {"padded": value(0x408, "int"), "unsigned": value(0x108, "int"), "hexed": value(0x208, "int"), "number": value(0x40000, "double", F.col("p_retailprice"))}
    return p.select("p_partkey", *[fmt.value_text(v).alias(name) for name, v in shown.items()])


@query(f"SELECT {SHOWN} FROM r WHERE ts_ns > 1706054400000000007 AND ts_ns < 1706097600000000500 ORDER BY ts_ns, event_id")
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records between an absolute time and a partial one, whose larger fields are the first one's."""
    first = fmt.absolute_ns("Wed Jan 24 00:00:00 2024:7")
    last = fmt.partial_ns("12:00:00:500", first)
    return _shown(m.where(views.records(spark, sf_dir, first, last), m.time_between(first, last)))


@query("SELECT directory, sum(size)::BIGINT * 25 // 100 // 64 AS n_records, least(sum(size)::BIGINT * 25 // 100 // 64 // 7, 268435456) AS per_file, count(*) AS n_files FROM f GROUP BY directory", FILES_SQL)
def quota_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that a quota of a quarter of the used bytes allows each directory, and each of seven files in it."""
    used = views.files(spark, sf_dir).groupBy("directory").agg(F.sum("size").alias("used"), F.count("*").alias("n_files"))
    allowed = F.call_function("div", F.call_function("div", F.col("used") * 25, F.lit(100)), F.lit(64))
    return used.select("directory", allowed.alias("n_records"), fmt.file_cap(allowed).alias("per_file"), "n_files")
