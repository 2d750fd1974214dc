"""The driver's tables as records: ``events`` as log records, ``conversations`` as fragments, ``orders`` as files."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recscope.functions import formatting as fmt
from recscope.schema import FIRST, LAST

#: The types of events, whose place is their descriptor's number.
TYPES = ("click", "error", "purchase", "signup", "view")
#: Severities by type of event, and ring classes (function calls, debug, others) by severity.
SEVERITY_OF = {"click": 1, "view": 2, "signup": 3, "purchase": 4, "error": 5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ns(ts):
    """Nanoseconds of a time without zone, read as UTC."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def _numbered(key, names):
    out = F
    for k, n in names.items():
        out = out.when(key == k, F.lit(n))
    return out


def records(spark: SparkSession, sf_dir: str, after_ns: int | None = None, before_ns: int | None = None) -> DataFrame:
    """``events`` as records; bounds (inclusive) that a query's own condition on ``ts_ns`` implies reach the scan."""
    e = table(spark, sf_dir, "events")
    for bound, within in ((after_ns, F.col("ts").__ge__), (before_ns, F.col("ts").__le__)):
        if bound is not None:
            e = e.where(within(F.lit(datetime.fromtimestamp(bound // fmt.SECOND, UTC).replace(tzinfo=None) + timedelta(microseconds=bound % fmt.SECOND // 1000)).cast("timestamp_ntz")))
    k = F.get_json_object("props", "$.k").cast("bigint")
    own = e.select(
        "event_id",
        epoch_ns(F.col("ts")).alias("ts_ns"),
        (F.col("user_id") % 8).cast("int").alias("pid"),
        F.col("user_id").alias("tid"),
        _numbered(F.col("event_type"), SEVERITY_OF).alias("severity"),
        _numbered(F.col("event_type"), {t: i for i, t in enumerate(TYPES)}).cast("bigint").alias("log_id"),
        F.col("event_type").alias("function"),
        k.alias("k"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )
    # Values are only made where a query asks for them: Spark prunes the others.
    number = lambda name, c: F.struct(F.lit(name).alias("name"), F.lit("int").alias("kind"), F.lit(0x8).cast("bigint").alias("flags"), F.lit(0).alias("depth"), c.alias("i"), c.cast("decimal(20,0)").alias("u"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("binary").alias("b"))
    head = F.struct(F.lit(None).cast("string").alias("name"), F.lit("cstr").alias("kind"), F.lit(0x20).cast("bigint").alias("flags"), F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("decimal(20,0)").alias("u"), F.lit(None).cast("double").alias("d"), F.col("function").alias("s"), F.lit(None).cast("binary").alias("b"))
    return own.withColumns(
        {
            "nesting": (F.col("k") % 5).cast("int"),
            "kind": F.when(F.col("k") % 3 == 0, 0).when(F.col("k") % 3 == 1, 1).otherwise(2),
            "process_name": F.concat(F.lit("proc_"), F.col("pid").cast("string")),
            "values": F.array(head, number("k", F.col("k")), number("value_cents", F.col("cents"))),
            "type_names": F.array(F.concat(F.lit("type_"), F.col("function"))),
            "const_strs": F.array(F.col("function")),
            "day": F.call_function("div", F.col("ts_ns"), F.lit(86_400 * fmt.SECOND)),
        }
    )


def ring(severity):
    """0: function calls, 1: debug, 2: all others."""
    return F.when(severity == 1, 0).when(severity == 2, 1).otherwise(2)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each day, process and ring: its flush time and the severities in it."""
    r = records(spark, sf_dir)
    made = r.groupBy(F.col("day").alias("dump_pos"), "pid", "process_name", ring(F.col("severity")).alias("ring")).agg(F.max("ts_ns").alias("flush_ts_ns"), F.count("*").alias("n_records"), F.bit_or(F.expr("shiftleft(1, severity)")).alias("severity_mask"))
    return made.withColumn("chunk_idx", F.col("pid") * 3 + F.col("ring"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as fragments: the first turn of each is FIRST, the last one LAST."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("payload"))
    ends = c.groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"))
    bits = F.when(F.col("turn") == F.col("a"), FIRST).otherwise(0) + F.when(F.col("turn") == F.col("b"), LAST).otherwise(0)
    return c.join(ends, "conv_id").select("conv_id", "turn", bits.alias("termination"), "payload")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of orders as files of a directory for each status: size and time by the month's orders."""
    o = table(spark, sf_dir, "orders")
    month = F.date_format("o_orderdate", "yyyyMM")
    size = F.sum(F.when(F.col("o_orderkey") % 97 == 0, F.lit(63)).otherwise(F.lit(64))).cast("bigint")
    made = o.groupBy(F.col("o_orderstatus").alias("directory"), month.alias("month")).agg(size.alias("size"))
    return made.select("directory", F.concat(F.lit("/logs/"), "directory", F.lit("/trace."), "month", F.lit(".dump")).alias("path"), "size")


#: The same views as DuckDB SQL, to be put in front of a query.
RECORDS_SQL = """
r0 AS (SELECT event_id, epoch_us(ts) * 1000 AS ts_ns, (user_id % 8)::INT AS pid, user_id AS tid,
  CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 WHEN 'error' THEN 5 END AS severity,
  (CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END)::BIGINT AS log_id,
  event_type AS function, json_extract_string(props, '$.k')::BIGINT AS k, round(value * 100)::BIGINT AS cents FROM events),
r AS (SELECT *, (k % 5)::INT AS nesting, CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS kind, 'proc_' || pid AS process_name,
  ts_ns // 86400000000000 AS day, CASE severity WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS ring FROM r0)"""
CHUNKS_SQL = """
c AS (SELECT day AS dump_pos, pid, process_name, ring, max(ts_ns) AS flush_ts_ns, count(*) AS n_records, bit_or(1 << severity) AS severity_mask, pid * 3 + ring AS chunk_idx
  FROM r GROUP BY day, pid, process_name, ring)"""
FILES_SQL = """
f AS (SELECT o_orderstatus AS directory, '/logs/' || o_orderstatus || '/trace.' || strftime(o_orderdate, '%Y%m') || '.dump' AS path,
  sum(CASE WHEN o_orderkey % 97 = 0 THEN 63 ELSE 64 END)::BIGINT AS size, strftime(o_orderdate, '%Y%m')::BIGINT AS file_time FROM orders GROUP BY ALL)"""
