"""How records are written: Columns for times, severities, values, bodies and whole lines.

All functions work in the JVM on Spark's own functions. Times are UTC (``spark.sql.session.timeZone`` is expected to be
UTC). Null inputs give null texts, but for bodies, where a missing value is written as ``<?>``.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from recscope.schema import FLAGS, KINDS, SEVERITIES

# Severities as lines show them, and colours as terminals read them.
LABELS = {0: "-----", 1: "-----", 2: "DEBUG", 3: "INFO ", 4: "WARN ", 5: "ERROR", 6: "FATAL"}
COLOURS = {0: "90", 1: "90", 2: "37", 3: "1;32", 4: "1;33", 5: "1;31", 6: "1;31"}
ESCAPES = {9: "\\t", 10: "\\n", 13: "\\r", 34: '\\"', 92: "\\\\"}
PARTIAL_TIMES = ("%d/%m", "%H:%M", "%H:%M:%S", "%H:%M:%S:%f", ":%f", "%d/%m %H:%M:%S:%f")
RESET = "\x1b[0m"
SECOND = 1_000_000_000


@dataclass(frozen=True)
class FormatOptions:
    """``times``: full, compact, raw or hidden."""

    times: str = "full"
    compact: bool = False
    colour: bool = False
    always_hex: bool = False
    field_names: bool = False
    indent: bool = False


def _choice(key: Column, table: dict[int, str], other: str) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(other))


def _coloured(text: Column, code: Column | str) -> Column:
    return F.concat(F.lit("\x1b["), F.lit(code) if isinstance(code, str) else code, F.lit("m"), text, F.lit(RESET))


def severity_label(severity: Column) -> Column:
    return _choice(severity, LABELS, "???")


def severity_value(name: Column) -> Column:
    """The number of a severity's name; 0 (INVALID) for others."""
    out = F
    for k, v in SEVERITIES.items():
        out = out.when(name == k, F.lit(v))
    return out.otherwise(F.lit(0))


def severity_mask_text(mask: Column) -> Column:
    """Names of the severities whose bits are set, ascending, joined by a comma and a space."""
    return F.concat_ws(", ", *[F.when(mask.bitwiseAND(F.lit(1 << n)) != 0, F.lit(name)) for name, n in SEVERITIES.items() if n])


def least_severity(mask: Column) -> Column:
    """One more than the least severity of a mask: shedding compares with this, so it begins to act at level 2. Null: no bit."""
    out = F
    for n in range(32):
        out = out.when(mask.bitwiseAND(F.lit(1 << n)) != 0, F.lit(n + 1))
    return out


def indentation(nesting: Column) -> Column:
    return F.repeat(F.lit("    "), F.greatest(nesting.cast("int"), F.lit(0)))


def timestamp_text(ts_ns: Column, style: str = "full") -> Column:
    """``full``: as ctime has it, then the nanoseconds padded to ten places; ``compact``: day/month and time; ``raw``; ``hidden``."""
    if style == "hidden":
        return F.lit("")
    if style == "raw":
        return ts_ns.cast("string")
    if style not in ("full", "compact"):
        raise ValueError(f"unknown style of times {style!r}")
    ts = F.timestamp_seconds(F.call_function("div", ts_ns - F.pmod(ts_ns, F.lit(SECOND)), F.lit(SECOND)))
    if style == "compact":
        return F.date_format(ts, "dd/MM HH:mm:ss")
    day = F.lpad(F.dayofmonth(ts).cast("string"), 2, " ")
    return F.concat(F.date_format(ts, "EEE MMM "), day, F.date_format(ts, " HH:mm:ss yyyy"), F.lit(":"), F.rpad(F.pmod(ts_ns, F.lit(SECOND)).cast("string"), 10, " "))


def hex_float(x: Column) -> Column:
    """A double as C writes it in hexadecimal."""
    java = F.reflect(F.lit("java.lang.Double"), F.lit("toHexString"), x)
    return F.regexp_replace(F.regexp_replace(java, r"\.0p", "p"), r"p(?=\d)", "p+")


def escaped(text: Column) -> Column:
    """A quoted text; bytes that aren't printable ASCII are written as \\xNN, but for tab, newline, return, quote and backslash."""
    data = (text if isinstance(text, Column) else F.col(text)).cast("string")
    named = F.replace(data, F.lit("\\"), F.lit("\\\\"))
    for code, shown in ESCAPES.items():
        if code != 92:
            named = F.replace(named, F.lit(chr(code)), F.lit(shown))
    # Runs of other characters, told apart from printable ones, are written byte by byte.
    runs = F.split(named, "(?<=[ -~])(?=[^ -~])|(?<=[^ -~])(?=[ -~])")
    coded = F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[^ -~]"), F.regexp_replace(F.lower(F.hex(F.encode(r, "UTF-8"))), "(..)", r"\\x$1")).otherwise(r)), "")
    body = F.when(named.rlike("[^ -~]"), coded).otherwise(named)
    return F.concat(F.lit('"'), body, F.lit('"'))


def _has(flags: Column, *names: str) -> Column:
    return flags.bitwiseAND(F.lit(sum(FLAGS[n] for n in names))) != 0


def value_text(v: Column, always_hex: bool = False) -> Column:
    """One decoded value: number, double, enumerator, text or bytes."""
    as_hex = F.lit(True) if always_hex else _has(v["flags"], "HEX")
    width = F.when(_has(v["flags"], "NUM_64"), F.lit(16)).otherwise(F.lit(8))
    hexed = F.lower(F.conv(v["u"].cast("string"), 10, 16))
    number = (
        F.when(as_hex, F.concat(F.lit("0x"), hexed))
        .when(_has(v["flags"], "UNSIGNED"), v["u"].cast("string"))
        .when(_has(v["flags"], "ZERO"), F.lpad(hexed, F.greatest(width, F.length(hexed)), "0"))
        .otherwise(v["i"].cast("string"))
    )
    double = F.when(as_hex, hex_float(v["d"])).otherwise(F.format_string("%.6f", v["d"]))
    return (
        F.when(v["kind"] == "cstr", v["s"])
        .when(v["kind"] == "enum", F.coalesce(v["s"], F.lit("<? enum>")))
        .when(v["kind"] == "double", double)
        .when(v["kind"] == "str", escaped(v["s"]))
        .when(v["kind"] == "bytes", F.lower(F.hex(v["b"])))
        .when(v["kind"] == "nested", F.lit("{ "))
        .when(v["kind"] == "unknown_log", F.concat(F.lit("L? "), v["u"].cast("string")))
        .otherwise(F.coalesce(number, F.lit("<?>")))
    )


def body_text(kind: Column, values: Column, options: FormatOptions = FormatOptions()) -> Column:
    """``--> f(a = 1, b = 2)``, ``<-- f(0)``, or values joined by blanks; nested logs in braces.

    The first value of a call is the function's name, a constant text.
    """
    entry, leave = kind == KINDS["FUNC_ENTRY"], kind == KINDS["FUNC_LEAVE"]
    is_call = entry | leave
    named = entry | F.lit(options.field_names)

    def piece(v: Column, k: Column) -> Column:
        name = F.when((v["name"].isNotNull()) & named, F.concat(v["name"], F.lit(" = "))).otherwise(F.lit(""))
        head = is_call & (k == 0) & (v["kind"] == "cstr")
        text = F.when(head, F.concat(v["s"], F.lit("("))).otherwise(value_text(v, options.always_hex))
        return F.struct(v["depth"].alias("depth"), F.concat(name, text).alias("text"), (head | (v["kind"] == "nested")).alias("opens"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("depth"), F.lit(True).alias("fresh"))

    def step(so_far: Column, p: Column) -> Column:
        closing = F.repeat(F.lit(" }"), F.greatest(so_far["depth"] - p["depth"], F.lit(0)))
        between = F.when(so_far["fresh"], F.lit("")).when((p["depth"] == 0) & entry, F.lit(", ")).otherwise(F.lit(" "))
        return F.struct(F.concat(so_far["text"], closing, between, p["text"]).alias("text"), p["depth"].alias("depth"), p["opens"].alias("fresh"))

    done = F.aggregate(F.transform(values, piece), start, step, lambda x: F.concat(x["text"], F.repeat(F.lit(" }"), x["depth"])))
    return F.concat(F.when(entry, F.lit("--> ")).when(leave, F.lit("<-- ")).otherwise(F.lit("")), done, F.when(is_call, F.lit(")")).otherwise(F.lit("")))


def line_text(body: Column, options: FormatOptions = FormatOptions()) -> Column:
    """A whole line: severity, process, time, thread and body. Records of an unknown process show ``<?>``."""
    times = timestamp_text(F.col("ts_ns"), "compact" if options.compact and options.times == "full" else options.times)
    label = severity_label(F.col("severity"))
    process = F.format_string("%-20s", F.coalesce(F.col("process_name"), F.lit("<? unknown ?>")))
    who = F.format_string("%5d:%5d", "pid", "tid") if options.compact else F.format_string("%5d", "tid")
    if options.colour:
        label = _coloured(label, _choice(F.col("severity"), COLOURS, "0"))
        process, who = _coloured(process, "35"), _coloured(who, "1;34")
    head = F.concat(label, F.lit(" "), *([] if options.compact else [process, F.lit(" ")]), times, F.lit(" ["), who, F.lit("] : "))
    indent = indentation(F.col("nesting")) if options.indent else F.lit("")
    return F.concat(head, indent, F.coalesce(body, F.lit("<?>")))


def without_colours(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*m", "")


def colour_runs(text: Column) -> Column:
    """Pieces of a coloured text as (codes, text); codes are empty before the first escape."""
    pieces = F.regexp_extract_all(text, F.lit("((?:\x1b\\[[0-9;]*m)?[^\x1b]*)"), 1)
    parts = F.transform(pieces, lambda p: F.struct(F.regexp_extract(p, "^\x1b\\[([0-9;]*)m", 1).alias("codes"), F.regexp_replace(p, "^\x1b\\[[0-9;]*m", "").alias("text")))
    return F.filter(parts, lambda p: p["text"] != "")


def min_wire_size(params: Column) -> Column:
    """(size, exact) of a descriptor's records: fixed sizes and 4 for its number. A nested log starts the sum anew; doubles count nothing."""
    start = F.struct(F.lit(4).alias("size"), F.lit(True).alias("exact"))

    def step(so_far: Column, p: Column) -> Column:
        f = p["flags"]
        size = so_far["size"]
        fixed = F.when(_has(f, "ENUM"), F.lit(4)).when(_has(f, "NUM_8"), F.lit(1)).when(_has(f, "NUM_16"), F.lit(2)).when(_has(f, "NUM_32"), F.lit(4)).when(_has(f, "NUM_64"), F.lit(8)).otherwise(F.lit(0))
        nested, array = _has(f, "NESTED_LOG"), _has(f, "VARRAY")
        return F.struct(F.when(nested, F.lit(4)).when(array, size + 1).otherwise(size + fixed).alias("size"), (so_far["exact"] & ~nested & ~array).alias("exact"))

    return F.aggregate(params, start, step)


def template_text(process: Column, severity: Column, pid: Column, kind: Column, params: Column) -> Column:
    """What a descriptor's records look like, with placeholders for values: made once for each descriptor."""
    entry, leave = kind == KINDS["FUNC_ENTRY"], kind == KINDS["FUNC_LEAVE"]
    is_call = entry | leave

    def piece(p: Column, k: Column) -> Column:
        f = p["flags"]
        kind_of = F.coalesce(p["type_name"], F.lit("?"))
        shown = (
            F.when(_has(f, "NESTED_LOG"), F.concat(F.lit("{<"), kind_of, F.lit(">}")))
            .when(_has(f, "CSTR"), F.concat(F.coalesce(p["text"], F.lit("<cstr?>")), F.when(is_call & (k == 0), F.lit("(")).otherwise(F.lit(""))))
            .when(_has(f, "VARRAY"), F.lit("<vstr>"))
            .when(_has(f, "ENUM"), F.concat(F.lit("<"), kind_of, F.lit(">")))
            .when(_has(f, "NUM_8"), F.lit("<char>"))
            .when(_has(f, "NUM_16"), F.lit("<short>"))
            .when(_has(f, "NUM_32"), F.lit("<int>"))
            .when(_has(f, "NUM_64"), F.lit("<long long>"))
            .when(_has(f, "DOUBLE"), F.lit("<double>"))
            .otherwise(F.lit(""))
        )
        name = F.when(_has(f, "NAMED_PARAM") & entry, F.concat(p["param_name"], F.lit(" = "))).otherwise(F.lit(""))
        return F.concat(F.when(k <= F.when(is_call, 1).otherwise(0), F.lit("")).when(entry, F.lit(", ")).otherwise(F.lit(" ")), name, shown)

    body = F.concat(F.when(entry, F.lit("--> ")).when(leave, F.lit("<-- ")).otherwise(F.lit("")), F.array_join(F.transform(params, piece), ""), F.when(is_call, F.lit(")")).otherwise(F.lit("")))
    size = min_wire_size(params)
    exact = F.when(size["exact"], F.lit("*")).otherwise(F.lit(" "))
    return F.concat(F.format_string("%-20s %s [%5d] <%03d", process, severity_label(severity), pid, size["size"]), exact, F.lit(">: "), body)


def file_time(path: Column) -> Column:
    """The number between ``trace.`` and the next dot of a file's name; null if there is none."""
    found = F.regexp_extract(path, r"(?:^|/)trace\.(\d+)\.[^/]*$", 1)
    return F.when(found != "", found.cast("bigint"))


def buffer_pid(name: Column, prefix: str) -> Column:
    """The process id in a buffer's name, between ``prefix`` and the next underscore; null for other names."""
    found = F.regexp_extract(name, f"^{prefix}(\\d+)_", 1)
    return F.when(found != "", found.cast("int"))


def newer_generation(a: Column, b: Column) -> Column:
    """Whether a 32-bit lap counter is after another one, across its wrap."""
    ahead = F.pmod(a - b, F.lit(1 << 32))
    return (ahead > 0) & (ahead < (1 << 31))


def absolute_ns(text: str) -> int:
    """Nanoseconds of a time such as ``Mon Jan  5 10:00:00 2026:123``, in UTC."""
    head, tail = (text, "") if text.count(":") == 2 else text.rsplit(":", 1)
    at = datetime.strptime(" ".join(head.split()), "%a %b %d %H:%M:%S %Y").replace(tzinfo=UTC)
    return int(at.timestamp()) * SECOND + int(tail.strip() or 0)


def partial_ns(text: str, last_ns: int) -> int:
    """Nanoseconds of a time in which only some fields are given; larger fields are those of ``last_ns``, smaller ones zero."""
    last = datetime.fromtimestamp(last_ns // SECOND, UTC)
    for form in PARTIAL_TIMES:
        head, _, fraction = text.rpartition(":") if form.endswith(":%f") else (text, "", "0")
        try:
            given = datetime.strptime(head, form.removesuffix(":%f")) if form != ":%f" else None
            nanos = int(fraction)
        except ValueError:
            continue
        if form == ":%f":
            if head:
                continue
            return int(last.timestamp()) * SECOND + nanos
        at = last.replace(microsecond=0)
        at = at.replace(month=given.month, day=given.day) if "%d" in form else at
        at = at.replace(hour=given.hour, minute=given.minute, second=given.second)
        return int(at.timestamp()) * SECOND + nanos
    raise ValueError(f"not a time: {text!r}")


def quota_records(text: str, free_bytes: int, used_bytes: int) -> int:
    """Records that a quota allows: ``%N`` is a share of free and used bytes, a number is bytes."""
    size = (free_bytes + used_bytes) * int(text[1:]) // 100 if text.startswith("%") else int(text)
    return size // 64


def file_cap(quota: Column, files: int = 7, cap: int = 268_435_456) -> Column:
    """Records of one file at most: an even share of a directory's quota, or the format's own cap where that is less."""
    return F.least(F.call_function("div", quota, F.lit(files)), F.lit(cap))
