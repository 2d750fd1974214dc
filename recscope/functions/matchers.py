"""Matchers: what a record must be, as Columns that combine with ``&``, ``|`` and ``~``.

A matcher holds one predicate for records and two for chunks (runs of records of one process and one severity class, of which
only the header has been read): ``may`` is true if the chunk can hold a matching record, ``must`` if all of its records
match. Negation swaps the two, so pruning by chunk headers never loses a record, whatever is negated.

In the same way ``log_may`` and ``log_must`` say of a descriptor (kind, function, constant texts, type names, number) whether any or all of its records can
match: records of other descriptors are dropped before their values are decoded.

``limits`` are what all slots of a matching record keep, by columns that they share: they reach the scan of a journal.

Predicates are two-valued: a comparison with null is no match, and its negation is one. A record without a known
descriptor matches nothing; records are inner-joined with their descriptors before.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recscope.schema import DEFAULT_SEVERITIES, KINDS, SEVERITIES, severity_number

EVERY = (True,) * len(SEVERITIES)


@dataclass(frozen=True)
class Limit:
    """A column of slots lies within bounds (inclusive), or among values."""

    column: str
    low: int | None = None
    high: int | None = None
    among: tuple[int, ...] | None = None


@dataclass(frozen=True)
class Matcher:
    """``levels``: for each severity, whether a record of it can match as far as severity alone decides."""

    record: Column
    may: Column
    must: Column
    levels: tuple[bool, ...] = EVERY
    limits: tuple[Limit, ...] = ()
    log_may: Column | None = None
    log_must: Column | None = None

    def of_logs(self) -> tuple[Column, Column]:
        """(may, must) of a descriptor; where nothing is known, any record can match and none must."""
        return (F.lit(True) if self.log_may is None else self.log_may), (F.lit(False) if self.log_must is None else self.log_must)

    def __and__(self, other: Matcher) -> Matcher:
        return Matcher(self.record & other.record, self.may & other.may, self.must & other.must, tuple(map(and_, self.levels, other.levels)), self.limits + other.limits, *map(and_, self.of_logs(), other.of_logs()))

    def __or__(self, other: Matcher) -> Matcher:
        return Matcher(self.record | other.record, self.may | other.may, self.must | other.must, tuple(map(or_, self.levels, other.levels)), (), *map(or_, self.of_logs(), other.of_logs()))

    def __invert__(self) -> Matcher:
        # Of a matcher that does not look at severities the negation does not either.
        may, must = self.of_logs()
        return Matcher(~self.record, ~self.must, ~self.may, self.levels if self.levels == EVERY else tuple(not x for x in self.levels), (), ~must, ~may)

    def shows_calls(self) -> bool:
        """Whether function calls can match: bodies are then indented by nesting."""
        return self.levels[SEVERITIES["FUNC_TRACE"]]


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _leaf(condition: Column) -> Matcher:
    """A matcher that chunk headers say nothing about."""
    return Matcher(_sure(condition), F.lit(True), F.lit(False))


def _of_descriptor(condition: Column) -> Matcher:
    """A matcher that a record's descriptor decides."""
    sure = _sure(condition)
    return Matcher(sure, F.lit(True), F.lit(False), log_may=sure, log_must=sure)


def anything() -> Matcher:
    return Matcher(F.lit(True), F.lit(True), F.lit(True), log_may=F.lit(True), log_must=F.lit(True))


def nothing() -> Matcher:
    return replace(~anything(), limits=(Limit("rec_type", among=()),))


def all_of(matchers: Iterable[Matcher]) -> Matcher:
    return reduce(and_, matchers, anything())


def any_of(matchers: Iterable[Matcher]) -> Matcher:
    found = list(matchers)
    return reduce(or_, found) if found else nothing()


def pid(n: int) -> Matcher:
    same = _sure(F.col("pid") == n)
    return Matcher(same, same, same, limits=(Limit("pid", among=(n,)),))


def tid(n: int) -> Matcher:
    return _leaf(F.col("tid") == n)


def nesting(n: int) -> Matcher:
    return _leaf(F.col("nesting") == n)


def log_id(n: int) -> Matcher:
    return _of_descriptor(F.col("log_id") == n)


def severity(which: str | int) -> Matcher:
    """Exactly this severity, not this one or worse."""
    n = severity_number(which)
    mask = F.col("severity_mask")
    levels = tuple(k == n for k in range(len(SEVERITIES)))
    return Matcher(_sure(F.col("severity") == n), _sure(mask.bitwiseAND(F.lit(1 << n)) != 0), _sure(mask == 1 << n), levels, (Limit("severity", among=(n,)),))


def severities(which: Iterable[str | int] = DEFAULT_SEVERITIES) -> Matcher:
    """Any of these severities; none named matches everything, like an empty mask."""
    numbers = sorted({severity_number(w) for w in which})
    if not numbers:
        return anything()
    bits = sum(1 << n for n in numbers)
    mask = F.col("severity_mask")
    among = _sure(F.col("severity").isin(numbers))
    return Matcher(among, _sure(mask.bitwiseAND(F.lit(bits)) != 0), _sure(mask.bitwiseAND(F.lit(~bits)) == 0), tuple(k in numbers for k in range(len(SEVERITIES))), (Limit("severity", among=tuple(numbers)),))


def time_between(after: int, before: int) -> Matcher:
    """Nanoseconds, both ends open. A chunk's time is that of its flush, so all of its records are older."""
    within = _sure((F.col("ts_ns") > after) & (F.col("ts_ns") < before))
    return Matcher(within, _sure(F.col("flush_ts_ns") > after), F.lit(False), limits=(Limit("ts_ns", after + 1, before - 1),))


def process_name(name: str) -> Matcher:
    same = _sure(F.col("process_name") == name)
    return Matcher(same, same, same)


def type_name(name: str) -> Matcher:
    """A top-level parameter of this type."""
    return _of_descriptor(F.array_contains("type_names", name))


def function(name: str) -> Matcher:
    """Entry to or return from this function."""
    return _of_descriptor(F.col("kind").isin(KINDS["FUNC_ENTRY"], KINDS["FUNC_LEAVE"]) & (F.col("function") == name))


def const_substring(text: str) -> Matcher:
    """A constant text of the descriptor contains ``text``, upper and lower case apart; no wildcards."""
    return _of_descriptor(F.exists("const_strs", lambda c: c.contains(text)))


def any_param(value: int | str) -> Matcher:
    """A number or enumerator anywhere in the record equals ``value``; a text names an enumerator."""
    return _leaf(F.exists("values", lambda v: _equals(v, value)))


def named_param(name: str, value: int | str) -> Matcher:
    return _leaf(F.exists("values", lambda v: (v["name"] == name) & _equals(v, value)))


def _equals(v: Column, value: int | str) -> Column:
    # Zero-extended, so a negative number matches no narrow parameter.
    return _sure((v["kind"] == "enum") & (v["s"] == value)) if isinstance(value, str) else _sure(v["u"] == F.lit(Decimal(value)).cast("decimal(38,0)"))


def params(*values: int | str, **named: int | str) -> Matcher:
    """All of these parameter values, by position-free value or by name."""
    return all_of([*map(any_param, values), *(named_param(k, v) for k, v in named.items())])


def call(name: str, *values: int | str, **named: int | str) -> Matcher:
    """A traced call of a function with these parameter values."""
    return function(name) & severity("FUNC_TRACE") & params(*values, **named)


def grep(text: str, which: Iterable[str | int] = DEFAULT_SEVERITIES) -> Matcher:
    return const_substring(text) & severities(which)


def where(records: DataFrame, matcher: Matcher) -> DataFrame:
    return records.where(matcher.record)


def online_severities(*, debug: bool = False, info: bool = False, warn: bool = False, error: bool = False) -> tuple[str, ...]:
    """What a live view shows: the switched-on severities (``error`` brings FATAL), or INFO and worse."""
    chosen = [n for n, on in (("DEBUG", debug), ("INFO", info), ("WARN", warn), ("ERROR", error), ("FATAL", error)) if on]
    return tuple(chosen) or DEFAULT_SEVERITIES
