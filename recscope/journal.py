"""A journal opened for reading: the reader's verbs over one set of files, each a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recscope.functions import formatting as fmt
from recscope.functions import matchers as m
from recscope.operators import assemble, navigate, stats
from recscope.schema import ORDER_KEY
from recscope.sources import metadata, values
from recscope.sources.journal import Slots


@dataclass(frozen=True)
class Journal:
    """``fragments``: all slots; ``source``: what they are read from, in parts where it can be; ``matcher``: the installed filter; ``options``: how lines are written. ``with_filter`` and ``with_options`` return changed copies."""

    fragments: DataFrame
    matcher: m.Matcher | None = None
    options: fmt.FormatOptions = field(default_factory=fmt.FormatOptions)
    source: Slots | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options: str | int) -> Journal:
        source = Slots(spark, path, options)
        return cls(source.read(), source=source)

    def with_filter(self, matcher: m.Matcher) -> Journal:
        """Lines are indented by nesting where function calls can match."""
        return replace(self, matcher=matcher, options=replace(self.options, indent=matcher.shows_calls()))

    def with_options(self, **options) -> Journal:
        return replace(self, options=replace(self.options, **options))

    @cached_property
    def dimensions(self) -> DataFrame:
        return metadata.dimensions(self.source.read(values.HEADERS) if self.source else self.fragments)

    def records(self, since_ns: int | None = None) -> DataFrame:
        found = values.records_of(self.source or self.fragments, self.matcher)
        return found if since_ns is None else navigate.from_time(found, since_ns)

    def lines(self, since_ns: int | None = None) -> DataFrame:
        """(order, value): written lines in order."""
        return assemble.in_order(self.records(since_ns)).select(*ORDER_KEY, self._line().alias("value"))

    def _line(self):
        return fmt.line_text(fmt.body_text(F.col("kind"), F.col("values"), self.options), self.options)

    def dump(self, path: str, since_ns: int | None = None) -> None:
        """Write the lines as text files, in order by file name."""
        self.lines(since_ns).select("value").write.text(path)

    def templates(self) -> DataFrame:
        """(file, meta_pos, log_id, template): what each descriptor's records look like."""
        logs = metadata.log_descriptors(self.dimensions).join(metadata.processes(self.dimensions), ["file", "meta_pos"])
        text = fmt.template_text(F.col("process_name"), F.col("severity"), F.col("pid"), F.col("kind"), F.col("params"))
        return logs.select("file", "meta_pos", "log_id", text.alias("template"))

    def metadata_lines(self) -> DataFrame:
        """(value,): the number and template of every descriptor."""
        return self.templates().orderBy("file", "meta_pos", "log_id").select(F.format_string("(%05d) %s", "log_id", "template").alias("value"))

    def statistics(self, by_file: bool = False) -> DataFrame:
        """(template, occurrences), rarest first; or of each file (file, template, occurrences)."""
        pids = metadata.processes(self.dimensions).select("file", "meta_pos", F.col("process_name").alias("name"), F.col("pid").alias("of"))
        named = self.templates().join(pids, ["file", "meta_pos"])
        # The latest metadata of a process name and id stands for it: records carry both.
        last = named.groupBy("file", F.col("of").alias("pid"), F.col("name").alias("process_name"), "log_id").agg(F.max_by("template", "meta_pos").alias("template"))
        return stats.template_counts(self.records(), last, ["file", "pid", "process_name", "log_id"], ["file"] if by_file else [])

    def step(self, cursor: dict | None, n: int = 1, forward: bool = True) -> DataFrame:
        return navigate.step(self.records(), cursor, n, forward=forward)

    def find(self, cursor: dict | None, expression: m.Matcher, forward: bool = True) -> DataFrame:
        both = expression & self.matcher if self.matcher else expression
        return navigate.step(replace(self, matcher=both).records(), cursor, 1, forward=forward)

    def find_text(self, cursor: dict | None, text: str, forward: bool = True) -> DataFrame:
        return navigate.find_text(self.records(), self._line(), text, cursor, forward=forward)

    def names(self, prefix: str = "") -> DataFrame:
        return assemble.known_names(metadata.log_descriptors(self.dimensions), prefix)
