"""Matchers that descriptors decide: what is left of the dimension, and that nothing else is decoded."""

from __future__ import annotations

import pytest
from journal_writer import Journal, chunked, flag, metadata, record
from pyspark.sql import functions as F

from recscope.functions import matchers as m
from recscope.journal import Journal as Opened
from recscope.sources import values


def written(tmp_path) -> str:
    said = lambda text: [{"flags": flag("CSTR"), "text": text}, {"flags": flag("VARRAY", "STR", "NAMED_PARAM"), "name": "what"}]
    j = Journal()
    j.process(1, metadata("app", [(2, 3, said("alpha")), (0, 1, said("beta")), (1, 1, said("beta")), (2, 3, [{"flags": flag("NUM_8", "NAMED_PARAM"), "name": "n", "text": "size_t"}])], []))
    rows = [s for k in range(40) for s in record(k % 4, chunked(b"x" * (40 * (k % 3))) if k % 4 < 3 else bytes([k]), 100 + k, 1, k % 3, 0, 3)]
    j.add_dump([(1, 0x08, 200, rows)])
    path = str(tmp_path / "trace.1.dump")
    j.write(path)
    return path


def leaves():
    return {"alpha": m.const_substring("alp"), "beta": m.function("beta"), "size": m.type_name("size_t"), "two": m.log_id(2), "tid": m.tid(1), "n": m.named_param("n", 3), "all": m.anything()}


@pytest.mark.parametrize("pair", [("alpha", "n"), ("beta", "tid"), ("size", "two"), ("all", "beta")], ids="-".join)
def test_pruned_records_are_those_of_the_filter(spark, tmp_path, pair):
    opened = Opened.open(spark, written(tmp_path))
    every = opened.records().persist()
    a, b = (leaves()[n] for n in pair)
    for matcher in (a & b, a | ~b, ~(a & ~b)):
        got = sorted(r["pos"] for r in opened.with_filter(matcher).records().select("pos").collect())
        assert got == sorted(r["pos"] for r in every.where(matcher.record).select("pos").collect())
    every.unpersist()


def test_only_matching_descriptors_are_decoded(spark, tmp_path, monkeypatch):
    counted = spark.sparkContext.accumulator(0)
    real = values.with_values

    def watched(records, dims, payload="payload"):
        @F.udf("binary")
        def seen(data):
            counted.add(1)
            return data

        return real(records.withColumn(payload, seen(payload)), dims, payload)

    monkeypatch.setattr(values, "with_values", watched)
    found = Opened.open(spark, written(tmp_path)).with_filter(m.const_substring("alp") & ~m.log_id(3)).records()
    assert len(found.collect()) == 10 and counted.value == 10
