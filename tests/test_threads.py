"""Threads beyond 16 bits through both writers, the readers and the stream."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from compare import same

from recscope.plans.all_queries import ORACLES, QUERIES
from recscope.sources import journal
from recscope.sources.record_sink import slots_of

JOURNALS = (
    "journal_records journal_filter_pruned journal_filter_enumerators journal_filter_constants journal_format journal_format_hidden journal_reverse journal_seek journal_stream journal_stream_lines "
    "journal_recaptured"
).split()


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """Events of users beyond 16 bits, whose lower 16 bits are those of others."""
    path = tmp_path_factory.mktemp("wide")
    duckdb.sql(f"COPY (SELECT * REPLACE (user_id + CASE event_id % 3 WHEN 0 THEN 65536 WHEN 1 THEN 81920 ELSE 0 END AS user_id) FROM '/root/testdata/sf0.001/events.parquet') TO '{path}/events.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", JOURNALS)
def test_query_matches_sql(spark, wide, name):
    assert same(QUERIES[name](spark, wide), ORACLES[name], wide)


def frame(tid: list[int], generation: list[int]) -> pa.RecordBatch:
    n = len(tid)
    of = {"file": ["f"] * n, "pos": range(n), "ts_ns": [7] * n, "pid": [3] * n, "tid": tid, "nesting": [0] * n, "termination": [3] * n, "severity": [5] * n, "rec_type": [1] * n, "generation": generation, "payload": [b"x" * 44] * n}
    return pa.RecordBatch.from_arrays([pa.array(list(of[f.name]), f.type) for f in journal.ARROW], schema=journal.ARROW)


def test_slots_keep_threads_and_generations():
    some = frame([0, 65535, 65536, 5_000_000, (1 << 31) - 1, -1], [4_000_000_000, 4_000_000_000, 0, 65535, 1, 2])
    assert journal.decode_slots(journal.encode_slots(some), "f", 0).equals(some)
    narrow = np.frombuffer(journal.encode_slots(some), journal.LAYOUT)[:2]
    assert narrow["bits"].tolist() == [3, 3] and narrow["generation"].tolist() == [4_000_000_000] * 2  # as the format has them
    with pytest.raises(ValueError, match="generation"):
        journal.encode_slots(frame([65536], [65536]))


def test_records_keep_threads():
    tids = [1, 70_000, 540_000]
    batch = pa.RecordBatch.from_pydict({"pid": [1] * 3, "tid": pa.array(tids, pa.int32()), "ts_ns": [5] * 3, "nesting": [0] * 3, "severity": [3] * 3, "payload": [b"a" * 100, b"b", b""]})
    slots, n = slots_of(batch)
    assert journal.threads_of(slots).tolist() == np.repeat(tids, n).tolist() and n.tolist() == [3, 1, 1]
