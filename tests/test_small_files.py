"""Journals of many small files: a task reads several, and metadata that files repeat is one version."""

from __future__ import annotations

from test_record_sink import expected, processes, read_back, records

from recscope.journal import Journal
from recscope.sources import journal, record_sink, values


def test_files_share_tasks_and_versions(spark, tmp_path, monkeypatch):
    df, path = records(spark, 1000), str(tmp_path / "logs")
    record_sink.write_records(df, processes(spark, tmp_path), path, slotsPerFile=300, slotsPerChunk=64)
    files = journal.listed(path)
    parts = journal.JournalReader({"path": path}).partitions()
    ranges = [r for p in parts for r in p.ranges]
    assert len(files) > 8 and len(parts) == 1 and sorted((r.file, r.begin, r.end) for r in ranges) == [(f, 0, n) for f, n in files]
    seen = []
    real = values.with_values

    def watched(records, dims, payload="payload"):
        seen.append(dims.count())
        return real(records, dims, payload)

    monkeypatch.setattr(values, "with_values", watched)
    assert read_back(Journal.open(spark, path).records()) == expected(df)
    assert seen == [3]  # the processes, in whatever number of files


def test_packed_ranges_are_bounded():
    ranges = [journal.Range(f"f{k}", 0, 40, True) for k in range(10)] + [journal.Range("g", 0, 500, True)]
    parts = journal.packed(ranges, 100)
    assert [len(getattr(p, "ranges", [p])) for p in parts] == [2] * 5 + [1]
