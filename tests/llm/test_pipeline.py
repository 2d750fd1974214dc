"""The pipeline: each stage on its own input, and the whole of it on a small scale."""

from __future__ import annotations

import base64

import corpus_pipeline as pipeline
import public_tokenizers as P
import tiktoken

from recscope.llm import decontam, secrets_index

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "encoding"]


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        seen.append(docs.count())
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids))
        if name == "decontamination":
            assert decontam.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
        if name == "secrets":
            found = secrets_index.scan(docs)
            assert found.where(" OR ".join(f"size(found_{r.name}) > 0" for r in secrets_index.RULES)).count() == 0
    assert seen[0] > seen[1] > seen[2] >= seen[3] == seen[4] > 0
    last = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: bytes(r["ids"]) for r in last} == {i: b"".join(x.to_bytes(4, "little") for x in tik.encode_ordinary(t or "")) for i, t in texts.items()}


def test_near_dedup_keeps_one_of_each_group(spark):
    base = " ".join(f"word{k}" for k in range(200))
    rows = [(5, base, "en", "s", 1), (3, base, "en", "s", 1), (3, base, "en", "s", 1), (9, base.replace("word7 ", "other "), "en", "s", 1), (4, "a whole other text " * 3, "en", "s", 1), (None, "null id", "en", "s", 1), (None, "null id", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [r["doc_id"] for r in pipeline.near_dedup(spark, docs, SF).collect()]
    assert got.count(3) == 1 and got.count(4) == 1 and 5 not in got


def test_run_survives_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
