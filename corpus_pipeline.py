"""A training-data pipeline of five stages, each one operator of ``recscope.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recscope.llm import bpe_bitmap, decontam, nbsvm, secrets_index, simhash_ball
from recscope.llm.common import stored, unused
from recscope.llm.queries import table, vocabulary

#: Least score of a document that stays.
ACCEPT = 0.7
#: Words of a shingle in the near-duplicate stage; near-duplicates have a similarity of 0.8 at least (``simhash_ball.TENTHS``).
SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, accepts."""
    model = nbsvm.fit_on_folds(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "_score")
    return nbsvm.score(docs, model, out=score).where(F.col(score) >= ACCEPT).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; documents without an id stay.

    What stays is decided on ids. Only rows whose id is repeated are told apart by their texts; of equal ones the one with the
    least hash of all columns stays.
    """
    linked = stored(simhash_ball.near_duplicates(docs, SHINGLE), "linked").where("doc_id IS NOT NULL")
    kept = linked.where("doc_id = component_id AND set = kept_set").select("doc_id", "set").distinct()
    repeated = linked.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    gone = linked.select("doc_id").join(kept, "doc_id", "left_anti").union(repeated).distinct()
    once = docs.join(gone, "doc_id", "left_anti")
    own = unused(docs, "_set")
    again = simhash_ball.with_sets(docs.join(repeated, "doc_id", "left_semi"), SHINGLE, out=own).join(kept.withColumnRenamed("set", own), ["doc_id", own], "left_semi")
    place = unused(docs, "_place")
    least = Window.partitionBy("doc_id", own).orderBy(F.xxhash64(*docs.columns))
    first = again.withColumn(place, F.row_number().over(least)).where(F.col(place) == 1)
    return once.select(*docs.columns).union(first.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a test item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secrets_index.masked(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents (packed, little-endian), their number, and a digest of the bytes that they decode to."""
    import public_tokenizers

    ranks = vocabulary("byte_bpe_50k.tiktoken")
    coded = bpe_bitmap.encode(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"], decoded="decoded")
    return coded.select("doc_id", bpe_bitmap.n_ids(F.col("ids")).alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("encoding", encoding)]

#: SQL can't express the classifier, the shingles and the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
