"""The registered queries of this package: each applies one operator to its whole table.

``QUERIES`` maps a name to a callable of (spark, sf_dir); ``ORACLES`` has the same result in DuckDB SQL where SQL
can express it.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recscope.llm import bpe_bitmap, decontam, html_template, lang_cnn, license_dice, lm_maxent, nbsvm, phrase_sa, prefix_trie, rules_ledger, secrets_index, simhash_ball, token_fst
from recscope.llm.common import fold, text_or_empty

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The path of an installed public vocabulary file."""
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str, vocabulary_file: str | None = None, limit: int = 512) -> DataFrame:
    """Tokens of every document under the vocabulary's library, and whether they exceed ``limit``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty(F.col("text")).alias("text"))
    counted = token_fst.count_tokens(docs, vocabulary_file or vocabulary("byte_bpe_50k.json"))
    return counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str, rank_file: str | None = None) -> DataFrame:
    """Every document encoded to ids and decoded again, as digests."""
    import public_tokenizers

    ranks = rank_file or vocabulary("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty(F.col("text")).alias("text"))
    coded = bpe_bitmap.encode(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"], decoded="decoded")
    return coded.select("doc_id", bpe_bitmap.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str, words: int = 4, radius: int = 4) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty(F.col("text")).alias("text"))
    linked = simhash_ball.components(simhash_ball.fingerprints(docs, words).select("doc_id", "fingerprint"), radius)
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str, policy: str = "v1") -> DataFrame:
    """Measurements and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    entries = rules_ledger.ledger(docs)
    base = rules_ledger.passes("base")
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~base).alias("base_failed"), (base & rules_ledger.passes(policy)).alias("kept"), "failed")


ORACLES["op6_quality_rules"] = rules_ledger.oracle_sql()


@query
def quality_rule_ablations(spark: SparkSession, sf_dir: str, policy: str = "v1") -> DataFrame:
    """What each rule of the policy drops, and what would stay without it, from the ledger's bits alone."""
    return rules_ledger.ablations(rules_ledger.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), policy)


ORACLES["quality_rule_ablations"] = rules_ledger.ablations_sql()


@query
def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base counts and digest, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets_index.scan(docs)
    of = lambda names: [F.col(f"found_{n}") for n in names]
    counts = [F.size(f"found_{n}").cast("long").alias(f"n_{n}") for n in secrets_index.BASE]
    every = [r.name for r in secrets_index.RULES]
    return found.select("doc_id", *counts, F.sha2(secrets_index.written(*of(secrets_index.BASE)), 256).alias("base_sha256"), secrets_index.written(*of(every)).alias("spans"))


ORACLES["op8_secret_scans"] = secrets_index.oracle_sql()


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test items that documents contain: a row for each pair of document and item."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str, accept: float = 0.7) -> DataFrame:
    """Quality score of every document, by a model of the labels outside of the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = nbsvm.fit_on_folds(docs, table(spark, sf_dir, "labels"))
    scored = nbsvm.score(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document; one fold in seven is held out of the training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_maxent.score(docs, docs.where(fold(F.col("doc_id"), 7) != 2))
    return scored.withColumn("held_out", fold(F.col("doc_id"), 7) == 2)


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    texts = html_template.main_texts(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "by_template")


@query
def op7_license_scans(spark: SparkSession, sf_dir: str, threshold: float = 0.8) -> DataFrame:
    """Licenses of every document: names in order, the number of matches and the best coefficient (0 if none)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_dice.licenses(docs, threshold)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"]))), ",")
    best = F.coalesce(F.array_max(F.transform("licenses", lambda x: x["dice"])), F.lit(0.0))
    return found.select("doc_id", names.alias("licenses"), F.size("licenses").cast("long").alias("n_matches"), best.alias("dice"))


@query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two to four words of each language."""
    return phrase_sa.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLES["op13_phrase_collocations"] = phrase_sa.oracle_sql()


@query
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a network that learned from those outside of the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    outside = fold(F.col("doc_id"), 4) != 2
    net = lang_cnn.fit(docs.where(outside))
    found = lang_cnn.identified(docs.select("doc_id", "text"), net)
    return found.select("doc_id", (~outside).alias("held_out"), "lang_pred", "score")


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all conversations, rebuilt so that many begin with turns of another one."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.nodes(*prefix_trie.rebuilt(prefix_trie.numbered(conversations)))


ORACLES["op11_conversation_trie"] = prefix_trie.oracle_sql()
