"""Queries over the corpus operators, with SQL where SQL can express their rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioqc.llm import bpe_tree, conversations, exact_dedup, html_main, importance, jaccard, language, line_quality, mixing, pii, sstable, toxicity, warc
from folioqc.llm.common import table
from folioqc.llm.oracles import ORACLES  # noqa: F401

END_ID = 2


def op1_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.equal_texts(table(spark, sf_dir, "documents"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe_tree.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_quality.verdicts(table(spark, sf_dir, "documents"))
    return judged.select(
        F.col("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_lines", "n_words_left", "base_failed", "kept"
    )


def op10_lstm_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op11_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archived(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("problem").isNull().alias("valid"))


def op12_importance_duckdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(rows, conversations.damaged(rows))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_skip_chain_pii, op2_exact_dedup, op3_token_shards, op4_mix_sources, op5_pu_toxicity,
        op6_gru_language, op7_bpe_tree, op8_ngram_jaccard, op9_line_quality, op10_lstm_html,
        op11_warc_zstd, op12_importance_duckdb, op13_conversation_repair,
    )
}
