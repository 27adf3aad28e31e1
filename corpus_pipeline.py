"""Five stages over documents; each is written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioqc.llm import bpe_tree, exact_dedup, jaccard, line_quality, mixing
from folioqc.llm.common import cut, release, scratch, table, unpacked


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without boilerplate lines; n_chars follows the new text.

    Null and empty texts fail. Copies are there still, so equal texts count once and the first
    document that has a line keeps it. Rows that repeat a document stay or go together; null
    identifiers are judged as all others; no row gives no row; other columns pass through whatever
    their names.
    """
    judged = line_quality.verdicts(docs, by_text=True).where("kept")
    new = {"text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return unpacked(judged, docs.columns, **new)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest doc_id.

    Null texts equal empty ones; a null doc_id loses to any number; rows that repeat a doc_id and
    text come out once; no row gives no row; other columns pass through whatever their names.
    """
    return exact_dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share most of their word shingles.

    Texts without words link with nothing and stay, as do rows with a null doc_id and rows that
    repeat one that stays; no row gives no row; other columns pass through whatever their names.
    """
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    Each row is decided by itself, whatever its doc_id: null or repeated ones multiply nothing.
    Texts without words are not taken; a null source is a source; no row gives no row; other
    columns pass through whatever their names.
    """
    taken = mixing.mix(docs, keep_rows=True).where("taken > 0")
    times = F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))
    return unpacked(taken.select("row", times), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token identifiers and digests of every document, one row for each.

    Null texts have no tokens; null and repeated identifiers give one row each; no row gives no
    row; columns but doc_id and text are not read.
    """
    return bpe_tree.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", dedup),
    ("n-gram jaccard join", near_dedup),
    ("mix sources", mix),
    ("byte-level bpe", encode),
]

#: Shingle components and BPE merges have no SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch() as keep:
            docs = keep(cut(stage(spark, before, sf_dir), name.replace(" ", "-")))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
