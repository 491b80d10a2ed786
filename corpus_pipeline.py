"""Corpus pipeline over ``documents``: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.llm import bpe, line_dedup, mixing, ngram_join, quality
from memlake.llm.common import delete_stored, stored, where_late

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return where_late(quality.apply_rules(docs), "kept").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that stand at an earlier place; those left without a word go."""
    cut = line_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return where_late(cut, r"text rlike '[^\\x20\\x09-\\x0D]'").select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of shared five-word shingles connect."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents cut to the words that the mix takes, a row for each pass over a document."""
    return mixing.taken_texts(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their byte-level BPE tokens; the round trip's digests tell that decoding gives the text."""
    return bpe.encode(docs, digest=True, ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("ngram_join", dedup_documents),
    ("source_mix", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: Content-defined chunks, shingle links and the tokenizer have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    before = None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            delete_stored(before)
        before = docs
    return docs
