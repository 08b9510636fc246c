"""Corpus pipeline: toxicity filter, exact dedup, near-dedup, benchmark decontamination, BPE encoding.

Each stage gets what its predecessor kept, written as Parquet and read again. All but the last return the
columns of documents.

Defined results: a null text is empty to every stage, so of all null and empty texts the smallest id stays; texts
without words are near no other and hit by no benchmark window; rows that share an id go through the copies' stages as
rows, and go or stay together in near-dedup and decontamination; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gustline.llm import bpe, decontaminate, exact_dedup, minhash, toxicity
from gustline.llm.queries import bpe_path
from gustline.llm.shared import stash, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.5 or more; the scorer learns from labels of this stage's own documents."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    return exact_dedup.exact_dedup(docs, keep="min")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: shingles of five words, similarity 0.8 or more."""
    return minhash.near_dedup(docs, words=5, threshold=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of which windows of benchmark items cover a twentieth or more."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), n=13)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document that is left."""
    return bpe.bpe_digests(docs, bpe_path())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("decontamination", drop_benchmark), ("bpe", encode)]

#: The scorer is trained and the ids are a tokenizer's: SQL states neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
