"""Corpus pipeline: documents pass through the stages in order; each stage's
result is written as Parquet and read again as the next stage's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from storepulse.llm import decontam, minhash, mixing, repair, toxicity
from storepulse.llm.common import read_table, shared_folder

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below TOXIC stay; it
    learns from the labelled rows of the documents that it is given."""
    cols = [c for c in docs.columns if c != "toxic_score"]
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(cols), model, "toxic_score").where(f"toxic_score < {TOXIC}").select(cols)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (words in fives, 80 %)."""
    return minhash.keep_one(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers, names
    or units, go."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target token counts; documents repeat or go."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order, read back: where each document
    lies and the checksum of its ids."""
    return repair.round_trip(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_ids", write_tokens),
]

#: The learned and the iterative stages have no SQL form; tests/llm compares
#: them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
