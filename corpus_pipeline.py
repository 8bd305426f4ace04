"""A training corpus in five stages over `documents`: quality, near duplicates, contamination, secrets, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinsmith.llm.bpe import round_trip
from kinsmith.llm.common import discard, discard_since, materialize, table, tables_written
from kinsmith.llm.decontam import decontaminate
from kinsmith.llm.importance import keep_good
from kinsmith.llm.minhash import keep_one
from kinsmith.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced."""
    return redact_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's tokens, and the digest of what they decode to."""
    return round_trip(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]

#: SQL cannot express the resampling, so the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, last = tables_written(), docs
        docs = materialize(stage(spark, last, sf_dir), name)
        discard_since(before, docs)  # what the stage needed on its way
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
