"""Corpus pipeline: language, near-duplicates, secrets, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of documents, in their order and with any further columns
whatever they are called. Repeated rows and rows without id pass through like others unless
a stage says otherwise. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestra.llm.common import settle, table
from attestra.llm.langid import identified
from attestra.llm.minhash import keep_representatives
from attestra.llm.mixing import mixed_documents
from attestra.llm.packing import pack_documents
from attestra.llm.secrets import redact, scan_secrets


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of which no language can be told (null or empty text, or no letter in it).

    Where lang is null it becomes the predicted language. A table without labelled texts
    keeps its other documents, unlabelled.
    """
    return identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the smallest id.

    Texts without a word, and rows without id, are linked with nothing; of rows that agree
    in id and text one stays.
    """
    return keep_representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blacked out and n_chars of their texts counted anew; every document stays, also without text."""
    return redact(docs, scan_secrets(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them: not at all, once or twice. Null sources are one source; null texts have no words and go."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the mix; a null or empty text is its end token alone."""
    return pack_documents(docs)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secrets),
    ("mixing sources", mix),
    ("best-fit packing", packing),
]

#: Tokenizing and near-duplicate classes cannot be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
