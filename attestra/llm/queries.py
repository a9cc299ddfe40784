"""Registered queries of the corpus operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.chat import digest, format_conversations
from attestra.llm.common import table
from attestra.llm.html import extract_text
from attestra.llm.langid import identify
from attestra.llm.lexical import ORACLE as LEXICAL_ORACLE
from attestra.llm.lexical import search
from attestra.llm.lm import score_texts
from attestra.llm.merkle import ORACLE as MERKLE_ORACLE
from attestra.llm.merkle import manifest
from attestra.llm.minhash import near_duplicates
from attestra.llm.mixing import mix_sources, words
from attestra.llm.packing import pack_documents
from attestra.llm.pq import ORACLE as VECTOR_ORACLE
from attestra.llm.pq import near_duplicate_vectors
from attestra.llm.secrets import scan_secrets
from attestra.llm.suffixes import repeated_passages
from attestra.llm.topk import ORACLE as TOP_K_ORACLE
from attestra.llm.topk import embedding_top_k

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {"op4_exact_top_k": TOP_K_ORACLE, "op8_pq_near_dedup": VECTOR_ORACLE, "op11_lexical_search": LEXICAL_ORACLE, "op13_merkle_manifest": MERKLE_ORACLE}


def _register(fn: QueryFn) -> QueryFn:
    QUERIES[fn.__name__] = fn
    return fn


@_register
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_secrets(table(spark, sf_dir, "documents"))
    return scanned.select("doc_id", "start", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "before", "after", "score", "is_secret")


@_register
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("n_words"))
    mixed = mix_sources(sized, size=F.col("n_words"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")


@_register
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"),
        F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = rows.withColumn("given", F.lit(True)).unionByName(extra.withColumn("given", F.lit(False)))
    return digest(format_conversations(both, by=("given",)))


@_register
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_top_k(table(spark, sf_dir, "embeddings"))


@_register
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


@_register
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


@_register
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


@_register
def op8_pq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@_register
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@_register
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


@_register
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_register
def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@_register
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))
