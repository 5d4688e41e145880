"""The subpackage's queries over the tables of a folder, each with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, langid, linededup, lmscore, mixing, mtree, repeats, tokencount

#: Vectors whose id this divides are the queries of op3_exact_topk, against all vectors.
QUERY_STEP = 50

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.later_lines(table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.nearest(table(spark, sf_dir, "embeddings"), query_step=QUERY_STEP).withColumn("distance", F.round("distance", 6))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lmscore.score(docs, lmscore.train(docs))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    # across documents: a document that repeats its own words alone isn't reported
    return repeats.repeated_passages(table(spark, sf_dir, "documents"), within=False)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_line_dedup": op2_line_dedup,
    "op3_exact_topk": op3_exact_topk,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_decontamination": op5_decontamination,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_token_counts": op7_token_counts,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_language_id": op9_language_id,
    "op10_ngram_jaccard": op10_ngram_jaccard,
}

ORACLE_SQL: dict[str, str] = {"op1_source_mixing": mixing.oracle(), "op3_exact_topk": mtree.oracle(query_step=QUERY_STEP), "op6_chat_formatting": chat.oracle()}
