"""Stages of the corpus pipeline, (spark, docs, sf_dir) -> DataFrame; docs: doc_id, text, lang, source, n_chars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, langid, linededup, mixing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in a language that lang names, without those whose text says with certainty another than their own lang; see langid.accept()."""
    return langid.accept(docs, langid.train(docs), label="lang")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that an earlier line matches; see linededup.remove_later_lines()."""
    return linededup.remove_later_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near duplicates; see jaccard.keep_one()."""
    return jaccard.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of the benchmark; see decontaminate.decontaminate()."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture of sources selects, with their n_tokens, block and shard; see mixing.mix_sources().

    Rows that share doc_id and source stay or go together.  Columns of docs that are
    called n_tokens, block or shard are replaced; rows without a doc_id go.
    """
    chosen = mixing.mix_sources(docs).select("doc_id", "source", "block", "shard").distinct()
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    joined = whole.join(chosen, (F.col("row.doc_id") == F.col("doc_id")) & (F.coalesce("row.source", F.lit("")) == F.col("source")))
    made = ["n_tokens", "block", "shard"]
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in made]
    return joined.select(*kept, mixing.token_count(F.col("row.text")).alias("n_tokens"), "block", "shard")
