"""The corpus pipeline: five stages, each of which takes what its predecessor kept.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; between two stages
the documents are written as Parquet and read again, so that every stage starts
from a durable table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import stages
from lodestar.session import written

STAGES = [
    ("language ID", stages.language),
    ("line dedup", stages.lines),
    ("n-gram Jaccard join", stages.near_duplicates),
    ("benchmark decontamination", stages.leaks),
    ("mixing sources", stages.mixture),
]

#: Naive Bayes scores, hashed sets and automata are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
