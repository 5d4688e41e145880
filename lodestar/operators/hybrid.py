"""Reciprocal rank fusion of a vector search and a keyword search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keyword import filtered_search
from .vector import top_k


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, k: int = 10, rrf_k: int = 60) -> DataFrame:
    """(rank, id, score) of two lists (id, score), the lowest score first in each.

    score is the sum of 1 / (rrf_k + rank), ranks from 1; equal scores go by the rank
    in the vector list, then by that in the keyword list.
    """
    order = Window.orderBy("score", "id")  # over lists that were cut to a pool
    a = vector_hits.select("id", F.row_number().over(order).alias("vector_rank"))
    b = keyword_hits.select("id", F.row_number().over(order).alias("keyword_rank"))
    share = [F.coalesce(1.0 / (F.lit(rrf_k) + F.col(c)), F.lit(0.0)) for c in ("vector_rank", "keyword_rank")]
    fused = a.join(b, "id", "full_outer").withColumn("score", share[0] + share[1])
    best = [F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank"), F.asc("id")]
    return fused.orderBy(*best).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*best))).select("rank", "id", "score", "vector_rank", "keyword_rank")


def search(records: DataFrame, query_vector: Sequence[float], query_text: str, k: int = 10, *, where=None, rrf_k: int = 60, candidate_pool: int = 50, metric: str = "cosine", mode: str = "pre", stemmed: bool = True, texts: DataFrame | None = None) -> DataFrame:
    """Hybrid search of records (id, embedding, metadata, text): both lists hold max(k, candidate_pool) records.

    Texts (id, text) may be a table of their own, which then isn't joined with the
    vectors; what only they have is found too, without metadata.
    """
    pool = max(k, candidate_pool)
    apart = texts is not None
    by_vector = top_k(records.select("id", "embedding", "metadata"), query_vector, pool, metric=metric, where=where, mode=mode)
    by_keyword = filtered_search(texts if apart else records.select("id", "text"), records.select("id", "metadata"), query_text, pool, where, mode=mode, stemmed=stemmed)
    return fuse(by_vector, by_keyword, k, rrf_k).join(records.select("id", "metadata"), "id", "left" if apart else "inner").orderBy("rank")
