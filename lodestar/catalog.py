"""The engine's tables (records, texts, edges, graph nodes) derived from the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding, metadata) of all vectors."""
    t = table(spark, sf_dir, "embeddings")
    return t.select(F.col("vec_id").cast("string").alias("id"), "embedding", F.to_json(F.struct("label")).alias("metadata"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text) of all documents that have a text, with a vector or without."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("id"), "text")


def full_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding, metadata, text) of all vectors and of all texts; what one of them lacks is null."""
    return records(spark, sf_dir).join(texts(spark, sf_dir), "id", "full_outer")


def _named(prefix: str, column: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, target_id, relation, metadata): nation in region, customer in nation, customer placed order, supplier supplies part."""
    none = F.lit("{}").alias("metadata")
    parts = [
        table(spark, sf_dir, "nation").select(_named("n", "n_nationkey").alias("source_id"), _named("r", "n_regionkey").alias("target_id"), F.lit("in_region").alias("relation"), none),
        table(spark, sf_dir, "customer").select(_named("c", "c_custkey"), _named("n", "c_nationkey"), F.lit("in_nation"), none),
        table(spark, sf_dir, "orders").select(_named("c", "o_custkey"), _named("o", "o_orderkey"), F.lit("placed"), F.to_json(F.struct(F.col("o_totalprice").alias("weight")))),
        table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("weight")).select(_named("s", "l_suppkey"), _named("p", "l_partkey"), F.lit("supplies"), F.to_json(F.struct("weight"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, metadata) of all rows of the relational tables that edges name."""
    kinds = {
        "region": ("r", "r_regionkey", {"name": "r_name"}),
        "nation": ("n", "n_nationkey", {"name": "n_name"}),
        "customer": ("c", "c_custkey", {"segment": "c_mktsegment", "balance": "c_acctbal"}),
        "orders": ("o", "o_orderkey", {"status": "o_orderstatus", "price": "o_totalprice", "priority": "o_orderpriority"}),
        "supplier": ("s", "s_suppkey", {"balance": "s_acctbal"}),
        "part": ("p", "p_partkey", {"size": "p_size", "brand": "p_brand"}),
    }
    out = None
    for name, (prefix, key, fields) in kinds.items():
        metadata = F.to_json(F.struct(F.lit(name).alias("type"), *[F.col(c).alias(f) for f, c in fields.items()]))
        one = table(spark, sf_dir, name).select(_named(prefix, key).alias("id"), metadata.alias("metadata"))
        out = one if out is None else out.union(one)
    return out


#: The same tables as common table expressions.
EDGES_SQL = """edges AS (
  SELECT 'n' || n_nationkey AS source_id, 'r' || n_regionkey AS target_id, 'in_region' AS relation, CAST(NULL AS DOUBLE) AS weight FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'in_nation', NULL FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'placed', o_totalprice FROM orders
  UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey, 'supplies', sum(l_quantity) FROM lineitem GROUP BY l_suppkey, l_partkey)"""
RECORDS_SQL = "records AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings)"
TEXTS_SQL = "texts AS (SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents WHERE text IS NOT NULL)"
