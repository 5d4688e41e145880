"""Edges from CSV files and adjacency lists."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Imported:
    """edges (source_id, target_id, relation, metadata, position), before they are made unique, and the rows left out.

    position orders the rows as the files, by name, have them: of equal edges the last counts.
    """

    edges: DataFrame
    skipped_rows: DataFrame
    #: (good): all rows, and whether each has an edge; for counting them in one pass.
    rows: DataFrame | None = None

    def counts(self) -> dict[str, int]:
        both = self.edges.select(F.lit(1).alias("kept")).union(self.skipped_rows.select(F.lit(0))).agg(F.count("*"), F.sum("kept")).first() if self.rows is None else self.rows.agg(F.count("*"), F.count_if("good")).first()
        return {"imported": both[1] or 0, "skipped": both[0] - (both[1] or 0)}


#: What JSON begins with, and numbers that are JSON for certain.
_MAY_BE_JSON, _NUMBER = r'^\s*[\[{"\-0-9tfn]', r"^-?(?:0|[1-9][0-9]{0,14})(?:\.[0-9]{1,15})?$"


def _value(cell: Column) -> Column:
    """A cell as JSON: itself where it is JSON, else a JSON string."""
    text = F.to_json(F.struct(cell.alias("v")))
    # a parser's failure costs more than all else of a row
    is_json = F.when(cell.rlike(_NUMBER), True).when(cell.rlike(_MAY_BE_JSON), F.try_parse_json(cell).isNotNull()).otherwise(False)
    return F.when(is_json, cell).otherwise(F.substring(text, F.lit(6), F.length(text) - 6))


def edges_from_csv(spark: SparkSession, path: str, source_column: str = "source", target_column: str = "target", relation_column: str | None = None, default_relation: str = "related", metadata_columns: list[str] | None = None) -> Imported:
    """Edges of a CSV file with a header.

    Rows without a source or a target are skipped; a blank relation is the default
    one, blank cells of metadata are left out, others are JSON values if they read as
    JSON, else strings.
    """
    # a file that may hold line breaks in cells is read by one task, in order
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    position = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    missing = [c for c in (source_column, target_column) if c not in rows.columns]
    source = F.trim(F.coalesce(F.col(source_column) if source_column not in missing else F.lit(""), F.lit("")))
    target = F.trim(F.coalesce(F.col(target_column) if target_column not in missing else F.lit(""), F.lit("")))
    relation = F.trim(F.coalesce(F.col(relation_column), F.lit(""))) if relation_column in rows.columns else F.lit("")
    parts = [F.when(F.trim(F.col(c)) != "", F.concat(F.lit(json.dumps(c, ensure_ascii=False) + ":"), _value(F.col(c)))) for c in metadata_columns or [] if c in rows.columns]
    metadata = F.concat(F.lit("{"), F.concat_ws(",", *parts) if parts else F.lit(""), F.lit("}"))
    made = rows.select(source.alias("source_id"), target.alias("target_id"), F.when(relation == "", F.lit(default_relation)).otherwise(relation).alias("relation"), metadata.alias("metadata"), position.alias("position"))
    good = (F.col("source_id") != "") & (F.col("target_id") != "")
    return Imported(made.where(good), made.where(~good), rows.select(((source != "") & (target != "")).alias("good")))


def edges_from_adjacency(spark: SparkSession, path: str, relation: str = "related", delimiter: str = " ") -> Imported:
    """Edges of lines "source target target ..."; blank lines and those that begin with # are passed over."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    parts = F.filter(F.transform(F.split("line", "\\Q" + delimiter + "\\E"), lambda x: F.trim(x)), lambda x: x != "")
    pairs = lines.select(parts.alias("p")).where(F.size("p") > 1).select(F.col("p")[0].alias("source_id"), F.explode(F.slice("p", 2, 2_147_483_647)).alias("target_id"))
    # equal edges of a list don't differ, so any of them may count
    edges = pairs.select("source_id", "target_id", F.lit(relation).alias("relation"), F.lit("{}").alias("metadata"), F.lit(0).alias("position"))
    return Imported(edges, edges.where("false"))
