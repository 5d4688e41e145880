"""Degrees, connected components and PageRank of the graph that edges make.

Where the edges are few enough for one machine (see adjacency.held()) the iterations
run on arrays there; else on tables of numbers (see blocks), each round written to the
shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import blocks
from .adjacency import check_direction, held, of_relation, steps


def degree_centrality(edges: DataFrame, relation: str | None = None, direction: str = "both") -> DataFrame:
    """(id, degree) of every node at an edge: edges that leave it, enter it or both (a loop then counts twice)."""
    check_direction(direction)
    edges = of_relation(edges, relation)
    weigh = {"out": (1, 0), "in": (0, 1), "both": (1, 1)}[direction]
    ends = F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(weigh[0]).alias("n")), F.struct(F.col("target_id").alias("id"), F.lit(weigh[1]).alias("n"))))
    return edges.select(ends.alias("e")).groupBy(F.col("e.id").alias("id")).agg(F.sum("e.n").cast("long").alias("degree"))


def connected_components(edges: DataFrame, relation: str | None = None, *, local_edges: int | None = None) -> DataFrame:
    """(id, component) of every node at an edge, directions disregarded; a component is named by its least id."""
    edges = of_relation(edges, relation)
    graph, links = held(steps(edges, None, "out"), limit=local_edges, label="links")
    if graph is not None:
        label = np.arange(len(graph.names))
        source = np.repeat(label, np.diff(graph.begin))
        while len(source):
            low = label.copy()
            np.minimum.at(low, label[source], label[graph.to])
            np.minimum.at(low, label[graph.to], label[source])
            low = low[low]
            if (low == label).all():
                break
            label = low[label]
        return edges.sparkSession.createDataFrame(pa.table({"id": graph.names, "component": graph.names.take(pa.array(label))}))
    return blocks.components(links, written(blocks.ends(links).distinct(), "nodes"))


def pagerank(edges: DataFrame, relation: str | None = None, damping: float = 0.85, iterations: int = 50, tol: float = 1e-8, *, local_edges: int | None = None) -> DataFrame:
    """(id, rank) of every node at an edge.

    Parallel edges count each; what nodes without an outgoing edge hold is spread
    evenly.  Stops after iterations, or when the ranks change by less than tol in all.
    """
    edges = of_relation(edges, relation)
    spark = edges.sparkSession
    graph, links = held(steps(edges, None, "out"), limit=local_edges, label="links")
    if graph is not None:
        n = len(graph.names)
        out = np.diff(graph.begin)
        source = np.repeat(np.arange(n), out)
        rank = np.full(n, 1 / max(n, 1))
        for _ in range(iterations if n else 0):
            moved = np.bincount(graph.to, weights=(rank / np.maximum(out, 1))[source], minlength=n)
            new = (1 - damping) / n + damping * (moved + rank[out == 0].sum() / n)
            change = np.abs(new - rank).sum()
            rank = new
            if change < tol:
                break
        return spark.createDataFrame(pa.table({"id": graph.names, "rank": rank}))
    return blocks.pagerank(links, written(blocks.ends(links).distinct(), "nodes"), damping, iterations, tol)
