"""Edges as adjacency, and the breadth-first search that all graph operators share.

Two ways give the same result:
- where the adjacency is small, by Catalyst's estimate and by a count, it becomes one
  array structure that is broadcast, and every task walks from its own starts;
- else each level is a join of the frontier with the edges, less what was visited,
  written to the shared folder, so that lineage stays short and durable.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import UNKNOWN_BYTES, input_bytes, part_finely, ship, source_bytes, written

DIRECTIONS = ("out", "in", "both")
#: Limits of the adjacency that is broadcast: estimated bytes of the edges, and rows.
LOCAL_BYTES = 512 << 20
LOCAL_EDGES = 4_000_000
#: Tables of so many bytes in all are looked at before they are written.
SMALL_BYTES = 32 << 20
#: Starts that walk side by side.
STARTS = 64


def check_direction(direction: str) -> str:
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}; one of {', '.join(DIRECTIONS)}")
    return direction


def of_relation(edges: DataFrame, relation: str | None) -> DataFrame:
    return edges if relation is None else edges.where(F.col("relation") == relation)


def steps(edges: DataFrame, relation: str | None = None, direction: str = "both", *extra: str) -> DataFrame:
    """(src, dst, and the extra columns): what one step leads to."""
    check_direction(direction)
    edges = of_relation(edges, relation)
    out = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), *extra)
    back = edges.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"), *extra)
    return {"out": out, "in": back}.get(direction, out.unionByName(back))


@dataclass
class Graph:
    """Names, sorted, and for each the positions of its neighbours: to[begin[i]:begin[i + 1]]."""

    names: pa.Array
    begin: np.ndarray
    to: np.ndarray
    weight: np.ndarray | None = None

    @staticmethod
    def of(src: pa.ChunkedArray, dst: pa.ChunkedArray, weight: np.ndarray | None = None) -> Graph:
        """Names become numbers by a dictionary, so that of all the text only distinct names are sorted."""
        coded = pa.chunked_array([*src.chunks, *dst.chunks], pa.string()).combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        where = rank[coded.indices.to_numpy()] if len(order) else np.zeros(0, dtype=np.int64)
        a, b = where[: len(src)], where[len(src) :]
        by = np.lexsort((b, a))
        return Graph(coded.dictionary.take(order), np.searchsorted(a[by], np.arange(len(order) + 1)), b[by], weight[by] if weight is not None else None)

    def index(self, name: str) -> int | None:
        at = pc.index(self.names, name).as_py()
        return at if at >= 0 else None

    def named(self, nodes) -> list[str]:
        return self.names.take(pa.array(nodes, pa.int64())).to_pylist()

    def neighbours(self, nodes: np.ndarray) -> np.ndarray:
        """Positions in `to` of all edges out of nodes."""
        count = self.begin[nodes + 1] - self.begin[nodes]
        return np.repeat(self.begin[nodes] - (np.cumsum(count) - count), count) + np.arange(count.sum())

    def levels(self, start: int, max_depth: int | None) -> np.ndarray:
        """The depth of every node, -1 where it isn't reached."""
        depth = np.full(len(self.names), -1, dtype=np.int64)
        depth[start] = 0
        frontier, d = np.array([start]), 0
        while len(frontier) and (max_depth is None or d < max_depth):
            d += 1
            reached = np.unique(self.to[self.neighbours(frontier)])
            frontier = reached[depth[reached] < 0]
            depth[frontier] = d
        return depth

    def walk(self, starts: np.ndarray, max_depth: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of the starts, nodes, depths) of all that starts reach, side by side; takes room for what is reached alone."""
        n = max(len(self.names), 1)
        visited = frontier = np.arange(len(starts)) * n + starts
        depth, d = np.zeros(len(starts), dtype=np.int32), 0
        while len(frontier) and (max_depth is None or d < max_depth):
            d += 1
            owner, node = frontier // n, frontier % n
            reached = np.unique(np.repeat(owner, self.begin[node + 1] - self.begin[node]) * n + self.to[self.neighbours(node)])
            place = np.minimum(np.searchsorted(visited, reached), len(visited) - 1)
            frontier = reached[visited[place] != reached]
            merged = np.concatenate([visited, frontier])
            order = np.argsort(merged, kind="stable")
            visited, depth = merged[order], np.concatenate([depth, np.full(len(frontier), d, dtype=np.int32)])[order]
        return visited // n, visited % n, depth


def local_graph(adjacency: DataFrame, weighted: bool = False, limit: int | None = None) -> Graph | None:
    """adjacency (src, dst and weight) as a Graph, or None where it is too large for the driver."""
    limit = LOCAL_EDGES if limit is None else limit
    if limit <= 0 or LOCAL_BYTES < input_bytes(adjacency) < UNKNOWN_BYTES:
        return None
    rows = adjacency.select("src", "dst", *(["weight"] if weighted else [])).limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        return None
    return Graph.of(rows.column(0), rows.column(1), rows.column(2).to_numpy() if weighted else None)


def held(adjacency: DataFrame, weighted: bool = False, limit: int | None = None, label: str = "adjacency") -> tuple[Graph | None, DataFrame]:
    """(adjacency as a Graph or None, adjacency): what may be too large is written first and counted there, so that it is made once."""
    limit = LOCAL_EDGES if limit is None else limit
    part_finely(adjacency)
    if limit > 0 and source_bytes(adjacency) <= SMALL_BYTES:
        graph = local_graph(adjacency, weighted, limit)
        if graph is not None:
            return graph, adjacency
    table = written(adjacency, label)
    return (local_graph(table, weighted, limit) if 0 < limit and table.count() <= limit else None), table


def reach(adjacency: DataFrame, starts: DataFrame, max_depth: int | None, *, local_edges: int | None = None) -> DataFrame:
    """(start, node, depth): all nodes that each start reaches in at most max_depth steps, by the fewest; itself at 0."""
    spark = adjacency.sparkSession
    adjacency = adjacency.select("src", "dst")
    starts = starts.select(F.col(starts.columns[0]).cast("string").alias("start")).where("start IS NOT NULL")
    # many partitions for few bytes: a walk costs more than its start weighs
    starts = starts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "start").distinct()
    # steps that repeat are joined as they are: those of a frontier are few, to part all from their like is not
    graph, adjacency = held(adjacency, limit=local_edges)
    if graph is not None:
        ship(spark)
        shared = spark.sparkContext.broadcast(graph)  # within LOCAL_EDGES
        none = pa.array([], pa.string())

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                graph_ = shared.value
                places = pc.index_in(batch.column(0).cast(pa.string()), value_set=graph_.names)
                for a in range(0, batch.num_rows, STARTS):
                    own = pa.concat_arrays([batch.column(0).slice(a, STARTS).cast(pa.string())])
                    at = places.slice(a, STARTS)
                    # a start without an edge reaches itself
                    lone = own.filter(at.is_null())
                    own = own.filter(at.is_valid())
                    number, node, depth = graph_.walk(at.drop_null().to_numpy().astype(np.int64), max_depth)
                    names = graph_.names.take(pa.array(node)) if len(node) else none
                    yield pa.RecordBatch.from_arrays(
                        [pa.concat_arrays([own.take(pa.array(number)) if len(number) else none, lone]), pa.concat_arrays([names, lone]), pa.array(np.concatenate([depth, np.zeros(len(lone), dtype=np.int32)]))],
                        names=["start", "node", "depth"],
                    )

        return starts.mapInArrow(walk, "start string, node string, depth int")
    frontier = written(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")), "level")
    visited, d = frontier, 0
    while max_depth is None or d < max_depth:
        d += 1
        stepped = frontier.join(adjacency, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        frontier = written(stepped.join(visited, ["start", "node"], "left_anti").withColumn("depth", F.lit(d)), "level")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited
