"""Neighbours, traversal, shortest paths and graph-expanded vector search over edges (source_id, target_id, relation, metadata)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metadata import kind_of, predicate, raw_value
from ..session import part_finely, written
from .adjacency import Graph, check_direction, held, local_graph, of_relation, reach, steps
from .vector import top_k


def incident_edges(edges: DataFrame, node: str, relation: str | None = None, direction: str = "both") -> DataFrame:
    """The edges at a node."""
    out, back = F.col("source_id") == node, F.col("target_id") == node
    return of_relation(edges, relation).where({"out": out, "in": back, "both": out | back}[check_direction(direction)])


def neighbors(edges: DataFrame, node: str, relation: str | None = None, direction: str = "both", *, records: DataFrame | None = None) -> DataFrame:
    """(id, relation, direction, edge_metadata) of a node's neighbours, once for each relation and direction.

    A loop is told once, as "out".  With records, metadata of the neighbour too, null
    where it has no record.
    """
    check_direction(direction)
    edges = of_relation(edges, relation)
    columns = ["relation", F.col("metadata").alias("edge_metadata")]
    out = edges.where(F.col("source_id") == node).select(F.col("target_id").alias("id"), columns[0], F.lit("out").alias("direction"), columns[1])
    back = edges.where(F.col("target_id") == node)
    if direction == "both":
        back = back.where(F.col("source_id") != node)
    back = back.select(F.col("source_id").alias("id"), columns[0], F.lit("in").alias("direction"), columns[1])
    found = {"out": out, "in": back}.get(direction, out.unionByName(back)).dropDuplicates(["id", "relation", "direction"])
    if records is not None:
        found = found.join(records.select("id", "metadata"), "id", "left")
    return found


@dataclass
class Traversal:
    """nodes (id, depth); edges (source_id, target_id, relation) touched on the way; truncated() tells whether max_nodes cut nodes off."""

    nodes: DataFrame
    edges: DataFrame
    reached: DataFrame
    max_nodes: int | None

    def truncated(self) -> bool:
        return self.max_nodes is not None and self.reached.limit(self.max_nodes + 1).count() > self.max_nodes


def traverse(edges: DataFrame, start: str, max_depth: int = 2, relation: str | None = None, direction: str = "both", max_nodes: int | None = 1000, *, local_edges: int | None = None) -> Traversal:
    """Nodes within max_depth steps of start, by depth and id the first max_nodes of them, or all if that is None.

    start is at depth 0, with or without a record.  Edges are those at a node that
    was expanded, one less deep than max_depth.
    """
    check_direction(direction)
    starts = edges.sparkSession.createDataFrame([(start,)], "start string")
    reached = reach(steps(edges, relation, direction), starts, max_depth, local_edges=local_edges).select(F.col("node").alias("id"), "depth")
    nodes = reached if max_nodes is None else reached.orderBy("depth", "id").limit(max_nodes)
    expanded = nodes.where(F.col("depth") < max_depth).select("id")
    own = of_relation(edges, relation).select("source_id", "target_id", "relation")
    sides = []
    if direction != "in":
        sides.append(own.join(expanded, F.col("source_id") == F.col("id"), "left_semi"))
    if direction != "out":
        sides.append(own.join(expanded, F.col("target_id") == F.col("id"), "left_semi"))
    touched = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    return Traversal(nodes, touched.distinct(), reached, max_nodes)


def shortest_path(edges: DataFrame, source: str, target: str, relation: str | None = None, direction: str = "both", max_depth: int = 10, *, local_edges: int | None = None) -> list[str] | None:
    """The ids on a path of the fewest steps, None if there is none within max_depth; of several the one that sorts first."""
    if source == target:
        return [source]
    graph, adjacency = held(steps(edges, relation, direction), limit=local_edges)
    if graph is not None:
        a, b = graph.index(source), graph.index(target)
        if a is None or b is None:
            return None
        return _first_path(graph, graph.levels(a, max_depth), a, b)
    frontier = edges.sparkSession.createDataFrame([(source, [source])], "node string, path array<string>")
    visited = frontier.select("node")
    for _ in range(max_depth):
        grown = frontier.join(adjacency, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        frontier = written(grown.join(visited, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")), "paths")
        hit = frontier.where(F.col("node") == target).first()
        if hit:
            return list(hit.path)
        if frontier.isEmpty():
            return None
        visited = visited.union(frontier.select("node"))
    return None


def _first_path(graph: Graph, depth: np.ndarray, a: int, b: int) -> list[str] | None:
    """The path from a to b that sorts first: among nodes that lead to b, step by step the least."""
    if depth[b] < 0:
        return None
    on_path = {int(b)}
    source = np.repeat(np.arange(len(graph.names)), np.diff(graph.begin))
    layer = np.array([b])
    layers = {int(depth[b]): {int(b)}}
    for d in range(int(depth[b]) - 1, -1, -1):
        hit = np.isin(graph.to, layer) & (depth[source] == d)
        layer = np.unique(source[hit])
        layers[d] = set(layer.tolist())
        on_path |= layers[d]
    path = [int(a)]
    for d in range(1, int(depth[b]) + 1):
        nexts = graph.to[graph.begin[path[-1]] : graph.begin[path[-1] + 1]]
        path.append(int(min(x for x in nexts.tolist() if x in layers[d])))
    return graph.named(path)


def weighted_steps(edges: DataFrame, relation: str | None, direction: str, weight_field: str, default_weight: float) -> DataFrame:
    """(src, dst, weight, good): the least weight of parallel steps; a missing or null weight is the default one."""
    raw = raw_value(F.col("metadata"), weight_field)
    number = raw.try_cast("double")
    good = raw.isNull() | (kind_of(F.col("metadata"), weight_field).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & number.isNotNull())
    valued = edges.withColumns({"weight": F.coalesce(number, F.lit(float(default_weight))), "good": good})
    return steps(valued, relation, direction, "weight", "good").groupBy("src", "dst").agg(F.min("weight").alias("weight"), F.min("good").alias("good"))


def shortest_path_weighted(edges: DataFrame, source: str, target: str, relation: str | None = None, direction: str = "both", weight_field: str = "weight", default_weight: float = 1.0, *, local_edges: int | None = None) -> tuple[list[str], float] | None:
    """(ids on a path of the least total weight, that weight), None if there is none.

    Of several such paths one of the fewest steps, of these the one that sorts first.
    An edge that can be reached and has a negative weight, or one that isn't a
    number, raises ValueError.
    """
    if source == target:
        return [source], 0.0
    part_finely(edges)
    adjacency = written(weighted_steps(edges, relation, direction, weight_field, default_weight), "weighted")
    spark = edges.sparkSession
    starts = spark.createDataFrame([(source,)], "start string")
    bad = adjacency.where((F.col("weight") < 0) | ~F.col("good"))
    if not bad.isEmpty():
        reached = reach(adjacency, starts, None, local_edges=local_edges)
        if not bad.join(reached, F.col("src") == F.col("node"), "left_semi").isEmpty():
            raise ValueError(f"{weight_field} must be a number of 0 at least")
    graph = local_graph(adjacency, weighted=True, limit=local_edges)
    if graph is not None:
        a, b = graph.index(source), graph.index(target)
        return None if a is None or b is None else _relaxed(graph, a, b)
    state = written(spark.createDataFrame([(source, 0.0, True)], "node string, total double, fresh boolean"), "relaxed")
    while True:
        bound = state.where(F.col("node") == target).agg(F.min("total")).first()[0]
        fresh = state.where("fresh")
        if bound is not None:
            fresh = fresh.where(F.col("total") <= bound)
        grown = fresh.join(adjacency, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("total") + F.col("weight")).alias("total"))
        best = grown.groupBy("node").agg(F.min("total").alias("new"))
        merged = state.select("node", F.col("total").alias("old")).join(best, "node", "full_outer")
        better = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") < F.col("old")))
        state = written(merged.select("node", F.when(better, F.col("new")).otherwise(F.col("old")).alias("total"), better.alias("fresh")), "relaxed")
        if state.where("fresh").isEmpty():
            break
    hit = state.where(F.col("node") == target).first()
    if not hit:
        return None
    # the edges that paths of the least weight are made of
    before, after = state.select(F.col("node").alias("src"), F.col("total").alias("before")), state.select(F.col("node").alias("dst"), F.col("total").alias("after"))
    tight = adjacency.join(before, "src").join(after, "dst").where(F.col("before") + F.col("weight") == F.col("after"))
    tight = written(tight.select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.lit("tight").alias("relation"), F.lit("{}").alias("metadata")), "tight")
    return shortest_path(tight, source, target, None, "out", state.count(), local_edges=local_edges), hit.total


def _relaxed(graph: Graph, a: int, b: int) -> tuple[list[str], float] | None:
    """Relaxation of all edges out of nodes that got nearer, until none does."""
    total = np.full(len(graph.names), np.inf)
    total[a] = 0.0
    fresh = np.array([a])
    source = np.repeat(np.arange(len(graph.names)), np.diff(graph.begin))
    while len(fresh):
        at = graph.neighbours(fresh)
        offered, to = total[source[at]] + graph.weight[at], graph.to[at]
        order = np.lexsort((offered, to))
        first = order[np.append(True, to[order][1:] != to[order][:-1])] if len(order) else order
        better = first[(offered[first] < total[to[first]]) & (offered[first] <= total[b])]
        total[to[better]] = offered[better]
        fresh = to[better]
    if not np.isfinite(total[b]):
        return None
    # the edges that paths of the least weight are made of
    tight = np.isfinite(total[source]) & (total[source] + graph.weight == total[graph.to])
    begin = np.concatenate([[0], np.cumsum(np.bincount(source[tight], minlength=len(graph.names)))])
    made_of = Graph(graph.names, begin, graph.to[tight], None)
    return _first_path(made_of, made_of.levels(a, None), a, b), float(total[b])


def graph_search(records: DataFrame, edges: DataFrame, query: Sequence[float], k: int = 10, expand_hops: int = 1, relation: str | None = None, where=None, *, metric: str = "cosine", direction: str = "both") -> DataFrame:
    """(id, score, metadata, via, hop_distance): the k nearest records, and what their edges lead to in expand_hops steps.

    What edges lead to must have a record that the filter allows, and has no score;
    its hop_distance is the least from any hit.
    """
    hits = written(top_k(records.select("id", "embedding", "metadata"), query, k, metric=metric, where=where).select("id", "score", "metadata"), "hits")
    walked = reach(steps(edges, relation, direction), hits.select("id"), expand_hops)
    nearest = walked.where("depth > 0").groupBy(F.col("node").alias("id")).agg(F.min("depth").alias("hop_distance"))
    allowed = records.where(predicate(F.col("metadata"), where)).select("id", "metadata")
    expanded = nearest.join(hits, "id", "left_anti").join(allowed, "id").select("id", F.lit(None).cast("double").alias("score"), "metadata", F.lit("graph").alias("via"), "hop_distance")
    return hits.select("id", "score", "metadata", F.lit("vector").alias("via"), F.lit(0).alias("hop_distance")).unionByName(expanded)


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with the same keys that with the highest order."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__place", F.row_number().over(newest)).where("__place = 1").drop("__place")
