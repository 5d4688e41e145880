import json

import numpy as np
import pytest

from lodestar.operators import algorithms, graph
from lodestar.operators.adjacency import reach, steps

SCHEMA = "source_id string, target_id string, relation string, metadata string"
BOTH = pytest.mark.parametrize("local", [None, 0])


def edges(spark, *rows):
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "links_to", json.dumps(r[3]) if len(r) > 3 else "{}") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def chain(spark):
    return edges(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("a", "e", "mentions"), ("a", "gone", "mentions"), ("a", "a", "self"))


def test_neighbors(spark, chain):
    got = {(r.id, r.relation, r.direction) for r in graph.neighbors(chain, "a").collect()}
    assert got == {("b", "links_to", "out"), ("e", "mentions", "out"), ("gone", "mentions", "out"), ("a", "self", "out")}
    assert {r.id for r in graph.neighbors(chain, "b", direction="in").collect()} == {"a"}
    records = spark.createDataFrame([("b", '{"t":1}')], "id string, metadata string")
    assert {r.id: r.metadata for r in graph.neighbors(chain, "a", direction="out", records=records).collect()} == {"b": '{"t":1}', "e": None, "gone": None, "a": None}
    with pytest.raises(ValueError):
        graph.neighbors(chain, "a", direction="up")


@BOTH
def test_traverse(spark, chain, local):
    walked = graph.traverse(chain, "a", 3, direction="out", local_edges=local)
    assert {r.id: r.depth for r in walked.nodes.collect()} == {"a": 0, "b": 1, "e": 1, "gone": 1, "c": 2, "d": 3}
    assert walked.edges.count() == 6 and not walked.truncated()
    assert {r.id: r.depth for r in graph.traverse(chain, "nowhere", 2, local_edges=local).nodes.collect()} == {"nowhere": 0}
    assert {r.id for r in graph.traverse(chain, "d", 2, "links_to", "in", local_edges=local).nodes.collect()} == {"d", "c", "b"}


@BOTH
def test_truncation(spark, local):
    hub = edges(spark, *[("ring", f"leaf{i}") for i in range(100)])
    cut = graph.traverse(hub, "ring", 2, max_nodes=10, local_edges=local)
    assert cut.truncated() and cut.nodes.count() == 10
    assert not graph.traverse(hub, "ring", 2, max_nodes=101, local_edges=local).truncated()


@BOTH
def test_paths(spark, chain, local):
    assert graph.shortest_path(chain, "a", "d", local_edges=local) == ["a", "b", "c", "d"]
    assert graph.shortest_path(chain, "a", "d", max_depth=2, local_edges=local) is None
    assert graph.shortest_path(chain, "d", "a", direction="out", local_edges=local) is None
    assert graph.shortest_path(chain, "q", "q", local_edges=local) == ["q"]
    diamond = edges(spark, ("s", "y"), ("s", "x"), ("x", "t"), ("y", "t"))
    assert graph.shortest_path(diamond, "s", "t", local_edges=local) == ["s", "x", "t"]


@BOTH
def test_weighted_paths(spark, local):
    w = edges(spark, ("s", "t", "r", {"weight": 100}), ("s", "a", "r", {"weight": 1}), ("a", "b", "r", {}), ("b", "t", "r", {"weight": None}), ("x", "y", "r", {"weight": -1}), ("p", "q", "r", {"weight": "heavy"}))
    assert graph.shortest_path_weighted(w, "s", "t", local_edges=local) == (["s", "a", "b", "t"], 3.0)
    assert graph.shortest_path(w, "s", "t", local_edges=local) == ["s", "t"]
    assert graph.shortest_path_weighted(w, "s", "x", local_edges=local) is None
    assert graph.shortest_path_weighted(w, "s", "s", local_edges=local) == (["s"], 0.0)
    for bad in (("x", "y"), ("p", "q")):
        with pytest.raises(ValueError):
            graph.shortest_path_weighted(w, *bad, local_edges=local)


def test_random_graph_agrees_both_ways(spark):
    rng = np.random.default_rng(3)
    rows = {(f"n{a}", f"n{b}") for a, b in rng.integers(0, 60, (90, 2))}
    e = edges(spark, *[(a, b, "r", {"weight": int(rng.integers(1, 9))}) for a, b in sorted(rows)])
    starts = spark.createDataFrame([("n1",), ("n2",), ("nx",)], "s string")
    adjacency = steps(e, None, "out")
    assert {tuple(r) for r in reach(adjacency, starts, 4).collect()} == {tuple(r) for r in reach(adjacency, starts, 4, local_edges=0).collect()}
    for f in (algorithms.connected_components, algorithms.pagerank):
        more = {"iterations": 4} if f is algorithms.pagerank else {}
        a, b = ({r[0]: r[1] for r in f(e, local_edges=x, **more).collect()} for x in (None, 0))
        assert a.keys() == b.keys()
        assert all(a[k] == pytest.approx(b[k], abs=1e-9) if f is algorithms.pagerank else a[k] == b[k] for k in a)
    for target in ("n5", "n17", "n33"):
        a, b = (graph.shortest_path_weighted(e, "n1", target, local_edges=x) for x in (None, 0))
        assert (a and a[1]) == (b and b[1])


def test_algorithms(spark):
    e = edges(spark, ("east", "ring"), ("west", "ring"), ("ring", "south"), ("l", "l"))
    assert {r.id: r.degree for r in algorithms.degree_centrality(e).collect()} == {"east": 1, "west": 1, "ring": 3, "south": 1, "l": 2}
    assert {r.id: r.degree for r in algorithms.degree_centrality(e, direction="in").collect()} == {"east": 0, "west": 0, "ring": 2, "south": 1, "l": 1}
    own = e.where("source_id <> 'l'")
    rank = {r.id: r.rank for r in algorithms.pagerank(own).collect()}
    assert rank == pytest.approx({"east": 0.125078174, "west": 0.125078174, "ring": 0.337711068, "south": 0.412132583}, abs=1e-8)
    assert {r.component for r in algorithms.connected_components(own).collect()} == {"east"}
    for f in (algorithms.pagerank, algorithms.connected_components, algorithms.degree_centrality):
        assert f(own, "no such relation").count() == 0


def test_graph_search(spark):
    records = spark.createDataFrame([("a", [1.0, 0.0], '{"k":1}'), ("b", [0.0, 1.0], '{"k":1}'), ("c", [-1.0, 0.0], '{"k":2}')], "id string, embedding array<float>, metadata string")
    e = edges(spark, ("a", "b", "near"), ("b", "c", "near"), ("a", "c", "other"), ("a", "dangling", "near"))
    got = {r.id: (r.via, r.hop_distance) for r in graph.graph_search(records, e, [1.0, 0.0], 1, 1, "near").collect()}
    assert got == {"a": ("vector", 0), "b": ("graph", 1)}
    got = {r.id: r.hop_distance for r in graph.graph_search(records, e, [1.0, 0.0], 1, 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1}
    got = {r.id for r in graph.graph_search(records, e, [1.0, 0.0], 1, 2, where={"k": 1}).collect()}
    assert got == {"a", "b"}
