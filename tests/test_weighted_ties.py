import json

import pytest

from lodestar.operators import graph


@pytest.mark.parametrize("local", [None, 0])
def test_ties_go_by_steps_then_by_order(spark, local):
    def edges(*rows):
        return spark.createDataFrame([(a, b, "r", json.dumps({"weight": w})) for a, b, w in rows], "source_id string, target_id string, relation string, metadata string")

    one = edges(("s", "z", 1), ("z", "a", 1), ("a", "t", 1), ("s", "b", 1), ("b", "c", 1), ("c", "t", 1))
    assert graph.shortest_path_weighted(one, "s", "t", local_edges=local) == (["s", "b", "c", "t"], 3.0)
    fewer = edges(("s", "a", 1), ("a", "b", 1), ("b", "t", 1), ("s", "z", 1), ("z", "t", 2))
    assert graph.shortest_path_weighted(fewer, "s", "t", local_edges=local) == (["s", "z", "t"], 3.0)
    zero = edges(("s", "a", 3), ("a", "t", 0), ("a", "b", 0), ("b", "t", 0), ("s", "y", 1), ("y", "t", 2))
    assert graph.shortest_path_weighted(zero, "s", "t", local_edges=local) == (["s", "a", "t"], 3.0)
