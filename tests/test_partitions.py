"""Shuffles of large inputs begin with partitions enough; walks by joins don't part all edges from their like first."""

import pytest

from lodestar import session
from lodestar.operators import adjacency, graph
from lodestar.operators.adjacency import reach, steps

SCHEMA = "source_id string, target_id string, relation string, metadata string"


@pytest.fixture
def setting(spark):
    before = spark.conf.get(session._INITIAL, None)
    yield
    spark.conf.unset(session._INITIAL) if before is None else spark.conf.set(session._INITIAL, before)


def test_partitions_follow_the_input(spark, small, setting, monkeypatch):
    rows = spark.read.parquet(f"{small}/lineitem.parquet")
    held = session.source_bytes(rows)
    assert 0 < held and session.source_bytes(rows.union(rows)) == 2 * held
    assert session.source_bytes(spark.createDataFrame([("a",)], "x string")) < 1 << 20  # of unknown size
    monkeypatch.setattr(session, "PARTITION_BYTES", max(1, held // 50))
    session.part_finely(rows.groupBy("l_partkey").count())
    assert int(spark.conf.get(session._INITIAL)) >= 50
    session.part_finely(rows.limit(1))
    assert int(spark.conf.get(session._INITIAL)) >= 50


def test_walks_by_joins_write_their_edges_without_a_shuffle(spark, setting, monkeypatch):
    e = spark.createDataFrame([("a", "b", "r", "{}")] * 3 + [("b", "c", "r", "{}")] * 2 + [("c", "a", "s", "{}")], SCHEMA)
    seen = []
    real = adjacency.written

    def spy(df, label, *more):
        if label == "adjacency":
            seen.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label, *more)

    monkeypatch.setattr(adjacency, "written", spy)
    starts = spark.createDataFrame([("a",)], "s string")
    assert sorted(tuple(r) for r in reach(steps(e, "r", "out"), starts, None, local_edges=0).collect()) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2)]
    assert graph.shortest_path(e, "a", "c", "r", "out", local_edges=0) == ["a", "b", "c"] == graph.shortest_path(e, "a", "c", "r", "out")
    assert len(seen) == 2 and not any("Exchange" in x for x in seen)
