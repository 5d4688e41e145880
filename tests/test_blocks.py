"""PageRank and components on blocks of hashed nodes, against arrays on one machine; and that a large table is made once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import adjacency, algorithms, blocks

SCHEMA = "source_id string, target_id string, relation string, metadata string"


@pytest.fixture(scope="module")
def tangled(spark):
    """Parallel edges, loops, a hub on either side and nodes apart."""
    rng = np.random.default_rng(5)
    pairs = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 400, (500, 2))] + [("hub", f"n{i}") for i in range(60)] + [(f"m{i}", "sink") for i in range(60)] + [("n1", "n2")] * 3 + [("o", "o"), ("p", "q")]
    return spark.createDataFrame([(a, b, "r", "{}") for a, b in pairs], SCHEMA)


def _same(tangled):
    a, b = ({r[0]: r[1] for r in algorithms.pagerank(tangled, iterations=6, local_edges=x).collect()} for x in (None, 0))
    assert a == pytest.approx(b, abs=1e-12)
    a, b = (sorted(tuple(r) for r in algorithms.connected_components(tangled, local_edges=x).collect()) for x in (None, 0))
    assert a == b


@pytest.mark.parametrize("size", [1 << 20, 50])
def test_blocks_and_forests_of_any_size(tangled, monkeypatch, size):
    monkeypatch.setattr(blocks, "BLOCK_EDGES", size)
    monkeypatch.setattr(blocks, "FOREST_EDGES", size)
    monkeypatch.setattr(blocks, "NAMED", size)
    _same(tangled)


def test_ids_whose_hashes_meet(tangled, monkeypatch):
    real = blocks.hashed
    monkeypatch.setattr(blocks, "hashed", lambda x, seed: real(x, seed) if seed else F.pmod(real(x, 0), F.lit(100)))
    assert blocks.distinct_hashes(blocks.ends(tangled.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))).distinct()) == 1
    _same(tangled)


@pytest.mark.parametrize("name", ["pagerank", "connected_components"])
def test_edges_that_may_be_many_are_made_once(spark, monkeypatch, name):
    """Before, they were made to be counted, and again to be joined."""
    monkeypatch.setattr(adjacency, "SMALL_BYTES", -1)
    monkeypatch.setattr(adjacency, "LOCAL_EDGES", 3)
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(f"a{i}", f"b{i % 3}", "r", "{}") for i in range(20)], SCHEMA).mapInArrow(count, SCHEMA)
    assert getattr(algorithms, name)(rows).count() == 23
    assert made.value == 20
