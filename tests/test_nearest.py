"""Batches of queries in blocks with running bounds, against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from lodestar.functions.distance import METRICS, Block, matrix_distance
from lodestar.operators import vector


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("exclude_self", [False, True])
def test_bounds_lose_nothing(metric, exclude_self):
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (90, 3)).astype(float) * 1e3  # many ties, some vectors of norm 0
    ids = pa.array([f"v{i % 80}" for i in range(90)])  # some ids twice
    near = vector._Nearest(ids, Block(x, metric), 4, exclude_self)
    for a in range(0, 90, 7):
        near.see(ids.slice(a, 7), Block(x[a : a + 7], metric))
    (got,) = near.found()
    want = matrix_distance(x, x, metric)
    for i in range(0, 80):
        rows = sorted((want[i, j], ids[j].as_py()) for j in range(90) if not (exclude_self and ids[j] == ids[i]))
        mine = sorted((s, j) for q, j, s in zip(*(c.to_pylist() for c in got.columns)) if q == f"v{i}")
        if i >= 10:  # an id of its own
            assert [m[1] for m in mine] == [r[1] for r in rows[:4]]
            assert np.allclose([m[0] for m in mine], [r[0] for r in rows[:4]], rtol=1e-12, atol=1e-11)


def test_a_task_keeps_k_whatever_ties():
    """Before, each batch gave every record that tied with the k-th."""
    ids = pa.array(range(300), pa.int64())
    block = Block(np.ones((300, 2)), "cosine")
    near = vector._Nearest(ids, block, 2, False)
    for a in range(0, 300, 100):
        near.see(ids.slice(a, 100), Block(block.vectors[a : a + 100], "cosine"))
    (got,) = near.found()
    assert got.num_rows == 600 and set(got.column(1).to_pylist()) == {0, 1}


def test_many_blocks_in_few_tasks(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 7), ("TASK_QUERY_BLOCKS", 2), ("TASK_BLOCKS", 3)):
        monkeypatch.setattr(vector, name, value)
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(100, 5)))], "id long, embedding array<double>")
    a, b = (sorted(tuple(r) for r in vector.batch_top_k(rows, rows.where("id % 3 = 0"), 4, metric="l2", broadcast_bytes=x).collect()) for x in (1 << 25, 0))
    assert a == b and len(a) == 34 * 4
