import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions.distance import METRICS, distance, literal
from lodestar.operators import vector


def make(spark, n=60, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(f"d{i:02}", v.tolist(), json.dumps({"category": ["animals", "finance"][i % 2], "n": i})) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "id string, embedding array<float>, metadata string")


def brute(x, q, metric):
    x, q = x.astype(float), np.asarray(q, dtype=float)
    dot = x @ q
    return {"l2": ((x - q) ** 2).sum(1), "ip": 1 - dot, "cosine": 1 - dot / np.linalg.norm(x, axis=1) / np.linalg.norm(q)}[metric]


@pytest.mark.parametrize("metric", METRICS)
def test_top_k_is_exact(spark, metric):
    x, df = make(spark)
    q = np.random.default_rng(1).normal(size=8)
    got = vector.top_k(df, q, 7, metric=metric).collect()
    want = brute(x, q, metric)
    order = np.argsort(want, kind="stable")[:7]
    assert [r.id for r in got] == [f"d{i:02}" for i in order]
    assert np.allclose([r.score for r in got], want[order])
    assert [r.rank for r in got] == list(range(1, 8))


@pytest.mark.parametrize("metric", METRICS)
def test_column_distance_agrees(spark, metric):
    x, df = make(spark, 20)
    q = x[3] * 2
    got = {r.id: r.d for r in df.select("id", distance(F.col("embedding"), literal(q), metric).alias("d")).collect()}
    assert np.allclose([got[f"d{i:02}"] for i in range(20)], brute(x, q, metric), atol=1e-6)


def test_filters(spark):
    x, df = make(spark)
    for where in ({"category": "finance"}, "get_json_object(metadata, '$.category') = 'finance'", F.get_json_object("metadata", "$.category") == "finance", lambda m: m["category"] == "finance"):
        got = vector.top_k(df, x[0], 5, where=where).collect()
        assert len(got) == 5 and all(json.loads(r.metadata)["category"] == "finance" for r in got)
    assert vector.top_k(df, x[0], 5, where={}).count() == 5
    assert vector.top_k(df, x[0], 5, where={"n": "3"}).count() == 0
    assert vector.top_k(df, x[0], 5, where={"n": 3.0}).count() == 1
    assert vector.top_k(df, x[0], 50, where={"missing": None}).count() == 50


def test_post_filter_may_find_fewer(spark):
    x, df = make(spark)
    pre = vector.top_k(df, x[0], 40, where={"n": 59}).count()
    far = np.argsort(brute(x, x[0], "cosine"))[-1]
    assert pre == 1
    assert vector.top_k(df, x[0], 1, where={"n": int(far)}, mode="post").count() == 0
    assert vector.top_k(df, x[0], 1, where={"n": int(far)}).count() == 1


def test_errors_and_empty(spark):
    x, df = make(spark)
    with pytest.raises(Exception, match="components"):
        vector.top_k(df, [1.0, 2.0], 3).collect()
    with pytest.raises(ValueError):
        vector.top_k(df, x[0], 3, metric="hamming")
    assert vector.top_k(df.limit(0), x[0], 3).count() == 0
    nulls = spark.createDataFrame([("a", None, "{}")], df.schema)
    assert vector.top_k(nulls, x[0], 3).count() == 0
    assert vector.batch_top_k(df, df.limit(0), 3).count() == 0


@pytest.mark.parametrize("broadcast", [1 << 25, 0])
def test_batch(spark, broadcast):
    x, df = make(spark, 40)
    got = vector.batch_top_k(df, df, 3, broadcast_bytes=broadcast, exclude_self=True).collect()
    assert len(got) == 120
    for i in range(40):
        d = brute(x, x[i], "cosine")
        d[i] = 9
        mine = sorted((r.rank, r.id) for r in got if r.query_id == f"d{i:02}")
        assert [m[1] for m in mine] == [f"d{j:02}" for j in np.argsort(d, kind="stable")[:3]]


def test_near_duplicate_of_noise(spark):
    x, df = make(spark)
    noisy = x[2] + np.random.default_rng(5).normal(size=8) * 0.01
    got = vector.top_k(df, noisy / np.linalg.norm(noisy), 1).first()
    assert got.id == "d02" and got.score < 0.01
    twin = df.union(spark.createDataFrame([("zz", noisy.tolist(), "{}")], df.schema))
    assert [(r.id_a, r.id_b) for r in vector.near_pairs(twin, 0.01).collect()] == [("d02", "zz")]


def test_vectors_of_several_lengths_or_with_nulls_raise(spark):
    for bad in ([[1.0], [1.0, 2.0, 3.0]], [[1.0, None], [1.0, 2.0]]):
        rows = spark.createDataFrame([(str(i), v) for i, v in enumerate(bad)], "id string, embedding array<double>").coalesce(1)
        with pytest.raises(Exception, match="component"):
            vector.top_k(rows, [1.0, 2.0], 2).collect()
        with pytest.raises(Exception, match="component"):
            vector.near_pairs(rows, 0.5).collect()


@pytest.mark.parametrize("block_rows", [2, 1024])
def test_near_pairs_come_once(spark, block_rows, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK_ROWS", block_rows)
    rows = spark.createDataFrame([(f"v{i}", [float(i % 3), 1.0]) for i in range(9)], "id string, embedding array<double>")
    got = sorted((r.id_a, r.id_b) for r in vector.near_pairs(rows, 1e-6).collect())
    assert got == [(f"v{i}", f"v{j}") for i in range(9) for j in range(i + 1, 9) if i % 3 == j % 3]
