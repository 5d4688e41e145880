"""The corpus pipeline: each stage's effect, and its whole on the smallest tables."""

import re

import duckdb
import pytest

import corpus_pipeline
from lodestar.llm import mixing, stages
from lodestar.llm.queries import ORACLE_SQL, QUERIES


def test_stages_in_order():
    assert [f for _, f in corpus_pipeline.STAGES] == [stages.language, stages.lines, stages.near_duplicates, stages.leaks, stages.mixture]


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


def test_run_is_its_stages_and_their_effects_hold(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = spark.createDataFrame(stage(spark, docs, small).toArrow())
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len({t for t in texts.values()}) == len(texts)  # exact copies are gone
    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    flat = {i: f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} " for i, t in texts.items()}
    for words in items:
        for a in range(len(words) - 9):
            assert not any(f" {' '.join(words[a : a + 10])} " in t for t in flat.values())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = sorted((r[0], r[2], r[3], r[4]) for r in con.execute(mixing.oracle()).fetchall())
    assert sorted((r.doc_id, r.n_tokens, r.block, r.shard) for r in last.collect()) == want
    got = corpus_pipeline.run(spark, small)
    assert sorted((r.doc_id, r.n_tokens, r.block, r.shard, r.text) for r in got.collect()) == sorted((r.doc_id, r.n_tokens, r.block, r.shard, r.text) for r in last.collect())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = QUERIES[name](spark, small)
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(cursor.fetchall())
