"""Queries over all rows of a folder, on tables where a part is easily left out."""

import inspect

import duckdb
import pytest

from lodestar import catalog
from lodestar.operators import graph
from lodestar.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def fewer_vectors(spark, small, tmp_path_factory):
    """All documents, but vectors for the first 50 of them and for 10 ids without a document."""
    folder = str(tmp_path_factory.mktemp("fewer"))
    spark.read.parquet(f"{small}/documents.parquet").write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id < 50 OR vec_id >= 490").write.parquet(f"{folder}/embeddings.parquet")
    return folder


KEYWORD = ["bm25_topk", "bm25_duplicate_terms", "bm25_index", "postings_terms", "hybrid_rrf", "hybrid_rrf_filtered"]


@pytest.mark.parametrize("name", KEYWORD)
def test_keyword_queries_over_texts_without_vector(spark, fewer_vectors, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{fewer_vectors}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, fewer_vectors)
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    rounded = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert rounded(tuple(r) for r in got.select(*names).collect()) == rounded(cursor.fetchall())


def test_stemmed_search_finds_texts_without_vector(spark, fewer_vectors):
    docs = spark.read.parquet(f"{fewer_vectors}/documents.parquet").where("text IS NOT NULL").count()
    assert catalog.texts(spark, fewer_vectors).count() == docs > 60
    assert any(int(r.id) >= 50 for r in QUERIES["bm25_stemmed"](spark, fewer_vectors).collect())


def test_hybrid_joins_texts_without_vector_and_vectors_without_text(spark, fewer_vectors):
    rows = {r.id: r for r in catalog.full_records(spark, fewer_vectors).collect()}
    assert rows["100"].text is not None and rows["100"].embedding is None
    assert rows["495"].text is None and rows["495"].embedding is not None


@pytest.fixture(scope="module")
def all_edges(spark, small):
    return [(r.source_id, r.target_id, r.relation) for r in catalog.edges(spark, small).collect()]


@pytest.mark.parametrize("name", ["connected_components", "connected_components_joined"])
def test_components_of_all_edges(spark, small, all_edges, name):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b, _ in all_edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a  # the least id stays on top
    got = {r.id: r.component for r in QUERIES[name](spark, small).collect()}
    assert got == {x: find(x) for x in root}
    assert {x[0] for x in got} == set("cnorsp")


def test_pagerank_of_all_edges(spark, small, all_edges):
    ids = sorted({x for a, b, _ in all_edges for x in (a, b)})
    outs = dict.fromkeys(ids, 0)
    for a, _, _ in all_edges:
        outs[a] += 1
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(50):
        loose = sum(rank[x] for x in ids if not outs[x])
        new = dict.fromkeys(ids, 0.15 / len(ids) + 0.85 * loose / len(ids))
        for a, b, _ in all_edges:
            new[b] += 0.85 * rank[a] / outs[a]
        change, rank = sum(abs(new[x] - rank[x]) for x in ids), new
        if change < 1e-8:
            break
    assert {r.id: r.rank for r in QUERIES["pagerank_all"](spark, small).collect()} == pytest.approx(rank, abs=2e-9)


def test_path_over_all_edges(spark, small, all_edges):
    path = [r.id for r in sorted(QUERIES["shortest_path"](spark, small).collect())]
    near = {}
    for a, b, _ in all_edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    level = {"c1": ["c1"]}
    while path[-1] not in level:
        level = {x: min([*p, x] for y, p in level.items() if x in near[y]) for x in {x for y in level for x in near[y]}}
    assert path == level[path[-1]] and len(path) > 2


@pytest.mark.parametrize("name", ["import_csv", "import_adjacency"])
def test_imports_hold_all_edges(spark, small, all_edges, name):
    got = QUERIES[name](spark, small).collect()
    assert sorted((r.source_id, r.target_id) for r in got) == sorted({(a, b) for a, b, _ in all_edges})
    assert {r.relation for r in got} == ({r if r != "in_region" else "related" for _, _, r in all_edges} if name == "import_csv" else {"linked"})


@pytest.mark.parametrize("local", [None, 0])
def test_traversal_without_limit(spark, local):
    hub = spark.createDataFrame([("hub", f"leaf{i}", "r", "{}") for i in range(1500)], "source_id string, target_id string, relation string, metadata string")
    walked = graph.traverse(hub, "hub", 2, max_nodes=None, local_edges=local)
    assert walked.nodes.count() == 1501 and walked.edges.count() == 1500 and not walked.truncated()


@pytest.mark.parametrize("name", ["traverse_nodes", "traverse_edges"])
def test_registered_traversals_have_no_limit(spark, small, name, monkeypatch):
    seen = []
    real = graph.traverse

    def spy(*args, **more):
        seen.append(inspect.signature(real).bind(*args, **more).arguments.get("max_nodes", 1000))
        return real(*args, **more)

    monkeypatch.setattr(graph, "traverse", spy)
    QUERIES[name](spark, small)
    assert seen == [None]
