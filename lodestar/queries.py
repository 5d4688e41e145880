"""The engine's queries over the tables of a folder, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from .catalog import EDGES_SQL, RECORDS_SQL, TEXTS_SQL
from .functions.words import query_phrases
from .operators import algorithms, graph, hybrid, keyword, vector
from .operators.adjacency import reach, steps
from .plans import pattern
from .session import discard, new_path, part_finely, written
from .sources.bundle import concept_edges, read_bundle, write_bundle
from .store import Collection

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

QUERY_ID = "0"
NEAR = 0.6
WORDS = "thing nicht antion"
COSINE = "(1 - list_dot_product(a.embedding, b.embedding) / sqrt(list_dot_product(a.embedding, a.embedding) * list_dot_product(b.embedding, b.embedding)))"
L2 = "(list_distance(a.embedding, b.embedding) ** 2)"
IP = "(1 - list_dot_product(a.embedding, b.embedding))"  # may round to -0.0


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns or ("score",)})


def _vector(records: DataFrame, id_: str = QUERY_ID) -> list[float]:
    return list(records.where(F.col("id") == id_).select("embedding").first()[0])


# vectors


def _knn(metric: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        records = catalog.records(spark, sf_dir)
        return _rounded(vector.top_k(records.select("id", "embedding"), _vector(records), 10, metric=metric)).select("rank", "id", "score")

    return run


def _knn_sql(distance: str, where: str = "true", pool: int | None = None) -> str:
    if pool is not None:
        inner = f"SELECT * FROM (SELECT b.id, b.label, round({distance}, 12) AS score FROM records a, records b WHERE a.id = '{QUERY_ID}' ORDER BY score, b.id LIMIT {pool}) AS b WHERE {where}"
    else:
        inner = f"SELECT b.id, round({distance}, 12) AS score FROM records a, records b WHERE a.id = '{QUERY_ID}' AND {where}"
    return f"WITH {RECORDS_SQL}, hits AS ({inner}) SELECT CAST(row_number() OVER (ORDER BY score, id) AS INTEGER) AS rank, id, round(score, 6) + 0.0 AS score FROM hits ORDER BY score, id LIMIT 10"


for _name, _sql in (("cosine", COSINE), ("l2", L2), ("ip", IP)):
    QUERIES[f"knn_{_name}"] = _knn(_name)
    ORACLE_SQL[f"knn_{_name}"] = _knn_sql(_sql)


@query(_knn_sql(COSINE, "b.label = 3"))
def knn_filtered_pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = catalog.records(spark, sf_dir)
    return _rounded(vector.top_k(records, _vector(records), 10, where={"label": 3})).select("rank", "id", "score")


@query(_knn_sql(COSINE, "b.label = 3", pool=100))
def knn_filtered_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = catalog.records(spark, sf_dir)
    return _rounded(vector.top_k(records, _vector(records), 10, where={"label": 3}, mode="post")).select("rank", "id", "score")


@query(_knn_sql(COSINE, "b.label > 4"))
def knn_filtered_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = catalog.records(spark, sf_dir)
    return _rounded(vector.top_k(records, _vector(records), 10, where=F.get_json_object("metadata", "$.label").cast("int") > 4)).select("rank", "id", "score")


def _batch_sql(k: int, where: str) -> str:
    return f"""WITH {RECORDS_SQL}, scored AS (SELECT a.id AS query_id, b.id, round({COSINE}, 12) AS score FROM records a, records b WHERE {where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM scored)
SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= {k}"""


@query(_batch_sql(5, "true"))
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = catalog.records(spark, sf_dir)
    return _rounded(vector.batch_top_k(records, records, 5))


@query(_batch_sql(5, "true"))
def knn_batch_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = catalog.records(spark, sf_dir)
    return _rounded(vector.batch_top_k(records, records, 5, broadcast_bytes=0))


@query(_batch_sql(10, "a.id <> b.id"))
def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = catalog.records(spark, sf_dir)
    return _rounded(vector.recommend(records, records.select("id"), 10))


@query(f"WITH {RECORDS_SQL} SELECT a.id AS id_a, b.id AS id_b, round({COSINE}, 6) AS score FROM records a JOIN records b ON a.id < b.id WHERE round({COSINE}, 12) < {NEAR}")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(vector.near_pairs(catalog.records(spark, sf_dir), NEAR))


# the store: each query makes a collection in the shared folder and asks it


def _collection(spark: SparkSession, sf_dir: str, records: DataFrame | None = None, edges: DataFrame | None = None) -> Collection:
    made = Collection(spark, new_path(spark, "collection"), dim=64)
    if records is not None:
        made.add_frame(records)
    if edges is not None:
        made.add_edge_frame(edges)
    return made


def _labels(records: DataFrame) -> DataFrame:
    return records.select("id", F.get_json_object("metadata", "$.label").cast("bigint").alias("label"))


def _relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, metadata) with the quality of documents as the label."""
    return catalog.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.to_json(F.struct(F.col("quality").alias("label"))).alias("metadata"))


@query(f"WITH {RECORDS_SQL} SELECT id, CAST(label AS BIGINT) AS label FROM records WHERE id = '{QUERY_ID}'")
def record_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _collection(spark, sf_dir, catalog.records(spark, sf_dir)).get(QUERY_ID)
    return spark.createDataFrame([(found["id"], found["metadata"]["label"])], "id string, label bigint")


@query("SELECT count(*) AS n FROM embeddings")
def record_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(_collection(spark, sf_dir, catalog.records(spark, sf_dir)).count(),)], "n bigint")


@query(f"WITH {EDGES_SQL} SELECT count(*) AS n FROM edges")
def edge_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(_collection(spark, sf_dir, edges=catalog.edges(spark, sf_dir)).edge_count(),)], "n bigint")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each event, of which the last of a user counts."""
    rows = catalog.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.lit(None).cast("array<float>").alias("embedding"), F.to_json(F.struct("event_id", "event_type")).alias("metadata"), "event_id")
    made = _collection(spark, sf_dir)
    made.add_frame(rows, order="event_id")
    field = lambda n: F.get_json_object("metadata", f"$.{n}")
    return made.records.select(F.col("id").cast("bigint").alias("user_id"), field("event_id").cast("bigint").alias("event_id"), field("event_type").alias("event_type"))


@query("SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label AS BIGINT) AS label FROM embeddings WHERE label <> 3")
def collection_add_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors put, those of a label deleted."""
    records = catalog.records(spark, sf_dir)
    made = _collection(spark, sf_dir, records)
    made.delete_frame(_labels(records).where("label = 3"))
    return _labels(made.records)


@query("SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN label = 3 THEN 33 ELSE label END::BIGINT AS label, CASE WHEN label = 3 THEN NULL ELSE text END AS text FROM embeddings LEFT JOIN documents ON vec_id = doc_id WHERE vec_id <> 1")
def collection_readd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records deleted and put again lose the text they had; one that is deleted twice stays away."""
    full = catalog.full_records(spark, sf_dir).where("embedding IS NOT NULL")
    made = _collection(spark, sf_dir, full)
    again = catalog.records(spark, sf_dir).where(F.get_json_object("metadata", "$.label") == "3")
    made.delete_frame(again)
    made.delete("1")
    made.add_frame(again.where("id <> '1'").withColumn("metadata", F.lit('{"label": 33}')))
    made.delete("1")
    return made.records.select("id", F.get_json_object("metadata", "$.label").cast("bigint").alias("label"), "text")


@query("SELECT 'u' || user_id AS source_id, event_type AS target_id, 'did' AS relation, max_by(event_id, event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY ALL")
def collection_edges_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge for each event from its user to its kind, of which the last counts."""
    events = catalog.table(spark, sf_dir, "events")
    made = _collection(spark, sf_dir)
    made.add_edge_frame(events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_id"), F.col("event_type").alias("target_id"), F.lit("did").alias("relation"), F.to_json(F.struct("event_id", "value")).alias("metadata"), "event_id"), order="event_id")
    field = lambda n: F.get_json_object("metadata", f"$.{n}")
    return made.edges.select("source_id", "target_id", "relation", field("event_id").cast("bigint").alias("event_id"), field("value").cast("double").alias("value"))


_GONE = "gone AS (SELECT 'n' || n_nationkey AS id FROM nation WHERE n_regionkey = 1)"


@query(f"WITH {EDGES_SQL}, {_GONE} SELECT source_id, target_id, relation FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _collection(spark, sf_dir, edges=catalog.edges(spark, sf_dir))
    made.delete_frame(catalog.table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id")))
    return made.edges.select("source_id", "target_id", "relation")


@query(f"WITH {EDGES_SQL} SELECT source_id, target_id, relation FROM edges WHERE NOT (source_id = 'c1' AND relation = 'in_nation') AND NOT (source_id = 'n1' AND target_id = 'r1')")
def delete_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _collection(spark, sf_dir, edges=catalog.edges(spark, sf_dir))
    home = made.get_edges("c1", "in_nation", "out").first()
    made.delete_edge("c1", home.target_id, "in_nation")
    made.delete_edge("n1", "r1")
    return made.edges.select("source_id", "target_id", "relation")


@query(f"WITH {EDGES_SQL} SELECT source_id, target_id, relation FROM edges WHERE source_id = 'n1' OR target_id = 'n1'")
def get_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collection(spark, sf_dir, edges=catalog.edges(spark, sf_dir)).get_edges("n1").select("source_id", "target_id", "relation")


@query("SELECT CAST(vec_id AS VARCHAR) AS id, coalesce(l.quality, e.label)::BIGINT AS label FROM embeddings e LEFT JOIN labels l ON e.vec_id = l.doc_id")
def update_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _collection(spark, sf_dir, catalog.records(spark, sf_dir))
    made.update_metadata_frame(_relabelled(spark, sf_dir))
    return _labels(made.records)


@query("SELECT count(e.vec_id) AS kept, count(*) - count(e.vec_id) AS dropped, count(e.vec_id) AS n FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id")
def compact_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a vector go when a collection is compacted."""
    made = _collection(spark, sf_dir, catalog.full_records(spark, sf_dir))
    done = made.compact()
    return spark.createDataFrame([(done["kept"], done["dropped"], made.count())], "kept bigint, dropped bigint, n bigint")


# keywords


def _bm25_sql(text: str, k: int = 10, where: str = "true", name: str = "hits", texts: str = TEXTS_SQL) -> str:
    """Common table expressions up to `name` (id, score), for single words."""
    words: dict[str, int] = {}
    for (word,) in query_phrases(text):
        words[word] = words.get(word, 0) + 1
    terms = ", ".join(f"('{w}', {n})" for w, n in words.items())
    return f"""{texts},
tokens AS (SELECT id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS words FROM texts),
stats AS (SELECT count(*) AS n, avg(len(words)) AS avg_len FROM tokens),
terms(term, times) AS (VALUES {terms}),
tf AS (SELECT id, len(words) AS dl, term, times, len(list_filter(words, lambda w: w = term)) AS f FROM tokens, terms),
idf AS (SELECT term, greatest(1e-6, ln((max(n) - count(*) FILTER (f > 0) + 0.5) / (count(*) FILTER (f > 0) + 0.5))) AS idf FROM tf, stats GROUP BY term),
scored AS (SELECT id, -sum(times * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avg_len))) AS score FROM tf JOIN idf USING (term), stats WHERE f > 0 GROUP BY id),
{name} AS (SELECT id, score FROM scored WHERE {where} ORDER BY round(score, 12), id LIMIT {k})"""


@query(f"WITH {_bm25_sql(WORDS)} SELECT id, round(score, 6) AS score FROM hits")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(keyword.search(catalog.texts(spark, sf_dir), WORDS, 10, stemmed=False))


@query(f"WITH {_bm25_sql(WORDS + ' thing')} SELECT id, round(score, 6) AS score FROM hits")
def bm25_duplicate_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(keyword.search(catalog.texts(spark, sf_dir), WORDS + " thing", 10, stemmed=False))


@query(f"WITH {_bm25_sql(WORDS)} SELECT id, round(score, 6) AS score FROM hits")
def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = catalog.texts(spark, sf_dir)
    return _rounded(keyword.search_index(keyword.postings(texts, stemmed=False), keyword.corpus_stats(texts, stemmed=False), WORDS, 10, stemmed=False))


@query()
def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all texts.  Stems are beyond SQL; held against SQLite's full-text index in the tests."""
    return _rounded(keyword.search(catalog.texts(spark, sf_dir), WORDS, 10))


@query(f"WITH {TEXTS_SQL}, t AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM texts) SELECT term, count(DISTINCT id) AS n_docs, count(*) AS n FROM t GROUP BY term")
def postings_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = keyword.postings(catalog.texts(spark, sf_dir), stemmed=False)
    return index.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum(F.size("positions")).cast("bigint").alias("n"))


def _hybrid_sql(label: int | None = None, texts: str = TEXTS_SQL) -> str:
    allowed = "true" if label is None else f"id IN (SELECT id FROM records WHERE label = {label})"
    return f"""WITH {RECORDS_SQL}, {_bm25_sql(WORDS, 50, allowed, texts=texts)},
kw AS (SELECT id, row_number() OVER (ORDER BY round(score, 12), id) AS r FROM hits),
near AS (SELECT b.id, round({COSINE}, 12) AS score FROM records a, records b WHERE a.id = '{QUERY_ID}' AND {"true" if label is None else f"b.label = {label}"}),
vec AS (SELECT id, row_number() OVER (ORDER BY score, id) AS r FROM near ORDER BY score, id LIMIT 50),
fused AS (SELECT coalesce(vec.id, kw.id) AS id, coalesce(1.0::DOUBLE / (60 + vec.r), 0) + coalesce(1.0::DOUBLE / (60 + kw.r), 0) AS score, vec.r AS vr, kw.r AS kr FROM vec FULL JOIN kw ON vec.id = kw.id)
SELECT CAST(row_number() OVER (ORDER BY score DESC, vr NULLS LAST, kr NULLS LAST, id) AS INTEGER) AS rank, id, round(score, 6) AS score FROM fused ORDER BY score DESC, vr NULLS LAST, kr NULLS LAST, id LIMIT 10"""


def _hybrid(spark: SparkSession, sf_dir: str, where) -> DataFrame:
    records = catalog.records(spark, sf_dir)
    return _rounded(hybrid.search(records, _vector(records), WORDS, 10, where=where, stemmed=False, texts=catalog.texts(spark, sf_dir))).select("rank", "id", "score")


@query(_hybrid_sql())
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, None)


@query(_hybrid_sql(3))
def hybrid_rrf_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, {"label": 3})


# graph

_SUPPLIER = "s1"
_BOTH = "both_ways AS (SELECT source_id AS src, target_id AS dst, relation, weight FROM edges UNION ALL SELECT target_id, source_id, relation, weight FROM edges)"


def _neighbors_sql(node: str, direction: str) -> str:
    out = f"SELECT target_id AS id, relation, 'out' AS direction FROM edges WHERE source_id = '{node}'"
    back = f"SELECT source_id AS id, relation, 'in' AS direction FROM edges WHERE target_id = '{node}'" + (f" AND source_id <> '{node}'" if direction == "both" else "")
    return f"WITH {EDGES_SQL} SELECT DISTINCT * FROM ({ {'out': out, 'in': back}.get(direction, f'{out} UNION ALL {back}') })"


def _neighbors(node: str, direction: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return graph.neighbors(catalog.edges(spark, sf_dir), node, None, direction).select("id", "relation", "direction")

    return run


for _direction, _node in (("out", "c1"), ("in", "n1"), ("both", "n1")):
    QUERIES[f"neighbors_{_direction}"] = _neighbors(_node, _direction)
    ORACLE_SQL[f"neighbors_{_direction}"] = _neighbors_sql(_node, _direction)


@query(f"WITH {EDGES_SQL} SELECT e.source_id AS id, e.relation, 'in' AS direction, c.c_mktsegment AS segment FROM edges e LEFT JOIN customer c ON e.source_id = 'c' || c.c_custkey WHERE e.target_id = 'n1'")
def neighbors_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.neighbors(catalog.edges(spark, sf_dir), "n1", None, "in", records=catalog.nodes(spark, sf_dir))
    return found.select("id", "relation", "direction", F.get_json_object("metadata", "$.segment").alias("segment"))


_REACHED = f"WITH RECURSIVE {EDGES_SQL}, {_BOTH}, walked AS (SELECT '{_SUPPLIER}' AS id, 0 AS depth UNION SELECT b.dst, w.depth + 1 FROM walked w JOIN both_ways b ON b.src = w.id AND b.relation = 'supplies' WHERE w.depth < {{0}}), reached AS (SELECT id, min(depth) AS depth FROM walked GROUP BY id)"


@query(_REACHED.format(3) + " SELECT id, CAST(depth AS INTEGER) AS depth FROM reached")
def traverse_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.traverse(catalog.edges(spark, sf_dir), _SUPPLIER, 3, "supplies", "both", None).nodes


@query(_REACHED.format(2) + " SELECT DISTINCT source_id, target_id, relation FROM edges JOIN (SELECT id FROM reached WHERE depth < 2) ON id IN (source_id, target_id) WHERE relation = 'supplies'")
def traverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.traverse(catalog.edges(spark, sf_dir), _SUPPLIER, 2, "supplies", "both", None).edges


@query(_REACHED.format(3) + " SELECT count(*) > 1000 AS truncated, least(count(*), 1000) AS n FROM reached")
def traverse_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = graph.traverse(catalog.edges(spark, sf_dir), _SUPPLIER, 3, "supplies", "both")
    return spark.createDataFrame([(walked.truncated(), walked.nodes.count())], "truncated boolean, n bigint")


@query(_REACHED.format(2).replace("supplies", "in_nation").replace(f"'{_SUPPLIER}'", "'n1'").replace("dst, w.depth", "dst, w.depth") + " SELECT 'n1' AS start, id AS node, CAST(depth AS INTEGER) AS depth FROM reached")
def reach_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breadth-first search by joins, as for graphs too large to be broadcast."""
    starts = spark.createDataFrame([("n1",)], "start string")
    return reach(steps(catalog.edges(spark, sf_dir), "in_nation", "both"), starts, 2, local_edges=0)


@query(f"""WITH RECURSIVE {EDGES_SQL}, {_BOTH},
far AS (SELECT min('c' || f.c_custkey) AS id FROM customer f JOIN nation g ON f.c_nationkey = g.n_nationkey, customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_custkey = 1 AND g.n_regionkey = n.n_regionkey AND g.n_nationkey <> n.n_nationkey),
back AS (SELECT id, 0 AS depth FROM far UNION SELECT src, depth + 1 FROM back JOIN both_ways ON dst = back.id WHERE depth < 10 AND NOT EXISTS (SELECT 1 FROM back WHERE id = 'c1')),
togo AS MATERIALIZED (SELECT id, min(depth) AS depth FROM back GROUP BY id),
path AS (SELECT 0 AS step, 'c1' AS id, depth FROM togo WHERE id = 'c1' UNION ALL SELECT any_value(p.step) + 1, min(t.id), any_value(t.depth) FROM path p JOIN both_ways b ON b.src = p.id JOIN togo t ON t.id = b.dst AND t.depth = p.depth - 1 HAVING count(*) > 0)
SELECT CAST(step AS INTEGER) AS step, id FROM path""")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From customer 1 to the first customer of another nation of its region, over all edges."""
    return _path_to_far(spark, sf_dir, catalog.edges(spark, sf_dir))


def _path_to_far(spark: SparkSession, sf_dir: str, edges: DataFrame) -> DataFrame:
    homes = catalog.table(spark, sf_dir, "customer").join(catalog.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    own = homes.where("c_custkey = 1").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"))
    far = homes.join(F.broadcast(own), (F.col("n_regionkey") == F.col("region")) & (F.col("n_nationkey") != F.col("nation"))).agg(F.min(F.concat(F.lit("c"), F.col("c_custkey").cast("string")))).first()[0]
    path = graph.shortest_path(edges, "c1", far, None, "both") or []
    return spark.createDataFrame(list(enumerate(path)), "step int, id string")


@query(f"""WITH RECURSIVE {EDGES_SQL}, {_BOTH},
near AS (SELECT 0 AS hops, 's1' AS id, 0.0::DOUBLE AS total UNION ALL SELECT n.hops + 1, b.dst, min(n.total + b.weight) FROM near n JOIN both_ways b ON b.src = n.id AND b.relation = 'supplies' WHERE n.hops < 12 GROUP BY n.hops + 1, b.dst),
best AS MATERIALIZED (SELECT id, min(total) AS total FROM near GROUP BY id),
tight AS MATERIALIZED (SELECT DISTINCT x.id AS src, y.id AS dst FROM both_ways b JOIN best x ON b.src = x.id JOIN best y ON b.dst = y.id WHERE b.relation = 'supplies' AND x.total + b.weight = y.total),
paths AS (SELECT ['s1'] AS path UNION ALL SELECT list_append(path, dst) FROM paths JOIN tight ON src = path[-1] JOIN best ON best.id = dst WHERE best.total <= (SELECT total FROM best WHERE id = 's2')),
first AS (SELECT path FROM paths WHERE path[-1] = 's2' ORDER BY len(path), path LIMIT 1)
SELECT CAST(unnest(range(len(path))) AS INTEGER) AS step, unnest(path) AS id, (SELECT total FROM best WHERE id = 's2') AS total_weight FROM first""")
def shortest_path_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, total = graph.shortest_path_weighted(catalog.edges(spark, sf_dir), "s1", "s2", "supplies", "both") or ([], 0.0)
    return spark.createDataFrame([(i, x, total) for i, x in enumerate(path)], "step int, id string, total_weight double")


@query(f"""WITH {RECORDS_SQL},
edges AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, CAST(first AS VARCHAR) AS target_id FROM documents JOIN (SELECT source, lang, min(doc_id) AS first FROM documents GROUP BY ALL) USING (source, lang) WHERE doc_id <> first),
ways AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges),
hits AS (SELECT b.id, round({COSINE}, 12) AS score FROM records a, records b WHERE a.id = '{QUERY_ID}' ORDER BY score, b.id LIMIT 10),
one AS (SELECT DISTINCT b AS id FROM ways JOIN hits ON a = id),
two AS (SELECT DISTINCT b AS id FROM ways JOIN one ON a = id)
SELECT id, round(score, 6) AS score, 'vector' AS via, 0 AS hop_distance FROM hits
UNION ALL SELECT id, NULL, 'graph', CASE WHEN id IN (SELECT id FROM one) THEN 1 ELSE 2 END FROM (SELECT id FROM one UNION SELECT id FROM two) WHERE id NOT IN (SELECT id FROM hits) AND id IN (SELECT id FROM records)""")
def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document has an edge to the first one of its source and language."""
    records = catalog.records(spark, sf_dir)
    docs = catalog.table(spark, sf_dir, "documents")
    firsts = docs.groupBy("source", "lang").agg(F.min("doc_id").alias("first"))
    edges = docs.join(firsts, ["source", "lang"]).where("doc_id <> first").select(F.col("doc_id").cast("string").alias("source_id"), F.col("first").cast("string").alias("target_id"), F.lit("like").alias("relation"), F.lit("{}").alias("metadata"))
    return _rounded(graph.graph_search(records, edges, _vector(records), 10, 2, "like")).select("id", "score", "via", "hop_distance")


# patterns


def _pattern(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pattern.run(catalog.nodes(spark, sf_dir), catalog.edges(spark, sf_dir), text)

    return run


_PATTERNS = {
    "mq_single_hop": (
        'MATCH (a)-[:in_nation]->(b) WHERE b.name = "NATION_3" RETURN a.id, b.id, a.segment',
        "SELECT 'c' || c_custkey AS a_id, 'n' || c_nationkey AS b_id, c_mktsegment AS a_segment FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'",
    ),
    "mq_full_scan": ("MATCH (a)-[:placed]->(b) RETURN a.id, b.id", "SELECT DISTINCT 'c' || o_custkey AS a_id, 'o' || o_orderkey AS b_id FROM orders"),
    "mq_any_relation": (
        'MATCH (a)-[]->(b) WHERE a.id = "c1" OR a.id = "c2" RETURN a.id, b.id',
        f"WITH {EDGES_SQL} SELECT DISTINCT source_id AS a_id, target_id AS b_id FROM edges WHERE source_id IN ('c1', 'c2')",
    ),
    "mq_varlen": (
        "MATCH (a)-[*1..2]->(b) WHERE a.type = customer RETURN a.id, b.id",
        f"WITH {EDGES_SQL}, one AS (SELECT source_id AS a_id, target_id AS b_id FROM edges WHERE source_id LIKE 'c%') SELECT a_id, b_id FROM one UNION SELECT a_id, target_id FROM one JOIN edges ON source_id = b_id",
    ),
    "mq_or": (
        'MATCH (a)-[:in_nation]->(b) WHERE b.id = "n1" AND a.segment = "BUILDING" OR b.id = "n2" AND a.segment = "MACHINERY" RETURN a.id, b.id',
        "SELECT 'c' || c_custkey AS a_id, 'n' || c_nationkey AS b_id FROM customer WHERE c_nationkey = 1 AND c_mktsegment = 'BUILDING' OR c_nationkey = 2 AND c_mktsegment = 'MACHINERY'",
    ),
    "mq_range": (
        "MATCH (a)-[:placed]->(b) WHERE b.price > 100000 AND b.price <= 200000 RETURN b.id, b.status",
        "SELECT 'o' || o_orderkey AS b_id, o_orderstatus AS b_status FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 200000",
    ),
    "mq_neq": (
        'MATCH (a)-[:placed]->(b) WHERE b.status != "F" AND a.segment = "BUILDING" RETURN a.id, b.id, b.status',
        "SELECT 'c' || o_custkey AS a_id, 'o' || o_orderkey AS b_id, o_orderstatus AS b_status FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F' AND c_mktsegment = 'BUILDING'",
    ),
    "mq_order_limit": (
        "MATCH (a)-[:supplies]->(b) WHERE b.size >= 40 RETURN a.id, b.id, b.size ORDER BY b.size DESC LIMIT 20",
        f"WITH {EDGES_SQL} SELECT source_id AS a_id, target_id AS b_id, CAST(p_size AS VARCHAR) AS b_size FROM edges JOIN part ON target_id = 'p' || p_partkey WHERE p_size >= 40 ORDER BY p_size DESC, source_id, target_id LIMIT 20",
    ),
}
for _name, (_text, _sql) in _PATTERNS.items():
    QUERIES[_name] = _pattern(_text)
    ORACLE_SQL[_name] = _sql


@query("SELECT 'n' || n_nationkey AS id, n_name AS name FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey IN (1, 2)")
def mq_return_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _pattern('MATCH (a)-[:in_nation]->(b) WHERE a.id = "c1" OR a.id = "c2" RETURN b')(spark, sf_dir)
    return found.select("b.id", F.get_json_object("b.metadata", "$.name").alias("name"))


@query(f"""WITH {EDGES_SQL}, pairs AS (SELECT DISTINCT source_id AS a_id, target_id AS b_id FROM edges WHERE relation = 'supplies'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY b_id) AS place, count(*) OVER (PARTITION BY a_id) AS held FROM pairs)
SELECT a_id, b_id, (SELECT bool_or(held + 1 > 40) FROM ranked) AS truncated FROM ranked WHERE place <= 39""")
def mq_max_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty nodes of each supplier, itself counted."""
    made = _collection(spark, sf_dir, catalog.nodes(spark, sf_dir).withColumn("embedding", F.lit(None).cast("array<float>")), catalog.edges(spark, sf_dir))
    found = made.run_query("MATCH (a)-[:supplies]->(b) RETURN a.id, b.id", 40)
    return found.rows.withColumn("truncated", F.lit(found.truncated))


# algorithms


def _degree_sql(out: int, back: int) -> str:
    return f"WITH {EDGES_SQL} SELECT id, CAST(sum(n) AS BIGINT) AS degree FROM (SELECT source_id AS id, {out} AS n FROM edges UNION ALL SELECT target_id, {back} FROM edges) GROUP BY id"


def _degree(direction: str) -> Query:
    return lambda spark, sf_dir: algorithms.degree_centrality(catalog.edges(spark, sf_dir), None, direction)


for _direction, _weights in (("both", (1, 1)), ("out", (1, 0)), ("in", (0, 1))):
    QUERIES[f"degree_{_direction}"] = _degree(_direction)
    ORACLE_SQL[f"degree_{_direction}"] = _degree_sql(*_weights)

_COMPONENTS = f"""WITH RECURSIVE {EDGES_SQL}, {_BOTH},
ways AS MATERIALIZED (SELECT DISTINCT src, dst FROM both_ways),
least AS (
  SELECT 0 AS i, id, id AS component FROM (SELECT DISTINCT src AS id FROM ways)
  UNION ALL
  SELECT i + 1, id, min(component) FROM (SELECT i, dst AS id, component FROM least JOIN ways ON src = id UNION ALL SELECT i, id, component FROM least) WHERE i < 12 GROUP BY i, id)
SELECT id, component FROM least WHERE i = 12"""  # no two nodes of these graphs are further apart


@query(_COMPONENTS)
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algorithms.connected_components(catalog.edges(spark, sf_dir))


@query(_COMPONENTS)
def connected_components_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By joins, as for graphs too large for one machine."""
    return algorithms.connected_components(catalog.edges(spark, sf_dir), local_edges=0)


_PAGERANK = f"""WITH RECURSIVE {EDGES_SQL},
e AS MATERIALIZED (SELECT source_id AS src, target_id AS dst FROM edges WHERE relation = 'supplies'),
nodes AS MATERIALIZED (SELECT id, count(src) AS outs FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) LEFT JOIN e ON src = id GROUP BY id),
size AS (SELECT count(*)::DOUBLE AS n FROM nodes),
steps AS (
  SELECT 0 AS i, id, 1 / n AS rank FROM nodes, size
  UNION ALL
  SELECT any_value(i) + 1, id, 0.15 / any_value(n) + 0.85 * (sum(part) + any_value(loose) / any_value(n)) FROM (
    SELECT s.i, e.dst AS id, s.rank / o.outs AS part, (SELECT coalesce(sum(x.rank), 0) FROM steps x JOIN nodes y ON x.id = y.id WHERE y.outs = 0) AS loose FROM steps s JOIN e ON e.src = s.id JOIN nodes o ON o.id = s.id
    UNION ALL SELECT s.i, s.id, 0, (SELECT coalesce(sum(x.rank), 0) FROM steps x JOIN nodes y ON x.id = y.id WHERE y.outs = 0) FROM steps s), size
  WHERE i < 10 GROUP BY id)
SELECT id, round(rank, 9) AS rank FROM steps WHERE i = 10"""
_PAGERANK_ALL = (
    _PAGERANK.replace("WHERE relation = 'supplies'", "").replace("i < 10", "i < 50").rsplit("\nSELECT", 1)[0]
    + """,
changes AS (SELECT a.i, sum(abs(a.rank - b.rank)) AS change FROM steps a JOIN steps b ON a.id = b.id AND a.i = b.i + 1 GROUP BY a.i)
SELECT id, round(rank, 9) AS rank FROM steps WHERE i = (SELECT coalesce(min(i) FILTER (change < 1e-8), 50) FROM changes)"""
)


@query(_PAGERANK_ALL)
def pagerank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the operator's own rounds and tolerance."""
    return algorithms.pagerank(catalog.edges(spark, sf_dir)).withColumn("rank", F.round("rank", 9))


@query(_PAGERANK)
def pagerank_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algorithms.pagerank(catalog.edges(spark, sf_dir), "supplies", iterations=10, tol=0.0).withColumn("rank", F.round("rank", 9))


@query(_PAGERANK)
def pagerank_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By joins, as for graphs too large for one machine."""
    return algorithms.pagerank(catalog.edges(spark, sf_dir), "supplies", iterations=10, tol=0.0, local_edges=0).withColumn("rank", F.round("rank", 9))


# sources


@query(f"WITH {EDGES_SQL} SELECT source_id, target_id, CASE WHEN relation = 'in_region' THEN 'related' ELSE relation END AS relation, weight, 'of ' || source_id AS note FROM edges")
def import_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges, written as CSV twice, the second time with what counts, and imported; blank cells, rows without an end and text among the metadata."""
    path = new_path(spark, "csv")
    edges = catalog.edges(spark, sf_dir)
    part_finely(edges)
    edges = written(edges, "edges")
    rows = edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.when(F.col("relation") != "in_region", F.col("relation")).alias("kind"), F.get_json_object("metadata", "$.weight").alias("weight"), F.concat(F.lit("of "), "source_id").alias("note"))
    earlier = rows.withColumns({"weight": F.lit("0"), "note": F.lit("earlier")})
    broken = rows.limit(1).withColumn("target", F.lit(None).cast("string"))
    # files are named in the order of the turns; in one turn no edge repeats
    for turn, some in enumerate((earlier, rows, broken)):
        some.write.option("header", True).csv(f"{path}/turn={turn}")
    discard(edges)
    made = _collection(spark, sf_dir)
    made.import_edges_csv(path, relation_column="kind", metadata_columns=["weight", "note"])
    return made.edges.select("source_id", "target_id", "relation", F.get_json_object("metadata", "$.weight").cast("double").alias("weight"), F.get_json_object("metadata", "$.note").alias("note"))


@query(f"WITH {EDGES_SQL} SELECT DISTINCT source_id, target_id, 'linked' AS relation FROM edges")
def import_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets of all edges by source, written as an adjacency list and imported."""
    path = new_path(spark, "adjacency")
    # a hub's targets are parted among lines
    part = F.pmod(F.xxhash64("target_id"), F.lit(16))
    catalog.edges(spark, sf_dir).groupBy("source_id", part.alias("part")).agg(F.array_join(F.collect_set("target_id"), " ").alias("all")).select(F.concat_ws(" ", "source_id", "all")).write.text(path)
    made = _collection(spark, sf_dir)
    made.import_adjacency_list(path, "linked")
    return made.edges.select("source_id", "target_id", "relation")


def _bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle of a concept for each nation, with a link to its region's."""
    import atexit
    import shutil
    import tempfile

    folder = tempfile.mkdtemp(prefix="lodestar-bundle-")  # local like the session's driver, which writes and lists it
    atexit.register(shutil.rmtree, folder, True)
    nations = catalog.table(spark, sf_dir, "nation").select(F.concat(F.lit("nations/n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("title"), F.concat(F.lit("See [region](/regions/r"), F.col("n_regionkey").cast("string"), F.lit(".md).")).alias("text"))
    regions = catalog.table(spark, sf_dir, "region").select(F.concat(F.lit("regions/r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("title"), F.lit("A region.").alias("text"))
    write_bundle(nations.union(regions), folder)
    return read_bundle(spark, folder)


@query("SELECT 'nations/n' || n_nationkey AS concept_id, n_name AS title, 'Document' AS type FROM nation UNION ALL SELECT 'regions/r' || r_regionkey, r_name, 'Document' FROM region")
def bundle_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bundle(spark, sf_dir).select("concept_id", "title", "type")


@query("SELECT 'nations/n' || n_nationkey AS source_id, 'regions/r' || n_regionkey AS target_id, 'references' AS relation FROM nation")
def bundle_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concept_edges(_bundle(spark, sf_dir)).select("source_id", "target_id", "relation")
