"""What is in one segment without repeats is read as it is; later segments are folded alone."""

import pytest

from lodestar.plans import pattern
from lodestar.sources import edges as csv_edges
from lodestar.store import Collection
from pyspark.sql import functions as F

EDGES = "source_id string, target_id string, relation string, metadata string"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def made(spark, tmp_path):
    return Collection(spark, str(tmp_path / "c"), dim=2)


def test_one_segment_is_not_folded(spark, made):
    made.add_edge_frame(spark.createDataFrame([("a", "b", "r", '{"w":1}'), ("a", "b", "r", '{"w":2}'), ("b", None, "r", "{}")], EDGES))
    made.add_frame(spark.createDataFrame([("a", [1.0, 0.0], None, ""), ("b", None, '{"k":1}', "x")], "id string, embedding array<float>, metadata string, text string"))
    assert "Exchange" not in _plan(made.edges) and "Exchange" not in _plan(made.records)
    assert {tuple(r) for r in made.edges.collect()} == {("a", "b", "r", '{"w":2}'), ("b", None, "r", "{}")}
    assert {(r.id, r.metadata, r.text) for r in made.records.collect()} == {("a", "{}", None), ("b", '{"k":1}', "x")}
    again = Collection(spark, made.path)
    assert again.edge_count() == 2 and again.count() == 2


def test_later_segments_win(spark, made):
    made.add_edge_frame(spark.createDataFrame([("a", "b", "r", "{}"), ("b", None, "r", "{}"), ("c", "d", "r", "{}"), ("e", "f", "r", "{}")], EDGES))
    made.add_edges([{"source": "a", "target": "b", "relation": "r", "metadata": {"w": 3}}, {"source": "a", "target": "b", "relation": "r", "metadata": {"w": 4}}, {"source": "x", "target": "y"}])
    made.add_edge_frame(spark.createDataFrame([("b", None, "r", '{"w":5}')], EDGES))
    made.delete("c")
    want = {("a", "b", "r", '{"w":4}'), ("b", None, "r", '{"w":5}'), ("e", "f", "r", "{}"), ("x", "y", "related", "{}")}
    got = [(r.source_id, r.target_id, r.relation, r.metadata.replace(" ", "")) for r in made.edges.collect()]
    assert set(got) == want and len(got) == 4
    made.add_edge("c", "d", "r")
    assert made.edge_count() == 5
    made.compact()
    assert made.edge_count() == 5 and "Exchange" not in _plan(made.edges)


def test_edges_added_one_by_one_may_repeat(made):
    made.add_edges([{"source": "a", "target": "b"}, {"source": "a", "target": "b", "metadata": {"w": 1}}])
    assert made.edge_count() == 1


@pytest.mark.parametrize("most", [1, 2, 3, 4, 5])
def test_capped_single_step_as_by_search(spark, most, monkeypatch):
    e = spark.createDataFrame([("a", x, "r", "{}") for x in "bcdabb"] + [("b", "a", "r", "{}"), ("z", "a", "r", "{}"), ("c", "a", "s", "{}")], EDGES)
    records = spark.createDataFrame([(x, "{}") for x in "aabcd"], "id string, metadata string")
    text = "MATCH (a)-[:r]->(b) RETURN a.id, b.id"
    want = (sorted(map(tuple, pattern.run(records, e, text, max_nodes=most).collect())), pattern.truncated(records, e, text, most))
    monkeypatch.setattr(pattern, "reach", None)  # before, all starts were searched from, twice
    found = pattern.run_capped(records, e, text, most)
    assert (sorted(map(tuple, found.rows.collect())), found.truncated) == want
    assert want[1] == (most < 4)


CELLS = ["1", "-0", "01", "+1", "1.", "1.5", ".5", "1e5", "12345678901234567890123", "true", "null", "nil", " 7 ", '"x"', '"x', "{", '{"a": [1, "b"]}', "[1]", "of c1", "-", "é\n\"q\"", "NaN", "\t[2]", "t", "a\\b"]


def test_cells_read_as_before(spark):
    rows = spark.createDataFrame([(c,) for c in CELLS], "cell string")
    text = F.to_json(F.struct(F.col("cell").alias("v")))
    before = F.when(F.try_parse_json("cell").isNotNull(), F.col("cell")).otherwise(F.regexp_extract(text, r'(?s)^\{"v":(.*)\}$', 1))
    assert [r.a for r in rows.select((csv_edges._value(F.col("cell")).eqNullSafe(before)).alias("a")).collect()] == [True] * len(CELLS)


def test_counts_of_an_import_read_the_file_once(spark, made, tmp_path):
    (tmp_path / "e.csv").write_text('source,target,note "n"\na,b,of\n,c,1\na,b,2\nd,,3\n')
    got = csv_edges.edges_from_csv(spark, str(tmp_path / "e.csv"), metadata_columns=['note "n"'])
    assert got.rows is not None and got.counts() == {"imported": 2, "skipped": 2}
    assert made.import_edges_csv(str(tmp_path / "e.csv")) == {"imported": 2, "skipped": 2}
