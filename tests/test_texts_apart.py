"""Postings of a text are made where the text is, and texts aren't shuffled to meet vectors."""

from lodestar import catalog
from lodestar.operators import hybrid, keyword
from lodestar.queries import WORDS, _vector


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(keyword, "POSTED_ROWS", 2)
    texts = spark.createDataFrame([(1, "b a, b  c"), (2, "a"), (3, "..."), (4, None), (5, "B b"), (6, "ä 7 ä")], "id long, text string").repartition(8)
    index = keyword.postings(texts, stemmed=False)
    assert "hashpartitioning" not in _plan(index)
    got = {(r.term, r.id): (r.positions, r.doc_len) for r in index.collect()}
    assert got == {("b", 1): ([0, 2], 4), ("a", 1): ([1], 4), ("c", 1): ([3], 4), ("a", 2): ([0], 1), ("b", 5): ([0, 1], 2), ("ä", 6): ([0, 2], 3), ("7", 6): ([1], 3)}
    assert [f.dataType.simpleString() for f in index.schema] == ["string", "bigint", "array<int>", "int"]


def test_hybrid_of_separate_texts_as_of_joined_ones(spark, small):
    records, full, texts = catalog.records(spark, small), catalog.full_records(spark, small), catalog.texts(spark, small)
    for where in (None, {"label": 3}):
        one, two = (hybrid.search(r, _vector(records), WORDS, 10, where=where, stemmed=False, texts=t) for r, t in ((full, None), (records, texts)))
        assert [tuple(r) for r in one.collect()] == [tuple(r) for r in two.collect()]
    assert "text#" in _plan(full) and not any("Exchange" in x and "text#" in x for x in _plan(two).splitlines())
