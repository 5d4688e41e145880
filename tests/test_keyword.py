import sqlite3

import pytest

from lodestar.functions.words import query_phrases, stem
from lodestar.operators import hybrid, keyword

TEXTS = {"a": "the quick brown foxes running", "b": "fox runs and runs over sku_4471 x", "c": "lazy dog", "d": "the dog sat on the mat with the cat and the dog", "e": "SKU-4471-X naïve café"}


@pytest.fixture(scope="module")
def sqlite():
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, text, tokenize='porter unicode61')")
    db.executemany("INSERT INTO t VALUES (?, ?)", TEXTS.items())
    return db


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([*TEXTS.items(), ("n", None)], "id string, text string")


@pytest.mark.parametrize("query", ["fox", "run", "fox fox", "sku_4471", "sku 4471", "cafe", "dog cat", "running dogs", "nothing"])
def test_bm25_is_that_of_sqlite(spark, texts, sqlite, query):
    match = " OR ".join('"' + " ".join(p) + '"' for p in query_phrases(query))
    want = sqlite.execute("SELECT id, rank FROM t WHERE t MATCH ? ORDER BY rank, id", (match,)).fetchall()
    for got in (keyword.search(texts, query, 10), keyword.search_index(keyword.postings(texts), keyword.corpus_stats(texts), query, 10)):
        rows = [(r.id, r.score) for r in got.collect()]
        assert [r[0] for r in rows] == [w[0] for w in want]
        assert [r[1] for r in rows] == pytest.approx([w[1] for w in want], abs=1e-9)


def test_query_without_words(spark, texts):
    assert keyword.search(texts, "-- !", 5).count() == 0


def test_stems_are_those_of_sqlite(sqlite):
    words = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll generalizations oscillators archaeology".split()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE w USING fts5(word, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(w, instance)")
    db.executemany("INSERT INTO w(rowid, word) VALUES (?, ?)", list(enumerate(words, 1)))
    want = {words[doc - 1]: term for term, doc in db.execute("SELECT term, doc FROM v")}
    assert {w: stem(w) for w in words} == want


def test_fusion(spark):
    a = spark.createDataFrame([("x", 0.1), ("y", 0.2)], "id string, score double")
    b = spark.createDataFrame([("y", -3.0), ("z", -2.0)], "id string, score double")
    got = hybrid.fuse(a, b).collect()
    assert [r.id for r in got] == ["y", "x", "z"]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61)


def test_hybrid_filter(spark):
    rows = [("h1", [1.0, 0.0], '{"k":1}', "a grey heron waits"), ("h2", [0.0, 1.0], '{"k":2}', "SKU-4471-X is out of stock"), ("h3", [0.5, 0.5], '{"k":2}', None)]
    records = spark.createDataFrame(rows, "id string, embedding array<float>, metadata string, text string")
    assert hybrid.search(records, [0.0, 1.0], "SKU-4471-X", 3).first().id == "h2"
    assert {r.id for r in hybrid.search(records, [0.0, 1.0], "fox", 3, where={"k": 2}).collect()} == {"h2", "h3"}


def test_stems_of_long_words():
    from lodestar.functions.words import stem

    assert stem("internationalizations") == stem("internationalization")
