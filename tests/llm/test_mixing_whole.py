"""Mixing to a stated total, whichever sources run out."""

from lodestar.llm import mixing


def test_quotas_up_to_a_total_are_the_highest_quotients():
    weights, blocks = {"a": 5, "b": 3, "c": 3, "stray": 2, "none": 0}, {"a": 9, "b": 4, "c": 7, "stray": 1, "none": 3}
    names = ["a", "b", "c", "stray"]
    seats = sorted((-weights[s] / (2 * k + 1), s) for s in names for k in range(blocks[s]))
    for total in (0, 1, 5, 13, 20, 21, 1000):
        for shards in (1, 2, 8):
            house = min(total, len(seats))
            want = {s: [sum(x[1] == s for x in seats[: house * (i + 1) // shards]) for i in range(shards)] for s in names}
            assert mixing.quotas(weights, blocks, shards, total) == want


def test_a_stray_source_cuts_nothing_off(spark):
    rows = [(i, "w " * 50, "big" if i < 200 else "mid") for i in range(300)] + [(300, "w w w", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, block_tokens=100, keep=1.0).collect()
    assert sorted(r.doc_id for r in got) == list(range(301))
    part = mixing.mix_sources(docs, block_tokens=100, keep=0.5).select("source", "block").distinct().count()
    assert part == 76  # of 100 + 50 + 1
    few = mixing.mix_sources(docs.where("doc_id < 4"), block_tokens=100, keep=1.0).collect()
    assert sorted(r.doc_id for r in few) == [0, 1, 2, 3]  # 2 seats in 8 shards
