"""op2: what the line dedup shuffles, and its packed prefix index in many buckets."""

import random

import numpy as np
import pytest

from lodestar.llm import linededup
from lodestar.llm.tokens import mix64


def shuffled_rows(spark):
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    none = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}


def corpus(seed, docs, lines, width):
    rng = random.Random(seed)
    out, all_lines = [], []
    for _ in range(docs):
        own = []
        for _ in range(lines):
            parts = [f"w{rng.randrange(3000)}" for _ in range(width)]
            if all_lines and rng.random() < 0.05:
                parts = rng.choice(all_lines).split()
                parts[rng.randrange(len(parts))] = f"w{rng.randrange(3000)}"
            own.append(" ".join(parts))
        all_lines += own
        out.append("\n".join(own))
    return out


def test_shuffle_is_not_by_token(spark):
    texts = corpus(1, 200, 12, 40)
    before = shuffled_rows(spark)
    assert linededup.later_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    rows = sum(v for k, v in shuffled_rows(spark).items() if k not in before)
    assert rows < 5 * sum(t.count("\n") + 1 for t in texts)  # a row for each prefix token alone would make 9 a line


def test_many_buckets(spark, monkeypatch):
    texts = corpus(2, 40, 6, 12)
    lines = [(d, i, frozenset(x.split())) for d, t in enumerate(texts) for i, x in enumerate(t.split("\n"))]
    want = {}
    for n, (d, i, own) in enumerate(lines):
        for e, j, other in lines[:n]:
            if len(own & other) / len(own | other) >= 0.8 - 1e-12:
                want[d, i] = (e, j, pytest.approx(len(own & other) / len(own | other)))
                break
    for name, value in (("BUCKET_ROWS", 50), ("PREFIX_ROWS", 200), ("PLACE_BITS", 256)):  # few bits for places: most lines pass
        monkeypatch.setattr(linededup, name, value)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.line): (r.match_doc_id, r.match_line, r.jaccard) for r in linededup.later_lines(docs).collect()}
    assert want and got == want


def test_packed():
    noise = mix64(np.arange(1, 1001, dtype=np.uint64))
    for n in (1, 1000):
        columns = [(noise[:n] >> np.uint64(k)).astype(kind) for k, (_, kind) in enumerate(linededup.PACKED)]
        assert all((a == b).all() for a, b in zip(columns, linededup.unpack(linededup.pack(columns)), strict=True))
