"""A language too rare for a sample over all labels together."""

import numpy as np
import pytest

from lodestar.llm import langid


def test_rare_language_is_a_class_with_its_true_prior(spark):
    rows = [(i, f"the house number {i} stands here", "en") for i in range(300)] + [(300 + i, f"dom nomer {i} stoit zdes", "xx") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, max_train_docs=3)
    assert model.languages == ["en", "xx"]
    assert np.exp(model.prior) == pytest.approx([300 / 303, 3 / 303])
    got = langid.identify(docs.where("lang = 'xx'"), model).collect()
    assert [r.detected for r in got] == ["xx"] * 3 and all(r.accepted for r in got)


def test_sample_is_the_lowest_hashes_of_each_label(spark):
    texts = {"en": [f"alpha{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)], "xx": [f"omega{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(9)]}
    docs = spark.createDataFrame([(i, t, lang) for lang, own in texts.items() for i, t in enumerate(own)], "doc_id long, text string, lang string")
    keys = docs.selectExpr("*", "xxhash64(doc_id, text) AS place").collect()
    kept = [r for lang in texts for r in sorted((r for r in keys if r.lang == lang), key=lambda r: r.place)[:12]]
    part = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in kept], docs.schema)
    assert (langid.train(docs, max_train_docs=12).log_prob == langid.train(part).log_prob).all()
