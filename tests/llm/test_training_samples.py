"""Training samples of any shape, and scores by the model's definition."""

import math
import re
import zlib

import numpy as np
import pytest

from codeloom.llm import toxicity

from .conftest import prose

LABELS = "doc_id long, quality int, toxic int"


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame([(i, 1, y) for i, _, y in rows], LABELS)


def test_batches_without_words(spark):
    rows = [(i, "" if i % 2 else "12 34 !!", i % 3 == 0) for i in range(60)]
    out = toxicity.toxicity(*frames(spark, [(i, t, int(y)) for i, t, y in rows]), toxicity.ToxicRules(batch=8, epochs=2)).collect()
    assert len(out) == 60 and len({r.score for r in out}) == 1 and 0 < out[0].score < 1


def test_some_batches_without_words():
    texts, labels = ["", "bad word", "1 2", "good text"] * 8, [0, 1, 0, 0] * 8
    m = toxicity.train(list(texts), labels, toxicity.ToxicRules(batch=1, epochs=3))
    assert np.isfinite(m.scores).all() and math.isfinite(m.bias)


@pytest.mark.parametrize("bound", [500, 20_000])
def test_a_text_over_the_bound_is_passed_over(spark, bound):
    rows = [(i, prose(i, 12) if i % 7 else prose(i, 4000), i % 2) for i in range(80)]
    docs, labels = frames(spark, rows)
    texts, ys = toxicity.sample(docs, labels, toxicity.ToxicRules(train_chars=bound), "doc_id", "text")
    of = {t: (i, y) for i, t, y in rows}
    assert texts and sum(map(len, texts)) <= bound and [of[t][1] for t in texts] == ys
    assert all(zlib.crc32(str(of[t][0]).encode()) % 5 for t in texts)
    if bound == 20_000:  # all short ones fit
        want = {i for i, t, _ in rows if i % 7 and zlib.crc32(str(i).encode()) % 5}
        assert {of[t][0] for t in texts} == want


def test_several_texts_of_one_id(spark):
    rows = [(1, "aa", 0), (1, "bb", 1), (1, "ccc", 0), (1, None, 0), (2, "dd", 0)]
    texts, ys = toxicity.sample(*frames(spark, rows), toxicity.ToxicRules(), "doc_id", "text")
    held = [i for i in (1, 2) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert list(zip(texts, ys, strict=True)) == [x for i, x in ((1, ("ccc", 1)), (2, ("dd", 0))) if i not in held]


def test_scores_are_the_models(spark):
    rules = toxicity.ToxicRules(epochs=2)
    rows = [(i, prose(i, 25) + (" nasty" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(200)] + [(999, "", 0), (1000, None, 0)]
    docs, labels = frames(spark, rows)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels, rules).collect()}
    model = toxicity.train(*toxicity.sample(docs, labels, rules, "doc_id", "text"), rules)
    for i, text, _ in rows:
        words, total = re.findall(r"[^\W\d_]+", (text or "").lower()), 0.0
        for w in words:
            s = f"<{w}>"
            grams = [s] + [s[a : a + n] for n in (3, 4, 5) if n < len(s) for a in range(len(s) - n + 1)]
            total += sum(float(model.scores[zlib.crc32(g.encode()) % len(model.scores)]) for g in grams) / len(grams)
        x = model.bias + (total / len(words) if words else 0.0)
        assert abs(got[i] - 1 / (1 + math.exp(-x))) < 1e-6
