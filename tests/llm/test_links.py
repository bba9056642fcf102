"""Near copies without ids, the links that make a class, and recall."""

import random
from collections import Counter

import numpy as np

from codeloom.llm import neardup

from .conftest import prose
from .test_against_brute_force import docs, near_texts


def near(text, k):
    w = text.split()
    w[k] = f"edit{k}"
    return " ".join(w)


def test_near_copies_without_ids(spark):
    a, b, c = prose(1, 90), prose(2, 90), prose(3, 90)
    rows = [(None, a), (None, near(a, 40)), (None, near(a, 41)), (None, b), (None, b), (None, ""), (7, c), (None, near(c, 30)), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id, r.class_size, r.class_texts) for r in neardup.near_classes(df).collect())
    assert got == Counter([(None, None, 3, 3)] * 3 + [(None, None, 2, 1)] * 2 + [(7, 7, 2, 2), (None, 7, 2, 2), (None, 8, 2, 1), (8, 8, 2, 1)])
    kept = [r.text for r in neardup.drop_near_copies(df).collect()]
    assert len(kept) == 4 and kept.count(b) == 1 and kept.count(c) == 1 and sum(t in (a, near(a, 40), near(a, 41)) for t in kept) == 1
    assert len({r.class_md5 for r in neardup.near_classes(df).collect()}) == 4


def test_each_linked_text_names_a_link(spark):
    texts, rules = near_texts(), neardup.NearRules()
    df = docs(spark, texts)
    idf, memo = neardup.inverse_frequencies(df, rules, "text"), neardup.hashed_words(rules)
    rows = neardup.near_classes(df, rules).collect()
    by_md5 = {r.text_md5: texts[r.doc_id] for r in rows}
    of = lambda t: neardup.vector(t, memo, idf, rules)
    for r in rows:
        assert (r.link_md5 is None) == (r.class_texts == 1) == (r.similarity is None)
        if r.link_md5:
            like = neardup.weighted_jaccard(of(texts[r.doc_id]), of(by_md5[r.link_md5]))
            assert abs(like - r.similarity) < 1e-6 and like >= 0.8 and r.link_md5 != r.text_md5


def test_weights_follow_document_frequencies(spark):
    texts = ["the of and to in " + prose(i, 30) for i in range(300)]
    rules = neardup.NearRules()
    idf, memo = neardup.inverse_frequencies(docs(spark, texts), rules, "text"), neardup.hashed_words(rules)
    common, rare = neardup.words_of("the of and", memo)["b"], neardup.words_of("zzqx qqyz", memo)["b"]
    assert (idf[common] < 1.05).all() and (idf[rare] > 1.8).all()


def test_bands_find_nearly_all_pairs_at_the_threshold():
    rules, rng, found, n = neardup.NearRules(), random.Random(5), 0, 300
    s = neardup.Sampler(rules)
    for _ in range(n):
        key = np.sort(np.array(rng.sample(range(1 << 62), 200), dtype=np.uint64))
        w = np.ones(200, np.float32)
        a, b = (key[:180], w[:180]), (key[20:], w[20:])  # similarity 160 / 200
        found += bool(set(s.bands(*a)) & set(s.bands(*b)))
    assert neardup.weighted_jaccard(a, b) == 0.8 and found >= 0.99 * n
