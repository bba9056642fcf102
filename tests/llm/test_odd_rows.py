"""Every operator and pipeline stage on nulls, empty, long and repeated texts, clashing columns and empty tables."""

import pytest

from codeloom.llm import binary, decontam, html, neardup, packing, pii, quality, suffix, tokencount, toxicity

ITEMS = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def by_row(operator):
    return lambda spark, d: operator(d)


ROW_BY_ROW = {
    "toxicity": lambda spark, d: toxicity.toxicity(d, spark.createDataFrame([(3, 1, 1), (4, 0, 0), (None, None, None), (7, 1, None)], LABELS)),
    "pii": by_row(pii.find_pii),
    "quality": by_row(quality.quality_rules),
    "tokens": by_row(tokencount.token_counts),
    "suffix": by_row(suffix.remove_repeats),
    "near": by_row(neardup.near_classes),
    "redact": by_row(pii.redact),
}


@pytest.mark.parametrize("name", sorted(ROW_BY_ROW))
def test_one_row_per_row(spark, odd, none, odd_rows, name):
    out = ROW_BY_ROW[name](spark, odd).collect()
    key = lambda x: (x is None, x or 0)
    assert sorted((r["doc_id"] for r in out), key=key) == sorted((r[0] for r in odd_rows), key=key)
    assert ROW_BY_ROW[name](spark, none).count() == 0


def test_quality_of_odd_rows(odd):
    got = {r.doc_id: r for r in quality.quality_rules(odd).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept and got[2].n_words == 0
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in quality.quality_rules(odd).collect())


def test_toxicity_without_labels(spark, odd):
    out = toxicity.toxicity(odd, spark.createDataFrame([], LABELS)).collect()
    assert len({r.score for r in out}) == 1 and all(0 <= r.score <= 1 for r in out)


def test_packing(spark, odd, none):
    pieces = packing.pack(odd).collect()
    ids = packing.word_ids(packing.PackRules())
    want = sorted(len(packing.ids_of(r.text, ids, b"\1\0\0\0")) // 4 for r in odd.collect())
    starts = [p for p in pieces if p.start == 0]
    assert sorted(p.doc_tokens for p in starts) == want and sum(p.length for p in pieces) == sum(want)
    assert packing.pack(none).count() == 0


def test_binary(odd, none, odd_rows):
    got = binary.unpack(binary.write_packed(odd)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(((r[0], r[1] or "") for r in odd_rows), key=key)
    assert binary.write_packed(none).count() == 0


def test_decontamination(spark, odd, none, odd_rows):
    items = spark.createDataFrame([(1, odd_rows[4][1]), (1, odd_rows[4][1]), (2, "one two"), (3, None), (4, ""), (None, "zebra")], ITEMS)
    assert sorted((r.doc_id, r.item_id) for r in decontam.find_leaks(odd, items).collect()) == [(3, 1), (4, 1), (5, 1), (8, 2)]  # the long text begins with the item
    assert decontam.find_leaks(none, items).count() == 0 and decontam.find_leaks(odd, items.limit(0)).count() == 0
    kept = decontam.drop_leaked(odd, items)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows) - 5


def test_near_copies(odd, none, odd_rows):
    kept = neardup.drop_near_copies(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and 5 not in ids and neardup.drop_near_copies(none).count() == 0
    classes = {r.doc_id: r.class_id for r in neardup.near_classes(odd).collect()}
    assert classes[5] == classes[4] == 4


def test_redaction_leaves_other_columns(odd):
    assert pii.redact(odd).schema == odd.schema


def test_pages(spark):
    s = "page_id long, url string, html string, host string, region string"
    rows = [(1, None, None, None, None), (None, "http://a.b/c", "", None, None), (2, "http://a.b/d", "<p>x", None, None), (2, "http://a.b/d", "<p>x", None, None), (3, "::", "<" * 50 + "&am", None, None), (4, "http://a.b/e", "<p>" + "word " * 50_000, None, None)]
    out = html.extract_main_text(spark.createDataFrame(rows, s)).collect()
    assert len(out) == 6 and all(len(r.text) == r.n_chars for r in out)
    assert {r.text for r in out if r.page_id == 2} == {"x"} and {r.text for r in out if r.page_id in (1, None)} == {""}
    assert html.extract_main_text(spark.createDataFrame([], s)).count() == 0


def test_pipeline_stages(spark, odd, none, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "one two")], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            n = out.count()
            assert name == "packing" or (out.columns == docs.columns and n <= docs.count())
