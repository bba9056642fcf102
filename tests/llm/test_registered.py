"""The registered queries on the smallest tables: whole tables, the columns asked for, the SQL's rows."""

import os

import pytest

from codeloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

COLUMNS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op3_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op4_html": "page_id bigint, url string, text string, n_chars bigint",
    "op6_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8_near_duplicates": "doc_id bigint, class_id bigint",
    "op9_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op10_token_counts": "doc_id bigint, n_tokens bigint",
}


def test_ten_operators():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    out = queries.queries()[name](spark, SF)
    assert set(map(tuple, (c.split() for c in COLUMNS[name].split(", ")))) <= set(out.dtypes)
    table, key = ("pages", "page_id") if name == "op4_html" else ("documents", "doc_id")
    want = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    got = [r[0] for r in out.select(key).collect()]
    assert set(got) == want and (name == "op2_packing" or len(got) == len(want))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    rows = lambda df: sorted(df[sorted(df.columns)].itertuples(index=False, name=None))
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(c.sql(queries.oracle_sql()[name]).df())
