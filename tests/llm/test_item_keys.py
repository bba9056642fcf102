"""Items that share an id or have none."""

from codeloom.llm import decontam

from .conftest import prose


def test_items_of_one_id_and_without_an_id(spark):
    items = [(1, prose(i, 12 + i)) for i in range(30)] + [(None, prose(50, 30)), (None, prose(51, 20))]
    texts = [(n, f"{prose(100 + n, 40)} {t} {prose(200 + n, 40)}") for n, (_, t) in enumerate(items)]
    docs = [*texts, (40, prose(300, 90)), (None, texts[31][1]), (None, prose(301, 90)), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    df_items = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(df, df_items).collect()} == {(n, i) for n, (i, _) in enumerate(items)} | {(None, None)}
    assert sorted(map(str, decontam.drop_leaked(df, df_items).collect())) == sorted(map(str, df.where("doc_id = 40 or text is null").collect() + [r for r in df.collect() if r.text == prose(301, 90)]))


def test_sql_judges_rows_by_themselves_too(spark):
    import duckdb

    a, b, c = prose(1, 30), prose(2, 18), prose(3, 25)
    half = " ".join(a.split()[:15])
    items = [(1, a), (1, b), (1, half), (2, c), (2, c), (3, "one two"), (None, b), (4, None), (5, "")]
    texts = [(1, f"x {a} y"), (1, f"{prose(9, 40)} {b}"), (2, f"{half} {prose(8, 30)} {' '.join(a.split()[15:])}"), (3, f"{c} {b}"), (3, None), (None, b), (None, f"z {c}"), (4, "ONE two"), (5, ""), (6, f"{b} {' '.join(b.split()[::-1])}")]
    duck = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", texts), ("benchmark", "item_id", items)):
        duck.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        duck.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    want = sorted(map(repr, map(list, duck.sql(f"SELECT doc_id, item_id, n_item, n_shared, containment FROM ({decontam.ORACLE})").fetchall())))
    found = decontam.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(map(repr, map(list, found.collect())))
    assert got == want and len(got) >= 8
