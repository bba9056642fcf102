"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import pytest

from codeloom import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows(spark, duck, name):
    assert plain(plans.queries()[name](spark, SF).toPandas()) == plain(duck.sql(plans.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_training_data_operators(tmp_path):
    """A copy without the optional subpackage still registers everything else, whether the pipeline is there or not."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "codeloom", tmp_path / "codeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [q for q in e.queries() if q.startswith('op') or q == 'pipeline'])"
    want = f"{len(plans.queries())} {len(plans.oracle_sql())} []"
    for with_pipeline in (True, False):
        if with_pipeline and (root / "corpus_pipeline.py").exists():
            shutil.copy(root / "corpus_pipeline.py", tmp_path)
        elif (tmp_path / "corpus_pipeline.py").exists():
            (tmp_path / "corpus_pipeline.py").unlink()
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
        assert out.stdout.strip() == want, out.stderr[-500:]


def test_shared_folder_is_named_on_clusters(spark, monkeypatch):
    from types import SimpleNamespace

    from codeloom import shared

    session = lambda master, named: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=SimpleNamespace(master=master))
    assert shared.shared_dir(session("spark://a:7077", "hdfs:///x/")) == "hdfs:///x"
    assert shared.shared_dir(session("local[4]", None)).startswith("file:///")
    for master in ("spark://a:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared.shared_dir(session(master, None))


def test_tables_of_one_query_are_dropped_by_themselves(spark):
    from pathlib import Path

    from codeloom import shared

    place = lambda df: Path(df.inputFiles()[0].removeprefix("file://")).parent
    before = place(shared.written(spark.range(3).toDF("a"), "before"))
    with shared.own_tables(spark):
        inside = place(shared.written(spark.range(3).toDF("a"), "inside"))
        assert inside.exists()
    assert before.exists() and not inside.exists()
