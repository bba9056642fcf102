"""The search for a column of terms against the single search, however its keys are cut, and what it moves."""

import random

import pytest

from codeloom.operators import patterns, search

from .test_graph import make, target

NODES = ["/a/xa.py::Pay_day.test_pay", "/a/xa.py::Pay-day.testpay", "/a/b c.py::Größe_ÀÉ", "/a/b.py::aXbXc", "/a/b.py::a_b_c", "/q/😀.py::x😀y_z", "/q/r.py::a\\b%c", "/q/long.py::" + "ab_" * 40 + "end", "/q/same.py::same_same"]
TERMS = ["test_pay", "TEST_PAY", "testpay", "pay_day", "größe_àé", "größe", "a_b_c", "_a_b", "b_c_", "__", "a__b", "x_y", "😀y", "x😀_", "a\\b", "b%c", "%b%", "a%day%pay", "day test", "py pay xa", "r.py py", "ab_ab_ab", "ab_" * 40 + "end", "same", "same_same"]
TERMS += ["", "  ", "nothing", "::", "ab_" * 41 + "end", "/q/r.py::a", "pay\tday"]


def graph(spark):
    nodes = [("Function", q, q.split("::")[0], 1, 2, False) for q in NODES + NODES[-1:]]
    rng = random.Random(3)
    nodes += [("Function", f"/r/{i % 7}.py::" + "".join(rng.choice("ab_c") for _ in range(9)), f"/r/{i % 7}.py", 1, 2, False) for i in range(60)]
    return make(spark, nodes, [])


@pytest.mark.parametrize("few", [None, (64, 60), (64, 8), (4, 4), (0, 0)])
def test_each_term_finds_what_a_search_finds(spark, monkeypatch, few):
    if few:
        monkeypatch.setattr(search, "FEW_HEADS", few[0])
        monkeypatch.setattr(search, "FEW_KEYS", few[1])
    g, rng = graph(spark), random.Random(5)
    terms = TERMS + ["".join(rng.choice("ab_c%") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    rows = [r.asDict() for r in g.nodes.select("name", "qualified_name").collect()]
    want = {t: sorted(r.qualified_name for r in search.search_nodes(g, t, limit=None).collect()) for t in TERMS} if not few else {}
    got, cut = {}, {}
    for r in search.search_all(g, target(spark, *terms).withColumnRenamed("target", "term")).collect():
        got.setdefault(r.term, []).append(r.qualified_name)
    for r in search.search_all(g, target(spark, *terms).withColumnRenamed("target", "term"), ["qualified_name"], first=3).collect():
        cut.setdefault(r.term, []).append(r.qualified_name)

    def like(text, word):  # a plain reading of LIKE '%word%'
        import re

        return re.search("".join({"_": ".", "%": ".*"}.get(c, re.escape(c)) for c in word), text.lower(), re.S)

    for t in terms:
        words = t.lower().split()
        plain = [r for r in rows if words and all(like(r["name"], w) or like(r["qualified_name"], w) for w in words)]
        assert sorted(got.get(t, [])) == sorted(r["qualified_name"] for r in plain), t
        assert sorted(cut.get(t, [])) == sorted(r["qualified_name"] for r in sorted(plain, key=lambda r: (r["name"], r["qualified_name"]))[:3]), t
        if t in want:
            assert sorted(got.get(t, [])) == want[t], t


def test_nodes_are_not_exploded(spark):
    """Not a row for each stretch of their names: 200 nodes of 400 characters, of which two hold a term."""
    rng = random.Random(7)
    names = [f"/m/{i}.py::" + "".join(rng.choices("abcdefgh", k=390)) for i in range(200)]
    g = make(spark, [("Function", n, n.split("::")[0], 1, 2, False) for n in names], [])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    terms = target(spark, names[3][-60:], names[9][-60:]).withColumnRenamed("target", "term")
    found = search.search_all(g, terms)
    assert "Generate" not in plan(found)
    assert sorted(r.qualified_name for r in found.collect()) == sorted([names[3], names[9]])


def test_named_tests_of_nodes_that_share_a_name_are_listed_once_a_node(spark):
    """As in the SQL of ``tests_for``: twice for two nodes, not four times."""
    g = make(spark, [("Class", "/a.py::Cart", "/a.py", 1, 9, False)] * 2 + [("Test", "/t.py::test_cart", "/t.py", 1, 2, True)], [])
    assert [tuple(r)[:2] for r in patterns.tests_of(g, g.nodes.selectExpr("qualified_name AS target")).collect()] == [("/a.py::Cart", "/t.py::test_cart")] * 2
