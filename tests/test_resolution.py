"""Batch resolution of targets against the single-target search."""

from codeloom.operators import patterns, search

from .test_graph import make, target


def test_name_parts_are_found_as_by_a_search(spark):
    nodes = [("Function", f"/lib/Brand#{i}.go::steel{i}.long_{c}_name", f"/lib/Brand#{i}.go", 1, 2, False) for i in (1, 10, 12, 30) for c in "ab"]
    nodes += [("Function", "/lib/x.py::C.long-a-name", "/lib/x.py", 1, 2, False), ("Function", "/lib/x.py::b\\c%d", "/lib/x.py", 1, 2, False)]
    g = make(spark, nodes, [])
    names = ["Brand#1", "brand#30", "Brand#4", "long_a_name", "lib b\\c", "steel1 name", "STEEL12.long_b", "_", "%", "", " ", "zz", nodes[0][1]]
    got = {r.target: (r.hits, r.status) for r in patterns.resolution_status(g, target(spark, *names)).collect()}
    for n in names:
        hits = 1 if n == nodes[0][1] else search.search_nodes(g, n, limit=None).count()
        assert got[n] == (hits, "ok" if hits == 1 else "ambiguous" if hits else "not_found"), n
        assert patterns.resolve_target(g, n).status == got[n][1], n
    assert got["Brand#1"] == (6, "ambiguous") and got["long_a_name"][0] == 5
