"""Operators on small literal graphs, and on random ones against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.graph import Graph
from codeloom.operators import dml, embed, lookup, patterns, review, search, stats, traverse
from codeloom.schemas import EDGES, NODES


def make(spark, nodes, edges):
    """Nodes (kind, qualified, file, first, last, is_test); edges (kind, source, target, file, line)."""
    full = [(k, q.split("::")[-1].split(".")[-1] if "::" in q else q, q, f, a, b, "python", None, None, None, None, t, None, None) for k, q, f, a, b, t in nodes]
    return Graph(spark.createDataFrame(full, NODES), spark.createDataFrame([(*e, None) for e in edges], EDGES))


@pytest.fixture(scope="module")
def auth(spark):
    nodes = [
        ("File", "/repo/auth.py", "/repo/auth.py", 1, 50, False), ("File", "/repo/main.py", "/repo/main.py", 1, 30, False), ("Class", "/repo/auth.py::AuthService", "/repo/auth.py", 5, 40, False),
        ("Function", "/repo/auth.py::AuthService.login", "/repo/auth.py", 10, 20, False), ("Function", "/repo/main.py::process", "/repo/main.py", 5, 15, False), ("Test", "/repo/test_auth.py::test_login", "/repo/test_auth.py", 1, 10, True),
    ]
    edges = [
        ("CONTAINS", "/repo/auth.py", "/repo/auth.py::AuthService", "/repo/auth.py", 5), ("CONTAINS", "/repo/auth.py::AuthService", "/repo/auth.py::AuthService.login", "/repo/auth.py", 10),
        ("CALLS", "/repo/main.py::process", "/repo/auth.py::AuthService.login", "/repo/main.py", 10), ("CALLS", "/repo/main.py::process", "bare", "/repo/main.py", 11),
    ]
    return make(spark, nodes, edges)


def names(df, column="qualified_name"):
    return sorted(r[column] for r in df.collect())


def target(spark, *qs):
    return spark.createDataFrame([(q,) for q in qs], "target string")


def test_bare_target_is_tried_only_without_exact_edges(auth, spark):
    g = Graph(auth.nodes, auth.edges.unionByName(spark.createDataFrame([("INHERITS", "/x::S", "AuthService", "/x", 1, None), ("CALLS", "/x::S", "ghost", "/x", 2, None)], EDGES)))
    assert [r.kind for r in lookup.edges_to(g, "/repo/auth.py::AuthService").collect()] == ["CONTAINS"]
    assert [r.kind for r in lookup.edges_to(g, "/any.py::ghost").collect()] == ["CALLS"]
    assert lookup.edges_to(g, "nothing").isEmpty()
    assert patterns.inheritors_of(g, target(spark, "/repo/auth.py::AuthService")).isEmpty()
    assert names(patterns.inheritors_of(g, target(spark, "/repo/auth.py::AuthService"), fixed=True), "source_qualified") == ["/x::S"]


def test_callers_and_callees_keep_unresolved_ends(auth, spark):
    callers = patterns.callers_of(auth, target(spark, "/repo/auth.py::AuthService.login")).collect()
    assert [(r.source_qualified, r.node_name, r.line) for r in callers] == [("/repo/main.py::process", "process", 10)]
    callees = patterns.callees_of(auth, target(spark, "/repo/main.py::process")).collect()
    assert sorted((r.target_qualified, r.node_name) for r in callees) == [("/repo/auth.py::AuthService.login", "login"), ("bare", None)]


def test_callers_fall_back_to_the_bare_name(spark):
    g = make(spark, [("Function", "a.py::f", "a.py", 1, 2, False), ("Function", "b.py::g", "b.py", 1, 2, False)], [("CALLS", "b.py::g", "f", "b.py", 3), ("CONTAINS", "a.py", "a.py::f", "a.py", 1)])
    assert names(patterns.callers_of(g, target(spark, "a.py::f")), "source_qualified") == ["b.py::g"]


def test_target_resolution(auth):
    assert patterns.resolve_target(auth, "auth.py", "/repo").target == "/repo/auth.py"
    assert patterns.resolve_target(auth, "process").target == "/repo/main.py::process"
    assert patterns.resolve_target(auth, "login").status == "ambiguous"
    assert patterns.resolve_target(auth, "zzz").status == "not_found"


def test_tests_for_lists_a_node_of_both_searches_twice(spark):
    g = make(spark, [("Function", "a.py::run", "a.py", 1, 2, False), ("Test", "t.py::test_run", "t.py", 1, 2, True), ("Test", "t.py::TestrunX", "t.py", 1, 2, True), ("Test", "t.py::Testrun_test_run", "t.py", 1, 2, True)], [("TESTED_BY", "t.py::test_run", "a.py::run", "t.py", 1)])
    got = [r.qualified_name for r in patterns.tests_for(g, "a.py::run", "run").collect()]
    assert sorted(got) == ["t.py::TestrunX", "t.py::Testrun_test_run", "t.py::Testrun_test_run", "t.py::test_run"]


def test_chain_is_truncated_but_the_level_is_whole(spark):
    g = make(spark, [("Function", f"c{i}.py::f{i}", f"c{i}.py", 1, 2, False) for i in range(20)], [("CALLS", f"c{i}.py::f{i}", f"c{i + 1}.py::f{i + 1}", f"c{i}.py", 1) for i in range(19)])
    start = spark.createDataFrame([("c0.py",)], "file_path string")
    i = traverse.impact_radius(g, start, 10, 3)
    assert i.truncated and i.total_impacted == 3
    j = traverse.impact_radius(g, start, 2, 500)
    assert not j.truncated and names(traverse.impacted_nodes(g, j)) == ["c1.py::f1", "c2.py::f2"]
    assert traverse.impact_edges(g, j).count() == 2


def test_traversal_equals_plain_search(spark):
    rng = random.Random(3)
    for _ in range(3):
        n = 40
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(45)]
        g = make(spark, [("Function", f"f{i}.py::n{i}", f"f{i}.py", 1, 2, False) for i in range(n)], [("CALLS", f"f{a}.py::n{a}", f"f{b}.py::n{b}", f"f{a}.py", k) for k, (a, b) in enumerate(pairs)])
        near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(n)}
        dist, level, d = {0: 0}, {0}, 0
        while level and d < 3:
            d += 1
            level = {y for x in level for y in near[x]} - dist.keys()
            dist |= dict.fromkeys(level, d)
        got = traverse.impact_radius(g, spark.createDataFrame([("f0.py",)], "file_path string"), 3, 10**9)
        assert {int(r.name.split("::n")[1]): r.dist for r in got.levels.collect()} == dist


def test_dependents(spark):
    g = make(spark, [("File", "u.py", "u.py", 1, 9, False), ("Function", "u.py::h", "u.py", 1, 2, False), ("File", "m.py", "m.py", 1, 9, False)], [("IMPORTS_FROM", "m.py", "u.py", "m.py", 1), ("CALLS", "k.py::x", "u.py::h", "k.py", 2), ("DEPENDS_ON", "d.py::x", "u.py::h", "d.py", 2), ("CALLS", "u.py::h", "u.py::h", "u.py", 2)])
    assert names(traverse.dependents(g, spark.createDataFrame([("u.py",)], "file_path string")), "dependent") == ["k.py", "m.py"]


def test_search_needs_every_word_and_ranks(spark):
    g = make(spark, [("Function", f"x.py::{n}", "x.py", 1, 2, False) for n in ("auth", "auth_handler", "do_auth_check", "other")], [])
    assert [r.name for r in search.search_ranked(g, "auth").collect()] == ["auth", "auth_handler", "do_auth_check"]
    assert [r.name for r in search.search_nodes(g, "auth check").collect()] == ["do_auth_check"]
    assert search.search_nodes(g, "  ").isEmpty()
    assert [r.name for r in search.search_nodes(g, "d__auth").collect()] == ["do_auth_check"]
    assert search.search_nodes(g, "d__auth", fixed=True).isEmpty()
    assert [r.name for r in search.search_nodes(g, "o_auth").collect()] == ["do_auth_check"]


def test_kind_after_the_cut_loses_hits_unless_fixed(spark):
    g = make(spark, [("Function", f"x.py::a{i}", "x.py", 1, 2, False) for i in range(4)] + [("Class", "x.py::az", "x.py", 1, 2, False)], [])
    assert search.search_ranked(g, "a", kind="Class", limit=1).isEmpty()
    assert names(search.search_ranked(g, "a", kind="Class", limit=1, fixed=True)) == ["x.py::az"]


def test_sizes(spark):
    g = make(spark, [("Function", "/r/a.py::big", "/r/a.py", 1, 100, False), ("Function", "/o/b.py::mid", "/o/b.py", 1, 60, False), ("Function", "/r/a.py::none", "/r/a.py", None, None, False)], [])
    rows = search.large_functions(g, "/r").collect()
    assert [(r.line_count, r.relative_path) for r in rows] == [(100, "a.py"), (60, "/o/b.py")]
    assert names(search.nodes_by_size(g, 1, 99, path="B.PY")) == ["/o/b.py::mid"]


def test_innermost(auth, spark):
    at = spark.createDataFrame([("/repo/auth.py", 12), ("/repo/auth.py", 45), ("/repo/none.py", 1)], "file_path string, line int")
    assert {r.line: r.name for r in search.innermost_at(auth, at).collect()} == {12: "login", 45: "/repo/auth.py"}


def test_stats(auth):
    assert stats.totals(auth).first().asDict() == {"total_nodes": 6, "files_count": 2, "languages": 1, "total_edges": 4}
    assert {(r.relation, r.kind): r.n for r in stats.counts_by_kind(auth).collect()}["edge", "CALLS"] == 2


def test_subgraph_repeats_nodes(auth, spark):
    q = "/repo/main.py::process"
    s = lookup.subgraph(auth, spark.createDataFrame([(q,), (q,), ("/repo/auth.py::AuthService.login",)], "qualified_name string"))
    assert s.nodes.count() == 3 and s.edges.count() == 1


def plain_ranges(spans):
    out = []
    for lo, hi in sorted((max(0, a - 3), b + 2) for a, b in spans):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def test_ranges_like_plain_merging(spark):
    rng = random.Random(5)
    spans = [(a, a + rng.randrange(9)) for a in (rng.randrange(1, 200) for _ in range(25))]
    n = spark.createDataFrame([("f", "Function", a, b) for a, b in spans] + [("f", "File", 1, 999), ("f", "Function", None, 3)], "file_path string, kind string, line_start int, line_end int")
    assert sorted((r.lo, r.hi) for r in review.merged_ranges(n, fixed=True).collect()) == plain_ranges(spans)
    assert [(r.lo, r.hi) for r in review.merged_ranges(n).collect()] == [(0, 1001)]


def test_snippet(spark):
    text = "\n".join(f"l{i}" for i in range(1, 31))
    files = spark.createDataFrame([("f", text), ("g", "only\ntwo")], "file_path string, text string")
    ranges = spark.createDataFrame([("f", 0, 2), ("f", 28, 30)], "file_path string, lo int, hi int")
    got = {r.file_path: r.snippet for r in review.snippets(files, ranges).collect()}
    assert got == {"f": "1: l1\n2: l2\n...\n29: l29\n30: l30", "g": "1: only\n2: two"}


def test_guidance(auth, spark):
    i = traverse.impact_radius(auth, spark.createDataFrame([("/repo/auth.py",)], "file_path string"))
    counts = review.guidance_counts(auth, i).first().asDict()
    assert counts == {"untested_functions": 1, "impacted_nodes": 1, "inheritance_edges": 0, "impacted_files": 1}
    text = review.guidance_text(counts, ["login"])
    assert "login" in text and len(text.splitlines()) == 1
    assert review.guidance_text(dict.fromkeys(counts, 0), []).startswith("* Nothing stands out")
    bounds = {"untested_functions": 0, "impacted_nodes": 21, "inheritance_edges": 1, "impacted_files": 4}
    assert len(review.guidance_text(bounds, []).splitlines()) == 3
    assert len(review.guidance_text(bounds | {"impacted_nodes": 20, "impacted_files": 3}, []).splitlines()) == 1


def test_upsert_is_idempotent_and_keeps_the_last(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 5, 1), ("b", 7, 2), ("c", 3, 1)], "k string, v int, seq int")
    once = dml.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 7), ("c", 3)]
    assert sorted(map(tuple, dml.upsert(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect()))


def test_removing_a_file_leaves_edges_of_others(auth, spark):
    p = spark.createDataFrame([("/repo/auth.py",)], "file_path string")
    assert dml.remove_files(auth.edges, p).count() == 2 and dml.remove_files(auth.nodes, p).count() == 3


def test_change_set(spark):
    s = "path string, file_hash string"
    old, new = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], s), spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "1")], s)
    assert sorted(map(tuple, dml.change_set(old, new).collect())) == [("a", "removed"), ("c", "modified"), ("d", "added")]


def test_embedding_skips_what_is_done_and_follows_the_provider(auth, spark):
    b = embed.HashingBackend(16)
    empty = spark.createDataFrame([], "qualified_name string, vector array<float>, text_hash string, provider string")
    made = embed.embed_nodes(auth.nodes, empty, b)
    assert made.count() == 4 and embed.pending(auth.nodes, made, b.name).isEmpty()
    assert embed.pending(auth.nodes, made, "another").count() == 4
    assert embed.with_provider(made.drop("provider")).first().provider == "unknown"
    top = embed.semantic_search(auth, made, b.embed_query("login function python"), limit=1).first()
    assert top.name == "login" and round(top.similarity_score, 4) == top.similarity_score
    assert names(embed.embeddable(auth), "file_path") == ["/repo/auth.py"] * 3 + ["/repo/main.py"] * 2


def test_remote_backend_batches_and_tries_again():
    calls, pauses = [], []

    def call(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise RuntimeError("HTTP 429")
        return [[1.0]] * len(texts)

    b = embed.RemoteBackend(call, batch=100, sleep=pauses.append)
    assert len(b.embed_texts(["x"] * 150)) == 150 and calls == [100, 100, 50] and pauses == [1.0]
    with pytest.raises(ValueError):
        embed.RemoteBackend(lambda t: (_ for _ in ()).throw(ValueError("bad input")), sleep=pauses.append).embed_query("x")


def test_backend_choice():
    assert embed.backend_kind(None, {}) == "local" and embed.backend_kind(None, {"API_KEYS": "x"}) == "remote"
    assert embed.backend_kind("local", {"API_KEYS": "x"}) == "local" and embed.backend_kind(None, {"EMBEDDING_BACKEND": "mine"}) == "mine"


def test_views(auth):
    row = lookup.node_view(auth.nodes.withColumn("language", F.lit(None).cast("string"))).first()
    assert row.language == "" and "params" not in row.asDict()


def test_both_readings_of_tested_by(spark):
    g = make(spark, [("Function", "a.py::f", "a.py", 1, 2, False), ("Test", "t.py::test_a", "t.py", 1, 2, True), ("Test", "t.py::test_b", "t.py", 1, 2, True)], [("TESTED_BY", "t.py::test_a", "a.py::f", "t.py", 1), ("TESTED_BY", "a.py::f", "t.py::test_b", "a.py", 1)])
    assert names(patterns.tests_linked(g, target(spark, "a.py::f")), "test") == ["t.py::test_a"]
    assert names(patterns.tests_linked(g, target(spark, "a.py::f"), fixed=True), "test") == ["t.py::test_a", "t.py::test_b"]


def test_written_tables_can_be_dropped(spark):
    from pathlib import Path

    from codeloom import shared

    t = shared.written(spark.range(2).toDF("a"), "drop-me")
    place = Path(t.inputFiles()[0].removeprefix("file://")).parent
    assert place.exists()
    shared.drop_written(spark)
    assert not place.exists()


def test_nearest_in_blocks_of_queries(spark, monkeypatch):
    import math
    import random

    from codeloom.operators import embed

    r = random.Random(3)
    v = lambda: [r.uniform(-1, 1) for _ in range(6)]
    rows, queries = [(f"n{i}", v()) for i in range(40)], [(f"q{i}", v()) for i in range(7)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = {(q, n, k + 1) for q, x in queries for k, (_, n) in enumerate(sorted((-round(cos(x, y), 4), n) for n, y in rows)[:3])}
    for size in (1_000, 2):
        monkeypatch.setattr(embed, "QUERY_BLOCK", size)
        got = embed.nearest_batch(spark.createDataFrame(rows, "n string, v array<double>"), spark.createDataFrame(queries, "query string, q array<double>"), "n", "v", 3)
        assert {(x["query"], x.n, x["rank"]) for x in got.collect()} == want


def test_innermost_in_long_files(spark):
    import random

    from codeloom.graph import Graph
    from codeloom.operators import search
    from codeloom.schemas import NODES

    r = random.Random(4)
    spans = [("a", 1, 900)] + [(r.choice("ab"), a := r.randrange(1, 900), a + r.choice([0, 3, 40, 64, 200, 500])) for _ in range(120)]
    nodes = [("Function", f"n{i}", f"{f}::n{i}", f, a, b, "python", None, None, None, None, False, None, None) for i, (f, a, b) in enumerate(spans)]
    at = [(f, line) for f in "abc" for line in range(0, 1500, 7)]
    got = {(x.file_path, x.line): x.qualified_name for x in search.innermost_at(Graph(spark.createDataFrame(nodes, NODES), None), spark.createDataFrame(at, "file_path string, line int")).collect()}
    want = {}
    for f, line in at:
        inside = [(n[5] - n[4], n[2]) for n in nodes if n[3] == f and n[4] <= line <= n[5]]
        if inside:
            want[f, line] = min(inside)[1]
    assert got == want
