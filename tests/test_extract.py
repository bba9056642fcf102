"""Extraction, storage, builds and the facade on small projects."""

import subprocess

import pytest
from pyspark.sql import functions as F

from codeloom.extract.operator import module_candidates, parse
from codeloom.session import GraphSession, docs_section

PY = '''import os
from lib.util import helper as h, other

class Base:
    pass

class Shape(Base, abc.ABC):
    @staticmethod
    def area(x: int = 1) -> float:
        def inner():
            return h(x)
        return inner()

async def run(items):
    for i in items:
        await work(i)
        work(i)

def test_run():
    Shape().area(len([1]))
'''


def edges(report, kind):
    return sorted((s, t) for k, s, t, _, _ in report.edges if k == kind)


def test_python():
    r = parse("pkg/m.py", "python", PY.encode())
    assert {n["qualified_name"]: n["kind"] for n in r.nodes} == {
        "pkg/m.py": "File", "pkg/m.py::Base": "Class", "pkg/m.py::Shape": "Class", "pkg/m.py::Shape.area": "Function", "pkg/m.py::Shape.inner": "Function", "pkg/m.py::run": "Function", "pkg/m.py::test_run": "Test",
    }
    assert edges(r, "INHERITS") == [("pkg/m.py::Shape", "Base"), ("pkg/m.py::Shape", "abc.ABC")]
    assert edges(r, "IMPORTS_FROM") == [("pkg/m.py", "lib.util"), ("pkg/m.py", "os")]
    calls = [(s, t, line, m) for k, s, t, line, m in r.edges if k == "CALLS"]
    assert ("pkg/m.py::Shape.inner", "h", 11, "lib.util") in calls
    assert [c[2] for c in calls if c[1] == "work"] == [16, 17]
    assert ("pkg/m.py::test_run", "pkg/m.py::Shape", 20, None) in calls
    area = next(n for n in r.nodes if n["name"] == "area")
    assert (area["params"], area["return_type"], area["line_start"], area["line_end"]) == ("(x: int=1)", "float", 9, 12)


def test_python_that_does_not_parse():
    r = parse("b.py", "python", b"def broken(:\n    foo()\nclass X(Y):\n    def m(self):\n        bar()\n")
    assert {n["name"] for n in r.nodes} == {"b.py", "broken", "X", "m"}
    assert edges(r, "CALLS") == [("b.py::X.m", "bar"), ("b.py::broken", "foo")]


SNIPPETS = {
    "typescript": ('import { a } from "./x";\nexport class T extends U implements V {\n  get(n: number): string { return a(n); }\n}\nfunction top() { return "f(x)"; }\n', {"T", "get", "top"}, {("INHERITS", "U"), ("INHERITS", "V"), ("IMPORTS_FROM", "./x"), ("CALLS", "a")}),
    "go": ('package m\nimport (\n\t"fmt"\n)\ntype S struct {\n}\nfunc New() *S { fmt.Println("x"); return nil }\n', {"S", "New"}, {("IMPORTS_FROM", "fmt"), ("CALLS", "Println")}),
    "rust": ("use std::fmt;\nstruct P { x: i32 }\nimpl P {\n  fn new() -> P { make!(1); build(2) }\n}\nfn build(n: i32) -> P { P { x: n } }\n", {"P", "new", "build"}, {("IMPORTS_FROM", "std::fmt"), ("CALLS", "make")}),
    "java": ("import java.util.List;\nclass A extends B implements C {\n  public A() { init(); }\n  int f(int x) { return g(x); }\n}\ninterface I { void m(); }\n", {"A", "f", "I", "m"}, {("IMPORTS_FROM", "java.util.List"), ("INHERITS", "extends B"), ("INHERITS", "implements C"), ("CALLS", "init"), ("CALLS", "g")}),
    "csharp": ("using System;\nnamespace N { public class A : B { public int F(int x) { return G(x); } } }\n", {"A", "F"}, {("IMPORTS_FROM", "System"), ("INHERITS", "B"), ("CALLS", "G")}),
    "c": ('#include <stdio.h>\nstruct node { int v; };\nint add(int a, int b) {\n  printf("x");\n  return a + b;\n}\n', {"node", "add"}, {("IMPORTS_FROM", "stdio.h"), ("CALLS", "printf")}),
    "cpp": ('#include "a.h"\nclass D : public B {\n public:\n  int f(int x) { return g(x); }\n};\n', {"D", "f"}, {("IMPORTS_FROM", "a.h"), ("INHERITS", "B"), ("CALLS", "g")}),
    "ruby": ('require "json"\nmodule M\n  class C\n    def hi(x)\n      if x\n        1\n      end\n    end\n  end\nend\n', {"M", "C", "hi"}, {("IMPORTS_FROM", "json")}),
    "kotlin": ("import a.b\nclass D(val x: Int) {\n  fun f(): Int { return g(x) }\n}\n", {"D", "f"}, {("IMPORTS_FROM", "import a.b"), ("CALLS", "g")}),
    "swift": ("import Foundation\nprotocol P {}\nstruct S { func f() { g() } }\n", {"P", "S", "f"}, {("IMPORTS_FROM", "import Foundation"), ("CALLS", "g")}),
    "php": ("<?php\nuse A\\B;\ninterface I {}\nclass C { function f($x) { return g($x); } }\n", {"I", "C", "f"}, {("IMPORTS_FROM", "use A\\B;"), ("CALLS", "g")}),
    "solidity": ('import "./a.sol";\ncontract T is O {\n  event E(uint x);\n  function f() public { g(); }\n}\n', {"T", "E", "f"}, {("IMPORTS_FROM", "./a.sol"), ("INHERITS", "O"), ("CALLS", "g")}),
}


@pytest.mark.parametrize("language", sorted(SNIPPETS))
def test_block_languages(language):
    text, names, some = SNIPPETS[language]
    r = parse("f", language, text.encode())
    assert names <= {n["name"] for n in r.nodes}
    assert not {t for _, t in some if _ == "CALLS"} & {n["name"] for n in r.nodes}
    assert some <= {(k, t) for k, _, t, _, _ in r.edges}


SOL = '''pragma solidity ^0.8.0;
import "./a.sol";
uint256 constant MAX = 10;
contract Bank is Owned, Base {
    using SafeMath for uint256;
    mapping(address => uint256) public balances;
    address private immutable owner = msg.sender;
    uint[] queue;
    struct Entry { uint256 inner; }
    event Moved(address to);
    modifier only() { require(true); _; }
    constructor(address a) Base(a) { init(); }
    function move(address to, uint n)
        public only limited(n) override returns (bool ok) {
        uint256 local = n;
        emit Moved(to);
        return send(to, local);
    }
}
using Lib.Inner for Bank;
'''


def test_solidity_constructs():
    r = parse("b.sol", "solidity", SOL.encode())
    by_name = {n["name"]: n for n in r.nodes if n["kind"] == "Function"}
    of = lambda name: (by_name[name]["qualified_name"], by_name[name]["return_type"], by_name[name]["modifiers"], by_name[name]["line_start"], by_name[name]["extra"])
    assert of("balances") == ("b.sol::Bank.balances", "mapping(address => uint256)", "public", 6, {"solidity_kind": "state_variable", "mutability": None})
    assert of("owner") == ("b.sol::Bank.owner", "address", "private", 7, {"solidity_kind": "state_variable", "mutability": "immutable"})
    assert of("queue")[1:3] == ("uint[]", None) and of("MAX") == ("b.sol::MAX", "uint256", None, 3, {"solidity_kind": "constant"})
    assert not {"inner", "local"} & set(by_name) and by_name["move"]["return_type"] == "returns (bool ok)"
    assert edges(r, "DEPENDS_ON") == [("b.sol", "Inner"), ("b.sol::Bank", "SafeMath")]
    calls = [(s.rsplit("::")[-1], t, line) for k, s, t, line, _ in r.edges if k == "CALLS"]
    assert {("Bank.move", "only", 14), ("Bank.move", "limited", 14), ("Bank.move", "Moved", 16), ("Bank.move", "send", 17), ("Bank.constructor", "Base", 12), ("Bank.constructor", "init", 12)} <= set(calls)
    assert not {"public", "override", "returns"} & {t for _, t, _ in calls}
    assert ("b.sol::Bank", "b.sol::Bank.queue") in edges(r, "CONTAINS") and ("b.sol", "b.sol::MAX") in edges(r, "CONTAINS")


def test_return_types():
    r = parse("a.ts", "typescript", b"class A {\n  f(x: number): Promise<string> {\n    return g(x);\n  }\n}\nfunction top(): void { }\nfunction bare() { }\n")
    assert {n["name"]: n["return_type"] for n in r.nodes if n["kind"] == "Function"} == {"f": ": Promise<string>", "top": ": void", "bare": None}


def test_nothing_for_unknown_languages():
    assert not parse("x.txt", "", b"class A").nodes


def test_module_candidates():
    assert module_candidates("a/b/c.py", "python", "x.y")[:3] == ["a/b/x/y.py", "a/b/x/y/__init__.py", "a/x/y.py"]
    assert module_candidates("a/b.ts", "typescript", "../c/d") == ["c/d", "c/d.ts", "c/d.tsx", "c/d.js", "c/d.jsx", "c/d/index.ts", "c/d/index.tsx", "c/d/index.js", "c/d/index.jsx"]
    assert module_candidates("a.ts", "typescript", "react") == []


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    (root / "lib").mkdir()
    (root / ".codeloom").mkdir()
    (root / "lib" / "util.py").write_text("def helper(x):\n    return x\n")
    (root / "main.py").write_text("from lib.util import helper\n\ndef go():\n    return helper(1)\n")
    (root / "blob.py").write_bytes(b"\0\1")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.js").write_text("function no() {}")
    return root


def table(s, name):
    return sorted(map(str, s.store.table(name).drop("updated_at").collect()))


def test_build_query_update(spark, project, tmp_path):
    s = GraphSession(spark, str(project), f"file://{tmp_path}/g")
    assert s.config("status")["graph_path"] is None
    built = s.graph("build", full_rebuild=True)
    assert (built["files_parsed"], built["total_nodes"], built["errors"]) == (2, 4, [])
    q = s.graph("query", pattern="imports_of", target="main.py")
    assert [r["import_target"] for r in q["results"]] == [e["target"] for e in q["edges"]] == ["lib.util"]
    s.store.commit(edges=s.store.table("edges").withColumn("target_qualified", F.replace("target_qualified", F.lit("lib.util"), F.lit("lib/util.py"))))
    q = s.graph("query", pattern="importers_of", target="lib/util.py::helper")
    assert [(r["importer"], r["file"]) for r in q["results"]] == [("main.py", "main.py")] and len(q["edges"]) == 1 and q["target"] == "lib/util.py::helper"
    assert s.graph("query", pattern="callers_of", target="helper")["target"] == "lib/util.py::helper"  # found by search
    s.graph("build", full_rebuild=True)
    assert {r["name"] for r in s.graph("query", pattern="file_summary", target="lib/util.py")["results"]} >= {"helper"}
    q = s.graph("query", pattern="callers_of", target="lib/util.py::helper")
    assert [r["qualified_name"] for r in q["results"]] == ["main.py::go"] and q["edges"][0]["line"] == 4
    assert s.graph("query", pattern="callers_of", target="map")["results"] == []
    assert s.graph("query", pattern="nope", target="x")["status"] == "error"
    assert s.graph("query", pattern="callers_of", target="zzz")["status"] == "not_found"
    (project / "lib" / "util.py").write_text("def helper(x):\n    return x + 1\n\ndef extra():\n    return helper(2)\n")
    up = s.graph("update", changed_files=["lib/util.py", "gone.py", "node_modules/x.js"])
    assert up["dependent_files"] == ["main.py"] and up["files_updated"] == 4 and up["total_nodes"] == 3
    incremental = table(s, "nodes"), table(s, "edges")
    s.graph("build", full_rebuild=True)
    assert incremental == (table(s, "nodes"), table(s, "edges"))
    (project / "main.py").unlink()
    s.graph("update", changed_files=["main.py"])
    assert s.graph("stats")["files_count"] == 1
    assert s.graph("update", changed_files=[])["summary"] .startswith("Nothing has changed")


def test_search_modes_and_review(spark, project, tmp_path):
    s = GraphSession(spark, str(project), f"file://{tmp_path}/g")
    s.graph("build", full_rebuild=True)
    assert s.graph("search", query="helper")["search_mode"] == "keyword"
    assert s.graph("embed")["newly_embedded"] == 2 and s.graph("embed")["newly_embedded"] == 0
    assert s.graph("search", query="helper")["search_mode"] == "semantic"
    assert s.config("cache_clear")["embeddings_removed"] == 2
    r = s.graph("review", changed_files=["lib/util.py", "none.py"])["context"]
    assert r["source_snippets"] == {"lib/util.py": "1: def helper(x):\n2:     return x", "none.py": "(could not read file)"}
    assert "helper" in r["review_guidance"] and r["impacted_files"] == ["main.py"]
    assert s.graph("impact", changed_files=["lib/util.py"])["total_impacted"] == len(s.graph("impact", changed_files=["lib/util.py"])["impacted_nodes"])
    assert s.graph("large_functions", min_lines=2)["total_found"] >= 2


def test_facade_errors(spark, tmp_path):
    s = GraphSession(spark, str(tmp_path), f"file://{tmp_path}/g")
    assert "valid_actions" in s.graph("nope") and "valid_patterns" in s.graph("query") and "error" in s.graph("search")
    assert "valid_actions" in s.config("nope") and "valid_keys" in s.config("set", key="x", value="y") and "valid_levels" in s.config("set", key="log_level", value="LOUD")
    assert s.config("set", key="log_level", value="warning")["value"] == "WARNING"
    assert "valid_topics" in s.help("nope") and s.help("config").startswith("# config")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "REFERENCE.md").write_text('<section name="usage">\n hi \n</section>')
    assert docs_section("USAGE", [tmp_path])["content"] == "hi" and docs_section("legal", [tmp_path])["status"] == "not_found"


def test_git_sources(spark, project):
    from codeloom.sources import files as src

    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.com", *a], cwd=project, capture_output=True, check=True)
    git("init", "-q")
    git("add", "main.py", "lib")
    git("commit", "-qm", "one")
    (project / "main.py").write_text("x = 1\n")
    git("commit", "-qam", "two")
    (project / "new.py").write_text("y = 2\n")
    assert src.changed_files(project) == ["main.py"] and "lib/util.py" in src.tracked_files(project)
    assert "new.py" in [r.path for r in src.staged_and_unstaged(spark, project).collect()]
    assert sorted(r.path for r in src.collect_files(spark, str(project)).collect()) == ["lib/util.py", "main.py"]
    assert src.find_repo_root(project / "lib") == project.resolve() and src.validate_root(project)
    with pytest.raises(ValueError):
        src.validate_root(project / "nowhere")


def test_removed_files_keep_their_embeddings_unless_fixed(spark, project, tmp_path):
    s = GraphSession(spark, str(project), f"file://{tmp_path}/g")
    s.graph("build", full_rebuild=True)
    s.graph("embed")
    gone = spark.createDataFrame([("main.py",)], "file_path string")
    s.store.remove_files(gone)
    assert s.store.table("embeddings").count() == 2 and s.store.table("nodes").count() == 2
    s.graph("build", full_rebuild=True)
    s.store.remove_files(gone, fixed=True)
    assert s.store.table("embeddings").count() == 1


def test_one_result_for_each_edge(spark, project, tmp_path):
    (project / "main.py").write_text("from lib.util import helper\n\ndef go():\n    helper(1)\n    return helper(2)\n")
    s = GraphSession(spark, str(project), f"file://{tmp_path}/g")
    s.graph("build", full_rebuild=True)
    q = s.graph("query", pattern="callers_of", target="lib/util.py::helper")
    assert [r["qualified_name"] for r in q["results"]] == ["main.py::go"] * 2 and sorted(e["line"] for e in q["edges"]) == [4, 5]


def test_other_folders_are_refused(spark, tmp_path):
    s = GraphSession(spark, str(tmp_path), f"file://{tmp_path}/g")
    assert s.graph("build", full_rebuild=True)["status"] == "error" and s.store.version() is None
    assert "no such folder" in GraphSession(spark, str(tmp_path / "x"), f"file://{tmp_path}/g").graph("stats")["error"]


# ---------------------------------------------------------------- versions


def _graph_of(spark, files, value="a"):
    from codeloom.graph import Graph
    from codeloom.schemas import EDGES, NODES

    nodes = [("File", f, f, f, 1, 2, "python", None, None, None, None, False, value, None) for f in files]
    edges = [("CONTAINS", f, f"{f}::x", f, 1, None) for f in files]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


@pytest.fixture
def stored(spark, tmp_path):
    from codeloom.store import GraphStore

    store = GraphStore(spark, f"file://{tmp_path}/g", buckets=8)
    g = _graph_of(spark, [f"f{i}.py" for i in range(60)])
    store.commit(nodes=g.nodes, edges=g.edges)
    return store


def test_an_update_writes_only_its_buckets(spark, stored):
    before = stored._latest()[1]
    paths = spark.createDataFrame([("f1.py",), ("f2.py",)], "file_path string")
    assert stored.replace_files(_graph_of(spark, ["f1.py"], "b"), paths, {"k": "v"}) == 2
    after = stored._latest()[1]
    changed = {b for b in after["nodes"] if after["nodes"][b] != before["nodes"].get(b)}
    assert 1 <= len(changed) <= 2 and {b for b in after["edges"] if after["edges"][b] != before["edges"].get(b)} == changed
    got = {r.file_path: r.file_hash for r in stored.table("nodes").collect()}
    assert got == {f"f{i}.py": "b" if i == 1 else "a" for i in range(60) if i != 2} and stored.metadata("k") == "v"
    assert stored.table("edges").count() == 59


def test_readers_see_whole_versions_only(spark, stored, tmp_path):
    half = tmp_path / "g" / "versions" / "000000000002.json"
    half.write_text('{"nodes": {"0": ')  # a writer that has just begun, or died
    assert stored.version() == 1 and stored.table("nodes").count() == 60
    half.unlink()
    stored._write("nodes", stored.table("nodes").limit(1), 8)  # data without a manifest
    assert stored.version() == 1 and stored.table("nodes").count() == 60


def test_the_second_of_two_writers_fails(spark, stored):
    from codeloom.store import ConcurrentWrite

    since = stored._latest()
    stored.commit(since=since, nodes=stored.table("nodes").where("file_path = 'f1.py'"))
    with pytest.raises(ConcurrentWrite):
        stored.commit(since=since, nodes=stored.table("nodes").limit(0))
    assert stored.version() == 2 and stored.table("nodes").count() == 1


def test_old_versions_go(spark, stored, tmp_path):
    paths = spark.createDataFrame([("f1.py",)], "file_path string")
    for _ in range(4):
        stored.replace_files(_graph_of(spark, ["f1.py"]), paths)
    folders = lambda: len(list((tmp_path / "g" / "data").iterdir()))
    before = folders()
    assert stored.vacuum() == before - folders() > 0
    assert stored._numbers() == [5, 4, 3] and stored.table("nodes").count() == 60


def test_the_environment_chooses_the_backend(spark, tmp_path, monkeypatch):
    for name in ("EMBEDDING_BACKEND", "LITELLM_PROXY_URL", "API_KEYS"):
        monkeypatch.delenv(name, raising=False)
    call = lambda texts: [[1.0]] * len(texts)
    assert GraphSession(spark, str(tmp_path), remote=call).backend.name == "hashing"
    monkeypatch.setenv("API_KEYS", "service:key")
    assert GraphSession(spark, str(tmp_path), remote=call).backend.name == "remote" and GraphSession(spark, str(tmp_path)).backend.name == "hashing"
    monkeypatch.setenv("EMBEDDING_BACKEND", "local")
    assert GraphSession(spark, str(tmp_path), remote=call).backend.name == "hashing"
