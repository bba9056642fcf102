import fnmatch
import math

import pytest
from pyspark.sql import functions as F

from codeloom import functions as fn
from codeloom.sources.files import DEFAULT_IGNORES, status_paths


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("path,language", [("a/b.py", "python"), ("A.TSX", "tsx"), ("x/.py", None), ("noext", None), ("lib.d.ts", "typescript"), ("dir.py/readme", None), ("m.H", "c")])
def test_language(spark, path, language):
    assert one(spark, fn.detect_language, path) == language


@pytest.mark.parametrize("path", ["node_modules/a/b.js", "pkg/node_modules/x.js", "a/b/c.lock", "yarn.lock", "x/yarn.lock2", "build/x", "src/build/x", "a\nb.lock", ".git/config", "src/a.py"])
def test_ignored_like_fnmatch(spark, path):
    assert one(spark, lambda c: fn.ignored(c, DEFAULT_IGNORES), path) == any(fnmatch.fnmatchcase(path, p) for p in DEFAULT_IGNORES)


def test_no_patterns_ignore_nothing(spark):
    assert one(spark, lambda c: fn.ignored(c, []), "x") is False


@pytest.mark.parametrize("content,binary", [(b"abc", False), (b"a\0b", True), (b"x" * 8192 + b"\0", False), (b"", False), (None, True), (b"\xff\xfe\0", True)])
def test_binary(spark, content, binary):
    assert one(spark, fn.binary_content, content, "binary") is binary


@pytest.mark.parametrize("name,test", [("test_x", True), ("TestX", True), ("x_test", True), ("a.spec.b", True), ("latest", False), ("my_test_x", False), ("x_spec", True)])
def test_test_names(spark, name, test):
    assert one(spark, fn.is_test_name, name) is test


def test_sanitize(spark):
    assert one(spark, fn.sanitize_name, "a\x00b\tc\nd\x1fe") == "ab\tc\nde"
    assert len(one(spark, fn.sanitize_name, "x" * 300)) == 256


@pytest.mark.parametrize("a,b,want", [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 2.0], 0.0), ([1.0], [1.0, 2.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0, 1.0], [-1.0, -1.0], -1.0)])
def test_cosine(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(fn.cosine_similarity(F.col("a"), F.col("b")).alias("c")).first()
    assert math.isclose(row.c, want, abs_tol=1e-12)


def test_status_lines(spark):
    lines = [(" M a.py",), ("R  old.py -> new.py",), ("?? x",), ("M",), ("",)]
    got = [r.path for r in status_paths(spark.createDataFrame(lines, "value string")).collect()]
    assert got == ["a.py", "new.py", "x"]


def test_node_text(spark):
    df = spark.createDataFrame([("f", "Function", "C", "(a)", "int", "python"), ("p", "File", None, None, "", "")], "n string, k string, p string, a string, r string, l string")
    got = [r.t for r in df.select(fn.node_text(*[F.col(c) for c in "nkparl"]).alias("t")).collect()]
    assert got == ["f function in C (a) returns int python", "p"]
