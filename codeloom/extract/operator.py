"""Extraction as a table function: files in, tagged rows out, then name resolution by joins.

Parsing is one Arrow-batched pass in which each file is by itself. What a file cannot know, the places of other files, is
settled afterwards: every import lists its candidate paths in order of preference, and an equi-join with the files' paths
picks the first that exists.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from . import blocks, python
from .model import Report

ROWS = (
    "rec string, file_path string, file_hash string, language string, error string, kind string, name string, qualified_name string, line_start int, line_end int, parent_name string, "
    "params string, return_type string, modifiers string, is_test boolean, extra map<string,string>, source_qualified string, target_qualified string, line int, module string, candidates array<string>"
)
_COLUMNS = [c.split()[0] for c in ROWS.split(", ")]


def parse(path: str, language: str, content: bytes) -> Report:
    """One file's report; empty for a language without extractor."""
    report = Report(path, language)
    text = content.decode("utf-8", "replace")
    if language == "python":
        report.file(text)
        python.extract(report, text)
    elif language in blocks.SYNTAX:
        report.file(text)
        blocks.extract(report, text)
    return report


def module_candidates(path: str, language: str, module: str) -> list[str]:
    """Paths that ``module`` may stand for when ``path`` imports it, best first."""
    folder = posixpath.dirname(path)
    if language == "python":
        inner, out = module.replace(".", "/"), []
        while True:
            base = posixpath.join(folder, inner)
            out += [f"{base}.py", f"{base}/__init__.py"]
            up = posixpath.dirname(folder)
            if up == folder or not folder:
                return out
            folder = up
    if language in ("javascript", "typescript", "tsx") and module.startswith("."):
        base = posixpath.normpath(posixpath.join(folder, module))
        stem = posixpath.splitext(base)[0]
        suffixes = (".ts", ".tsx", ".js", ".jsx")
        return [base, *(stem + s for s in suffixes), *(f"{base}/index{s}" for s in suffixes)]
    return []


def rows_of(path: str, language: str, digest: str | None, content: bytes) -> Iterable[dict]:
    same = {"file_path": path, "file_hash": digest, "language": language}
    try:
        report = parse(path, language, content)
    except Exception as e:  # one bad file is a row, not a failed job
        yield same | {"rec": "error", "error": f"{type(e).__name__}: {e}"}
        return
    for n in report.nodes:
        yield same | {"rec": "node"} | n
    for kind, source, target, line, module in report.edges:
        yield same | {"rec": "edge", "kind": kind, "source_qualified": source, "target_qualified": target, "line": line, "module": module, "candidates": module_candidates(path, language, module) if module else None}


def parse_files(files: DataFrame) -> DataFrame:
    """Tagged rows (``rec``: node, edge, error) of files (path, language, content, file_hash)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for b in batches:
            rows = [r for path, lang, digest, content in zip(b["path"], b["language"], b["file_hash"], b["content"], strict=True) for r in rows_of(path, lang or "", digest, bytes(content or b""))]
            out = pd.DataFrame(rows, columns=_COLUMNS, dtype=object)
            yield out.where(out.notna(), None)

    return files.select("path", "language", "file_hash", "content").mapInPandas(run, ROWS)


def resolve_edges(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges whose target is an imported name get ``file::name`` where a candidate path is among ``paths``; else they stay bare."""
    known = edges.where(F.col("candidates").isNotNull()).select("file_path", "module", F.posexplode(F.array_distinct("candidates")).alias("_rank", "_at"))
    hit = known.distinct().join(paths.select(F.col("path").alias("_p")).distinct(), F.col("_at") == F.col("_p"))
    best = hit.groupBy(F.col("file_path").alias("_f"), F.col("module").alias("_m")).agg(F.min_by("_at", "_rank").alias("_to"))
    joined = edges.join(best, (F.col("file_path") == F.col("_f")) & (F.col("module") == F.col("_m")), "left")
    target = F.when(F.col("_to").isNotNull(), F.concat("_to", F.lit("::"), "target_qualified")).otherwise(F.col("target_qualified"))
    return joined.withColumn("target_qualified", target).drop("_f", "_m", "_to", "module", "candidates")


_NODE = ["kind", "name", "qualified_name", "file_path", "line_start", "line_end", "language", "parent_name", "params", "return_type", "modifiers", "is_test", "file_hash", "extra"]
_EDGE = ["kind", "source_qualified", "target_qualified", "file_path", "line"]


def extract(files: DataFrame, known_paths: DataFrame | None = None) -> tuple[Graph, DataFrame, DataFrame]:
    """(graph, raw counts, errors) of files. Equal names and edges of one file are merged, the last one stays.

    ``known_paths`` (path) are further files that imports may refer to.
    """
    from ..operators.dml import keep_last
    from ..schemas import EDGE_KEY
    from ..shared import written

    rows = written(parse_files(files), "parsed")
    nodes = rows.where(F.col("rec") == "node").select(*_NODE)
    paths = files.select("path") if known_paths is None else files.select("path").unionByName(known_paths.select("path"))
    edges = resolve_edges(rows.where(F.col("rec") == "edge").select(*_EDGE, "module", "candidates"), paths)
    counts = rows.agg(F.count_if(F.col("rec") == "node").alias("total_nodes"), F.count_if(F.col("rec") == "edge").alias("total_edges"), F.count_if((F.col("rec") == "node") & (F.col("kind") == "File")).alias("files_parsed"))
    unique = keep_last(nodes, ["qualified_name"], F.struct("line_start", "line_end", "kind"))
    return Graph(unique, edges.dropDuplicates(EDGE_KEY).select(*_EDGE)), counts, rows.where(F.col("rec") == "error").select("file_path", "error")
