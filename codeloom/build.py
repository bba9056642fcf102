"""Full and incremental builds of a stored graph."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from .extract import extract
from .functions import detect_language, ignored
from .operators import traverse
from .shared import SIDE_BY_SIDE, written
from .sources import files as src
from .store import GraphStore


def _stamp(kind: str) -> dict[str, str]:
    return {"last_updated": datetime.now().strftime("%Y-%m-%dT%H:%M:%S"), "last_build_type": kind}


def full_build(store: GraphStore, root: str | Path) -> dict:
    """Parses every file below ``root``; what was stored of files that are gone goes. One bad file is an error row."""
    found = written(src.collect_files(store.spark, str(root)), "files")
    graph, counts, errors = extract(found)
    old = store.table("metadata")
    from .operators.dml import set_metadata

    store.commit(nodes=graph.nodes, edges=graph.edges, metadata=set_metadata(old, _stamp("full")))
    store.vacuum()
    n = counts.first()
    return {"files_parsed": n["files_parsed"], "total_nodes": n["total_nodes"], "total_edges": n["total_edges"], "errors": [r.asDict() for r in errors.collect()]}


def incremental_update(store: GraphStore, root: str | Path, base: str = "HEAD~1", changed: list[str] | None = None) -> dict:
    """Parses changed files and their dependents again, those whose hash differs from what is stored; removes missing ones.

    The paths that git reports are a list on the driver; hashing, comparing, parsing and replacing are one plan.
    """
    root, spark = Path(root), store.spark
    changed = src.changed_files(root, base) if changed is None else changed
    if not changed:
        return {"files_updated": 0, "total_nodes": 0, "total_edges": 0, "changed_files": [], "dependent_files": []}
    rows = lambda paths: spark.createDataFrame([(p,) for p in sorted(paths)], "file_path string")
    dependent = [r["dependent"] for r in traverse.dependents(store.graph(), rows(changed), few=True).select("dependent").distinct().collect()]
    everything = set(changed) | set(dependent)
    wanted = rows(everything).where(~ignored(F.col("file_path"), src.ignore_patterns(root)))
    missing = [p for p in everything if not (root / p).is_file()]
    gone = wanted.join(rows(missing), "file_path", "left_semi") if missing else wanted.limit(0)
    here = [str(root / p) for p in sorted(everything) if (root / p).is_file()]
    new, replaced, counts, errors = store.graph(), gone, None, None
    new = type(new)(new.nodes.limit(0), new.edges.limit(0))
    if here:
        content = spark.read.format("binaryFile").load(here)
        content = content.select(src.relative_path(F.col("path"), str(root)).alias("path"), "content", F.sha2("content", 256).alias("file_hash"))
        content = content.withColumn("language", detect_language(F.col("path"))).where(F.col("language").isNotNull())
        content = content.join(wanted.withColumnRenamed("file_path", "path"), "path", "left_semi")
        known = store.table("nodes").where(F.col("kind") == "File").select(F.col("file_path").alias("path"), "file_hash")
        stale = written(content.join(known, ["path", "file_hash"], "left_anti").select("path", "language", "content", "file_hash"), "files")
        new, counts, errors = extract(stale, known)
        replaced = gone.unionByName(stale.select(F.col("path").alias("file_path")))
    n, bad = (SIDE_BY_SIDE.submit(df.collect) if df is not None else None for df in (counts, errors))  # beside the write
    store.replace_files(new, replaced, _stamp("incremental"))
    store.vacuum()
    total = n.result()[0].asDict() if n else {"total_nodes": 0, "total_edges": 0}
    return {
        "files_updated": len(everything), "total_nodes": total["total_nodes"], "total_edges": total["total_edges"], "changed_files": list(changed), "dependent_files": sorted(dependent),
        "errors": [r.asDict() for r in bad.result()] if bad else [],
    }
