"""Review context: which lines and nodes of changed files matter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..graph import Graph
from .traverse import Impact, changed_nodes, impact_edges, impacted_files, impacted_nodes

FIRST_LINES = 50


def merged_ranges(nodes: DataFrame, n_lines: DataFrame | None = None, fixed: bool = False) -> DataFrame:
    """(file_path, lo, hi): half-open line ranges around nodes, merged where they touch or leave one line between.

    ``n_lines`` (file_path, n) cuts ranges at the end of the file. ``fixed`` leaves out File nodes, which otherwise make
    every range the whole file.
    """
    rows = nodes.where(F.col("line_start").isNotNull() & F.col("line_end").isNotNull())
    if fixed:
        rows = rows.where(F.col("kind") != "File")
    rows = rows.select("file_path", F.greatest(F.lit(0), F.col("line_start") - 3).alias("lo"), (F.col("line_end") + 2).alias("hi"))
    if n_lines is not None:
        rows = rows.join(n_lines.select(F.col("file_path").alias("_f"), F.col("n").alias("_n")), F.col("file_path") == F.col("_f")).withColumn("hi", F.least("hi", "_n")).drop("_f", "_n")
    rows = rows.distinct()
    order = W.partitionBy("file_path").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    island = rows.withColumn("_new", F.when(F.col("lo") <= before + 1, 0).otherwise(1)).withColumn("_i", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy("file_path", "_i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_i")


def file_lines(files: DataFrame, path: str = "file_path", text: str = "text") -> DataFrame:
    """(file_path, i, line), i from 0."""
    return files.select(F.col(path).alias("file_path"), F.posexplode(F.split(F.col(text), "\n")).alias("i", "line"))


def snippets(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file_path, snippet): numbered lines of the merged ranges, with ``...`` between ranges.

    Ranges are joined to whole files by path; lines are cut out of the file's array, so no line is shuffled.
    """
    at = ranges.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))
    joined = files.join(at.withColumnRenamed("file_path", "_f"), F.col("file_path") == F.col("_f"), "left")
    numbered = F.transform(F.split("text", "\n"), lambda line, i: F.concat((i + 1).cast("string"), F.lit(": "), line))
    part = lambda r: F.array_join(F.slice(F.col("_lines"), r.lo + 1, F.greatest(r.hi - r.lo, F.lit(0))), "\n")
    chosen = F.array_join(F.transform("ranges", part), "\n...\n")
    joined = joined.withColumn("_lines", numbered)
    return joined.select("file_path", F.when(F.col("ranges").isNull(), F.array_join(F.slice("_lines", 1, FIRST_LINES), "\n")).otherwise(chosen).alias("snippet"))


def untested(g: Graph, changed: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Changed functions that are no tests and no source of a TESTED_BY edge."""
    tested = (g.edges if edges is None else edges).where(F.col("kind") == "TESTED_BY").select(F.col("source_qualified").alias("_q")).distinct()
    return changed.where((F.col("kind") == "Function") & ~F.col("is_test")).join(tested, F.col("qualified_name") == F.col("_q"), "left_anti")


def guidance_counts(g: Graph, impact: Impact) -> DataFrame:
    """One row: what review guidance looks at."""
    edges = impact_edges(g, impact)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [
        one(untested(g, changed_nodes(g, impact), edges), "untested_functions"),
        one(impacted_nodes(g, impact), "impacted_nodes"),
        one(edges.where(F.col("kind").isin("INHERITS", "IMPLEMENTS")), "inheritance_edges"),
        one(impacted_files(g, impact), "impacted_files"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row by one row
    return out


#: From so many on, advice is given.
WIDE_NODES, WIDE_FILES = 21, 4


def guidance_text(counts: dict, first_untested: list[str]) -> str:
    """Advice in words, one line for each of ``guidance_counts`` that calls for some."""
    n_files, n_nodes, n_types, n_bare = (counts[k] for k in ("impacted_files", "impacted_nodes", "inheritance_edges", "untested_functions"))
    advice = {
        f"{n_bare} of the changed functions have no linked test, among them {', '.join(first_untested)}.": n_bare > 0,
        f"Subtypes: {n_types} inheritance or implementation links touch the change; see that overriding code still keeps its contract.": n_types > 0,
        f"Reach: {n_nodes} further nodes depend on the change. Read their call sites.": n_nodes >= WIDE_NODES,
        f"Spread: {n_files} other files are reached, so smaller steps may be easier to review.": n_files >= WIDE_FILES,
    }
    return "\n".join(f"* {line}" for line, applies in advice.items() if applies) or "* Nothing stands out: the change stays local and is covered."
