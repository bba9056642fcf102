"""Point lookups and induced subgraphs.

Edge ends are strings that may name nothing, so edges meet nodes by left join wherever an unresolved end must stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sanitize_name
from ..graph import Graph


def node(g: Graph, qualified: str) -> DataFrame:
    return g.nodes.where(F.col("qualified_name") == qualified)


def nodes_in_file(g: Graph, path: str) -> DataFrame:
    return g.nodes.where(F.col("file_path") == path)


def files(g: Graph) -> DataFrame:
    """Paths that have a File node."""
    return g.nodes.where(F.col("kind") == "File").select("file_path").distinct()


def edges_from(g: Graph, qualified: str) -> DataFrame:
    return g.edges.where(F.col("source_qualified") == qualified)


def bare_name(qualified: Column) -> Column:
    """What follows the last ``::``; null without one."""
    return F.when(qualified.contains("::"), F.substring_index(qualified, "::", -1))


def edges_to(g: Graph, qualified: str) -> DataFrame:
    """Edges whose target is ``qualified``; if no edge of any kind has it, those whose target is its bare name."""
    exact = g.edges.where(F.col("target_qualified") == qualified)
    if "::" not in qualified or not exact.isEmpty():
        return exact
    return g.edges.where(F.col("target_qualified") == qualified.rsplit("::", 1)[1])


def edges_to_all(g: Graph, targets: DataFrame, kinds: list[str] | None = None, kind_first: bool = False, few: bool = False) -> DataFrame:
    """``edges_to`` for a whole column ``target`` at once: (target, *edge columns).

    ``kinds`` filters the result. By default the bare name is tried only for targets that no edge of any kind has; with
    ``kind_first`` kinds are filtered before that test. ``few``: there are few targets, so that test looks at the edges that end at
    one of them, not at the ends of all edges.
    """
    edges = g.edges
    wanted = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    tested = wanted if kind_first else edges
    exact = targets.join(wanted, F.col("target") == F.col("target_qualified"))
    ends = tested.select("target_qualified")
    if few:
        ends = ends.join(targets.select(F.col("target").alias("_t")), F.col("target_qualified") == F.col("_t"), "left_semi")
    missed = targets.join(ends.distinct(), F.col("target") == F.col("target_qualified"), "left_anti")
    bare = missed.withColumn("_bare", bare_name(F.col("target"))).where(F.col("_bare").isNotNull())
    bare = bare.join(wanted, F.col("_bare") == F.col("target_qualified")).drop("_bare")
    return exact.unionByName(bare)


def edges_by_target_name(g: Graph, name: str, kind: str = "CALLS") -> DataFrame:
    return g.edges.where((F.col("target_qualified") == name) & (F.col("kind") == kind))


def edges_among(g: Graph, names: DataFrame) -> DataFrame:
    """Edges with both ends in column ``qualified_name`` of ``names``."""
    names = names.select(F.col("qualified_name").alias("_q")).distinct()
    e = g.edges.join(names, F.col("source_qualified") == F.col("_q"), "left_semi")
    return e.join(names, F.col("target_qualified") == F.col("_q"), "left_semi")


def subgraph(g: Graph, names: DataFrame) -> Graph:
    """Nodes for each row of ``names`` (repeated rows repeat) and the edges among them."""
    found = names.select(F.col("qualified_name").alias("_q")).join(g.nodes, F.col("_q") == F.col("qualified_name")).drop("_q")
    return Graph(found, edges_among(g, names))


def node_view(nodes: DataFrame) -> DataFrame:
    """The public columns of nodes, names sanitized; a missing language is the empty string."""
    clean = lambda c: sanitize_name(F.col(c)).alias(c)
    return nodes.select("kind", clean("name"), clean("qualified_name"), "file_path", "line_start", "line_end", F.coalesce("language", F.lit("")).alias("language"), clean("parent_name"), "is_test")


def edge_view(edges: DataFrame) -> DataFrame:
    return edges.select("kind", sanitize_name(F.col("source_qualified")).alias("source"), sanitize_name(F.col("target_qualified")).alias("target"), "file_path", "line")
