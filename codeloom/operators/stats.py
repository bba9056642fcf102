"""Counts over a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def counts_by_kind(g: Graph) -> DataFrame:
    """(relation, kind, n)."""
    each = lambda df, name: df.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "kind", "n")
    return each(g.nodes, "node").unionByName(each(g.edges, "edge"))


def languages(g: Graph) -> DataFrame:
    return g.nodes.where(F.coalesce("language", F.lit("")) != "").select("language").distinct()


def totals(g: Graph) -> DataFrame:
    """One row: total_nodes, total_edges, files_count, languages (number)."""
    n = g.nodes.agg(
        F.count(F.lit(1)).alias("total_nodes"), F.count_if(F.col("kind") == "File").alias("files_count"), F.count_distinct(F.when(F.col("language") != "", F.col("language"))).alias("languages")
    )
    return n.crossJoin(g.edges.agg(F.count(F.lit(1)).alias("total_edges")))  # one row by one row
