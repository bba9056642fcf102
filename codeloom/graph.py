"""A code graph: two relations and their adjacency."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    @property
    def spark(self):
        return self.nodes.sparkSession

    def ends(self) -> DataFrame:
        """(src, dst) of every edge in both directions, as often as there are edges."""
        ends = F.explode(
            F.array(
                F.struct(F.col("source_qualified").alias("src"), F.col("target_qualified").alias("dst")),
                F.struct(F.col("target_qualified").alias("src"), F.col("source_qualified").alias("dst")),
            )
        ).alias("e")
        return self.edges.select(ends).select("e.src", "e.dst")

    def adjacency(self) -> DataFrame:
        """Distinct undirected neighbour pairs (src, dst); edge kinds and parallel edges do not matter to traversal."""
        return self.ends().distinct()
