"""Writes as plans: upserts, per-file replacement, change sets. Nothing is updated in place; every operator returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EDGE_KEY, NODE_KEY


def keep_last(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key by ``order``; ties go to the greatest row. One aggregation with map-side combine."""
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return last.select(*key, "_r.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new`` rows replace ``old`` rows of equal key; within ``new`` the last by column ``seq``, where it has one, wins."""
    if "seq" in new.columns:
        new = keep_last(new, key, F.col("seq")).drop("seq")
    kept = old.join(new.select(*key).distinct(), key, "left_anti")
    return kept.select(*old.columns).unionByName(new.select(*old.columns))


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, NODE_KEY)


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, EDGE_KEY)


def remove_files(table: DataFrame, paths: DataFrame) -> DataFrame:
    """Without the rows of the given files. Edges of other files that point here stay."""
    return table.join(paths.select(F.col("file_path").alias("_p")).distinct(), F.col("file_path") == F.col("_p"), "left_anti")


def replace_files(old: DataFrame, new: DataFrame, paths: DataFrame, key: list[str]) -> DataFrame:
    """Every row of the given files goes, ``new`` comes in their place."""
    return upsert(remove_files(old, paths), new, key)


def set_metadata(old: DataFrame, values: dict[str, str]) -> DataFrame:
    new = old.sparkSession.createDataFrame(list(values.items()), "key string, value string")
    return upsert(old, new, ["key"])


def change_set(old: DataFrame, new: DataFrame, path: str = "path", digest: str = "file_hash") -> DataFrame:
    """(path, change) between two snapshots: added, removed or modified; equal hashes are no change."""
    a = old.select(F.col(path).alias("_o"), F.col(digest).alias("_oh"))
    b = new.select(F.col(path).alias("_n"), F.col(digest).alias("_nh"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("modified")
    both = a.join(b, F.col("_o") == F.col("_n"), "full")
    return both.where(~F.col("_oh").eqNullSafe(F.col("_nh")) | F.col("_o").isNull() | F.col("_n").isNull()).select(F.coalesce("_n", "_o").alias("path"), change.alias("change"))


def apply_changes(log: DataFrame, key: str, order: list[str], deleted: Column) -> DataFrame:
    """A change log's latest state: the last row of each key, without keys whose last row is a deletion."""
    last = keep_last(log.withColumn("_dead", deleted), [key], F.struct(*order))
    return last.where(~F.col("_dead")).drop("_dead")
