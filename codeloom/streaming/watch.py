"""Live graph updates from a stream of file changes, and debouncing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..extract import extract
from ..functions import binary_content, detect_language, file_hash, ignored
from ..shared import own_tables
from ..sources.files import DEFAULT_IGNORES
from ..store import GraphStore

#: A change: path, op (``write`` or ``delete``), content, and its time.
CHANGES = "path string, op string, content binary, ts timestamp"


def debounced(changes: DataFrame, key: str, ts: str, gap: str = "300 milliseconds") -> DataFrame:
    """(key, first_ts, last_ts, events): changes of one key join until a quiet gap. Batch and streaming; a stream needs a
    watermark on ``ts`` of timestamp type for its sessions to close."""
    out = changes.groupBy(key, F.session_window(ts, gap).alias("_w")).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("events"))
    return out.drop("_w")


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each path in a batch; of equal times a deletion."""
    order = F.struct("ts", (F.col("op") == "delete").alias("d"))
    return changes.groupBy("path").agg(F.max_by(F.struct("op", "content", "ts"), order).alias("c")).select("path", "c.*")


def watch(changes: DataFrame, apply: Callable[[DataFrame, DataFrame], None], checkpoint: str, interval: str = "300 milliseconds", available_now: bool = False) -> StreamingQuery:
    """Applies every micro-batch: ``apply(written, deleted)`` with columns (path, content) and (path).

    The trigger interval is the debounce: all changes of one interval are one batch, in which a path's last change counts.
    """

    def batch(df: DataFrame, _: int) -> None:
        last = latest(df).persist()
        try:
            if not last.isEmpty():
                apply(last.where(F.col("op") != "delete").select("path", "content"), last.where(F.col("op") == "delete").select("path"))
        finally:
            last.unpersist()

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def change_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of ``CHANGES`` from JSON lines in files that an editor, a hook or another job drops into ``folder``; content is base64."""
    return spark.readStream.schema(CHANGES).json(folder)


def into(store: GraphStore, patterns: list[str] | tuple[str, ...] = DEFAULT_IGNORES) -> Callable[[DataFrame, DataFrame], None]:
    """What ``watch`` applies to keep ``store`` up to date: written files are parsed and replace what the graph has of them, deleted ones
    go. Ignored, binary and unknown files count as deleted. A batch that is delivered again changes nothing."""

    def apply(wrote: DataFrame, deleted: DataFrame) -> None:
        spark = wrote.sparkSession
        with own_tables(spark):
            files = wrote.withColumn("language", detect_language(F.col("path"))).withColumn("file_hash", file_hash(F.col("content")))
            files = files.where(F.col("language").isNotNull() & ~ignored(F.col("path"), patterns) & ~binary_content(F.col("content")))
            known = store.table("nodes").where(F.col("kind") == "File").select(F.col("file_path").alias("path"))
            graph, _, _ = extract(files, known)
            paths = wrote.select("path").unionByName(deleted.select("path")).select(F.col("path").alias("file_path"))
            store.replace_files(graph, paths, {"last_build_type": "watch"})
        store.vacuum()

    return apply
