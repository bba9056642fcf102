"""Files in the cluster's shared folder, for results that are read more than once."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Threads for jobs that share the cluster. They stay, since each has its own connection to the driver's JVM.
SIDE_BY_SIDE = ThreadPoolExecutor(4, thread_name_prefix="codeloom")

_own: str | None = None
_written: list[list[str]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster names it. Only a local master, as in tests, may leave it unset: then it is a temporary
    folder; on a cluster, where executors would each write to a disk of their own, that is an error."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="codeloom-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def written(df: DataFrame, label: str, outer: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends here and every reader sees the same rows.

    The files are ordinary Parquet in shared storage, so a lost executor costs only the tasks it was running. ``outer``: the
    table outlives the innermost ``own_tables``.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[max(len(_written) - 1 - outer, 0)].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def own_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that ``written`` made within it, and no others: what reads them must be stored by then.

    The shuffle files behind them go too, as the driver collects its garbage: Spark keeps them until nobody refers to them.
    """
    _written.append([])
    try:
        yield
    finally:
        _delete(spark, _written.pop())
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def drop_written(spark: SparkSession) -> None:
    """Deletes every table that ``written`` has made and no ``own_tables`` holds: results that read them must be stored first."""
    _delete(spark, _written[-1])
