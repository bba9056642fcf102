"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import own_tables, written  # noqa: F401

#: A word is a run of characters other than ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Writes a table to the shared folder and reads it back: lineage is cut and later readers see the same rows.
materialize = written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(
    df: DataFrame, schema: T.StructType | str, make: Callable[[], Callable[..., Iterable[tuple]]], rows_per_batch: int = 4096
) -> DataFrame:
    """Arrow-batched flat map. ``make`` runs once per task and returns ``f(*column lists) -> rows``.

    Output leaves in slices of ``rows_per_batch`` rows, so a task holds one input batch and one output slice.
    """
    spark = df.sparkSession
    out = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    del spark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, type=x.type) for c, x in zip(cols, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for start in range(0, batch.num_rows, rows_per_batch):
                part = batch.slice(start, rows_per_batch)
                for row in f(*(c.to_pylist() for c in part.columns)):
                    held.append(row)
                    if len(held) >= rows_per_batch:
                        yield flush()
                        held = []
        if held:
            yield flush()

    return df.mapInArrow(run, out)


def with_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: other columns, whatever their names, never reach an operator's inner joins."""
    return df.select(*[F.col(f"`{n}`") for n in names])


class WordMemo:
    """word -> value of ``make(list of words)``; forgets all at ``most`` words, so memory is bounded.

    ``at(word)`` looks up a word that ``ensure`` has seen since.
    """

    def __init__(self, make: Callable[[list[str]], Iterable], most: int = 800_000):
        self.known: dict = {}
        self.make, self.most, self.at = make, most, self.known.__getitem__

    def ensure(self, words: Iterable[str]) -> None:
        wanted = set(words)
        missing = list(wanted.difference(self.known))
        if not missing:
            return
        if len(self.known) + len(missing) > self.most:
            self.known.clear()
            missing = list(wanted)
        self.known.update(zip(missing, self.make(missing), strict=True))


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a public vocabulary file; ``folder`` overrides the installed package."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
