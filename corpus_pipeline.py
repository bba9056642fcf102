"""A training-corpus pipeline over ``documents``: quality rules, near-duplicate removal, benchmark decontamination,
personal-data redaction, sequence packing.

Every stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``docs``. ``ORACLE_SQL`` is None: sampling, tokenisation and packing have no SQL
form, so the pipeline is tested against brute force.

In every stage an empty table gives an empty one, extra columns are carried along whatever their names (the last stage
leaves them out), and texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import decontam, neardup, packing, pii, quality
from codeloom.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (operator 9). Judged row by row, in one pass, so repeated rows and ids share nothing.
    Null and empty texts have no words and go; a null language is judged by the text's script."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one of least id (operator 8); a row without an id only where its class has none,
    then the one of least text hash. A repeated row stays once. Null texts are copies of empty ones."""
    return neardup.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (operator 7). Rows that share an id share its verdict; rows without one are judged by their
    text. Null and empty texts hold nothing and stay; items without words match nothing."""
    return decontam.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced and ``n_chars``, where there is such a column, brought up to date (operator 3). Null and
    empty texts stay as they are (the length of null is null); repeated rows are redacted row by row."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length(F.col("text")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens (operator 2). Null text is empty: its closing id alone. Repeated rows are packed
    row by row; ties of length are broken by id, start and content."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("personal data", redact_pii),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
