"""Relations of the code graph."""

from __future__ import annotations

from pyspark.sql import types as T

NODES = T.StructType([
    T.StructField("kind", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("qualified_name", T.StringType(), False),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("line_start", T.IntegerType()),
    T.StructField("line_end", T.IntegerType()),
    T.StructField("language", T.StringType()),
    T.StructField("parent_name", T.StringType()),
    T.StructField("params", T.StringType()),
    T.StructField("return_type", T.StringType()),
    T.StructField("modifiers", T.StringType()),
    T.StructField("is_test", T.BooleanType(), False),
    T.StructField("file_hash", T.StringType()),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
])

EDGES = T.StructType([
    T.StructField("kind", T.StringType(), False),
    T.StructField("source_qualified", T.StringType(), False),
    T.StructField("target_qualified", T.StringType(), False),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("line", T.IntegerType(), False),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
])

EMBEDDINGS = T.StructType([
    T.StructField("qualified_name", T.StringType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType()), False),
    T.StructField("text_hash", T.StringType(), False),
    T.StructField("provider", T.StringType(), False),
])

METADATA = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType())])

NODE_KEY = ["qualified_name"]
EDGE_KEY = ["kind", "source_qualified", "target_qualified", "file_path", "line"]

NODE_KINDS = ("File", "Class", "Function", "Type", "Test")
EDGE_KINDS = ("CALLS", "IMPORTS_FROM", "INHERITS", "IMPLEMENTS", "CONTAINS", "TESTED_BY", "DEPENDS_ON")
