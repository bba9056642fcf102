"""A code graph out of relational tables: region, nation, customer, supplier, part, orders and lineitem.

Nations are files, customers and suppliers classes, orders functions or tests inside their customer, parts functions of a
brand's file. Line items are calls, dependencies, imports and tests. Everything is one declarative plan, so a query that
needs one kind of edge reads only the tables behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import qualified_name
from ..graph import Graph
from ..schemas import EDGE_KEY

NODE_COLUMNS = ["kind", "name", "qualified_name", "file_path", "line_start", "line_end", "language", "parent_name", "is_test"]


def _tables(spark: SparkSession, sf_dir: str):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nation_files(t) -> DataFrame:
    path = F.concat(F.lit("/repo/"), "r_name", F.lit("/"), "n_name", F.lit(".py"))
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", path.alias("file_path"))


def _node(df: DataFrame, kind: Column, name: Column, first: Column, last: Column, language: Column, parent: Column | None = None) -> DataFrame:
    parent = F.lit(None).cast("string") if parent is None else parent
    cols = {"kind": kind, "name": name, "file_path": F.col("file_path"), "line_start": first.cast("int"), "line_end": last.cast("int"), "language": language, "parent_name": parent}
    out = df.select(*[c.alias(n) for n, c in cols.items()])
    out = out.withColumn("qualified_name", qualified_name(F.col("kind"), F.col("file_path"), F.col("parent_name"), F.col("name")))
    return out.withColumn("is_test", F.col("kind") == "Test").select(*NODE_COLUMNS)


def _customers(t) -> DataFrame:
    return t("customer").join(_nation_files(t), F.col("c_nationkey") == F.col("n_nationkey"))


def _suppliers(t) -> DataFrame:
    return t("supplier").join(_nation_files(t), F.col("s_nationkey") == F.col("n_nationkey"))


def _order_kind() -> Column:
    return F.when(F.col("o_orderpriority").startswith("1"), "Test").otherwise("Function")


def _order_name() -> Column:
    return F.concat(F.when(F.col("o_orderpriority").startswith("1"), "test_order_").otherwise("order_"), F.col("o_orderkey").cast("string"))


def _part_file() -> Column:
    return F.concat(F.lit("/lib/"), F.col("p_brand"), F.lit(".go"))


def _part_name() -> Column:
    return F.replace("p_name", F.lit(" "), F.lit("_"))


def _part_parent() -> Column:
    return F.concat("p_type", F.col("p_partkey").cast("string"))


def _part_qualified() -> Column:
    return F.concat(_part_file(), F.lit("::"), _part_parent(), F.lit("."), _part_name())


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, one = _tables(spark, sf_dir), F.lit(1)
    hundreds = lambda c: F.floor(F.abs(F.col(c)) / 100)
    orders = t("orders").join(_customers(t), F.col("o_custkey") == F.col("c_custkey"))
    parts = [
        _node(_nation_files(t), F.lit("File"), F.col("file_path"), one, 1 + 40 * F.col("n_nationkey"), F.lit("python")),
        _node(_customers(t), F.lit("Class"), F.col("c_name"), 1 + F.col("c_custkey") % 1000, 1 + F.col("c_custkey") % 1000 + hundreds("c_acctbal"), F.lower("c_mktsegment")),
        _node(_suppliers(t), F.lit("Class"), F.col("s_name"), one, 1 + hundreds("s_acctbal"), F.lit("sql")),
        _node(orders, _order_kind(), _order_name(), one, F.greatest(F.lit(1).cast("long"), F.floor(F.col("o_totalprice") / 1000)), F.lower("c_mktsegment"), F.col("c_name")),
        _node(t("part").withColumn("file_path", _part_file()), F.lit("Function"), _part_name(), one, F.col("p_size"), F.lit("go"), _part_parent()),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as the tables give them, before equal ones are merged."""
    t = _tables(spark, sf_dir)
    dot = lambda file, *inner: F.concat(F.col(file), F.lit("::"), *inner)
    customers = _customers(t).select("c_custkey", "c_name", "file_path", dot("file_path", F.col("c_name")).alias("customer_q"))
    suppliers = _suppliers(t).select("s_suppkey", F.col("file_path").alias("s_file"), dot("file_path", F.col("s_name")).alias("supplier_q"))
    orders = t("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.select("o_orderkey", "file_path", "customer_q", _order_kind().alias("o_kind"), F.concat("customer_q", F.lit("."), _order_name()).alias("order_q"))
    items = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_returnflag").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    parts = t("part").select("p_partkey", _part_qualified().alias("part_q"), _part_name().alias("part_name"))
    with_part = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    with_supplier = items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))

    def edge(df: DataFrame, kind: str, source: Column, target: Column, line: Column = F.lit(1), file: str = "file_path") -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), source.alias("source_qualified"), target.alias("target_qualified"), F.col(file).alias("file_path"), line.cast("int").alias("line"))

    c, line = F.col, F.col("l_linenumber")
    found = [
        edge(customers, "CONTAINS", c("file_path"), c("customer_q")),
        edge(orders, "CONTAINS", c("customer_q"), c("order_q")),
        edge(suppliers, "CONTAINS", c("s_file"), c("supplier_q"), file="s_file"),
        edge(with_part, "CALLS", c("order_q"), F.when(c("l_returnflag") == "N", c("part_name")).otherwise(c("part_q")), line),
        edge(with_supplier, "DEPENDS_ON", c("order_q"), c("supplier_q"), line),
        edge(with_supplier.where((c("l_discount") == 0.1) & (c("file_path") != c("s_file"))), "IMPORTS_FROM", c("file_path"), c("s_file")),
        edge(with_part.where((c("o_kind") == "Test") & (c("l_returnflag") != "N")), "TESTED_BY", c("part_q"), c("order_q"), line),
        edge(t("part").withColumn("file_path", _part_file()), "INHERITS", _part_qualified(), c("p_brand")),
    ]
    out = found[0]
    for e in found[1:]:
        out = out.unionByName(e)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_edges(spark, sf_dir).dropDuplicates(EDGE_KEY)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir))


#: The same two relations in SQL, as common table expressions.
SQL = """
nf AS (SELECT n_nationkey, '/repo/' || r_name || '/' || n_name || '.py' AS file_path FROM nation JOIN region ON n_regionkey = r_regionkey),
cu AS (SELECT customer.*, file_path, file_path || '::' || c_name AS customer_q FROM customer JOIN nf ON c_nationkey = n_nationkey),
su AS (SELECT supplier.*, file_path AS s_file, file_path || '::' || s_name AS supplier_q FROM supplier JOIN nf ON s_nationkey = n_nationkey),
od AS (SELECT orders.*, cu.file_path, cu.c_name, cu.c_mktsegment, cu.customer_q, CASE WHEN o_orderpriority LIKE '1%' THEN 'Test' ELSE 'Function' END AS o_kind,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'test_order_' ELSE 'order_' END || o_orderkey AS o_name FROM orders JOIN cu ON o_custkey = c_custkey),
oq AS (SELECT od.*, customer_q || '.' || o_name AS order_q FROM od),
pt AS (SELECT part.*, '/lib/' || p_brand || '.go' AS file_path, replace(p_name, ' ', '_') AS part_name, '/lib/' || p_brand || '.go::' || p_type || p_partkey || '.' || replace(p_name, ' ', '_') AS part_q FROM part),
nodes AS (
  SELECT 'File' AS kind, file_path AS name, file_path AS qualified_name, file_path, 1 AS line_start, 1 + 40 * n_nationkey AS line_end, 'python' AS language, NULL::VARCHAR AS parent_name, false AS is_test FROM nf
  UNION ALL SELECT 'Class', c_name, customer_q, file_path, (1 + c_custkey % 1000)::INT, (1 + c_custkey % 1000 + floor(abs(c_acctbal) / 100))::INT, lower(c_mktsegment), NULL, false FROM cu
  UNION ALL SELECT 'Class', s_name, supplier_q, s_file, 1, (1 + floor(abs(s_acctbal) / 100))::INT, 'sql', NULL, false FROM su
  UNION ALL SELECT o_kind, o_name, order_q, file_path, 1, greatest(1, floor(o_totalprice / 1000))::INT, lower(c_mktsegment), c_name, o_kind = 'Test' FROM oq
  UNION ALL SELECT 'Function', part_name, part_q, file_path, 1, p_size, 'go', p_type || p_partkey, false FROM pt),
it AS (SELECT lineitem.*, oq.file_path, oq.order_q, oq.o_kind, pt.part_q, pt.part_name, su.supplier_q, su.s_file FROM lineitem JOIN oq ON l_orderkey = o_orderkey JOIN pt ON l_partkey = p_partkey JOIN su ON l_suppkey = s_suppkey),
raw_edges AS (
  SELECT 'CONTAINS' AS kind, file_path AS source_qualified, customer_q AS target_qualified, file_path, 1 AS line FROM cu
  UNION ALL SELECT 'CONTAINS', customer_q, order_q, file_path, 1 FROM oq
  UNION ALL SELECT 'CONTAINS', s_file, supplier_q, s_file, 1 FROM su
  UNION ALL SELECT 'CALLS', order_q, CASE WHEN l_returnflag = 'N' THEN part_name ELSE part_q END, file_path, l_linenumber FROM it
  UNION ALL SELECT 'DEPENDS_ON', order_q, supplier_q, file_path, l_linenumber FROM it
  UNION ALL SELECT 'IMPORTS_FROM', file_path, s_file, file_path, 1 FROM it WHERE l_discount = 0.1::DOUBLE AND file_path <> s_file
  UNION ALL SELECT 'TESTED_BY', part_q, order_q, file_path, l_linenumber FROM it WHERE o_kind = 'Test' AND l_returnflag <> 'N'
  UNION ALL SELECT 'INHERITS', part_q, p_brand, file_path, 1 FROM pt),
edges AS (SELECT DISTINCT * FROM raw_edges)
"""
