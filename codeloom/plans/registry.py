"""Queries of the code-graph engine over whole tables, each with the SQL that gives the same rows.

The graph is the adapter's. Patterns run for every node at once; traversal, search and vector queries take the argument
that the feature takes (changed files, words, a query vector).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract import extract
from ..functions import binary_content, detect_language, ignored, is_test_file, is_test_name, node_text, sanitize_name
from ..graph import Graph
from ..operators import dml, embed, lookup, patterns, review, search, stats, traverse
from ..schemas import EDGE_KEY
from ..shared import written
from ..sources import adapter, files
from ..sources.files import DEFAULT_IGNORES

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

BRAND_FILE = "/lib/Brand#2.go"  #: the changed file of the traversal queries
WORDS = "order 12"
ROOT = "/repo"


def query(sql: str | None, graph: bool = True):
    """Registers a query; ``graph`` puts the adapter's tables before its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = f"WITH RECURSIVE {adapter.SQL} {sql}" if graph else sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _graph(spark: SparkSession, sf_dir: str) -> Graph:
    return adapter.graph(spark, sf_dir)


def _stored(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph as tables in the shared folder, for queries that go over its relations several times."""
    g = _graph(spark, sf_dir)
    return Graph(written(g.nodes, "nodes"), written(g.edges, "edges"))


def _walked(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph for a walk, to which equal edges do not matter: each level filters the edges as they are read."""
    return Graph(adapter.nodes(spark, sf_dir), adapter.raw_edges(spark, sf_dir))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _all_names(g: Graph) -> DataFrame:
    return g.nodes.select(F.col("qualified_name").alias("target"))


def _brand_files(g: Graph) -> DataFrame:
    return g.spark.createDataFrame([(BRAND_FILE,)], "file_path string")


# ---------------------------------------------------------------- relations and lookups


@query("SELECT * FROM nodes")
def graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir).nodes


@query("SELECT * FROM edges")
def graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir).edges


@query("SELECT DISTINCT file_path FROM nodes WHERE kind = 'File'")
def graph_files(spark, sf_dir):
    return lookup.files(_graph(spark, sf_dir))


@query("""SELECT source_qualified, kind, count(*)::BIGINT AS n, min(target_qualified) AS first_target FROM edges GROUP BY ALL""")
def edges_by_source(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return g.edges.groupBy("source_qualified", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("target_qualified").alias("first_target"))


# Every node's incoming edges, with the bare name where no edge of any kind has the node's full name.
_TO = """, miss AS (SELECT qualified_name FROM nodes WHERE qualified_name NOT IN (SELECT target_qualified FROM edges)),
incoming AS (SELECT n.qualified_name AS target, e.* FROM nodes n JOIN edges e ON e.target_qualified = n.qualified_name
  UNION ALL SELECT m.qualified_name, e.* FROM miss m JOIN edges e ON e.target_qualified = regexp_extract(m.qualified_name, '(?s)^.*::(.*)$', 1) AND contains(m.qualified_name, '::'))"""


@query(_TO + " SELECT target, kind, count(*)::BIGINT AS n, min(source_qualified) AS first_source FROM incoming GROUP BY ALL")
def edges_by_target(spark, sf_dir):
    g = _stored(spark, sf_dir)
    return lookup.edges_to_all(g, _all_names(g)).groupBy("target", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("source_qualified").alias("first_source"))


@query("SELECT n.qualified_name, e.file_path, count(*)::BIGINT AS n FROM nodes n JOIN edges e ON e.kind = 'CALLS' AND e.target_qualified = n.name GROUP BY ALL")
def edges_by_target_name(spark, sf_dir):
    """Calls of every node's bare name, by calling file."""
    g = _graph(spark, sf_dir)
    calls = g.edges.where(F.col("kind") == "CALLS").select("target_qualified", "file_path")
    names = g.nodes.select("qualified_name", "name")
    # Calls of one name are counted before they meet the nodes of that name.
    counted = calls.groupBy("target_qualified", "file_path").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counted, F.col("name") == F.col("target_qualified")).select("qualified_name", "file_path", "n")


@query("""SELECT e.* FROM edges e WHERE source_qualified IN (SELECT qualified_name FROM nodes WHERE kind IN ('Class', 'Test'))
AND target_qualified IN (SELECT qualified_name FROM nodes WHERE kind IN ('Class', 'Test'))""")
def edges_among(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return lookup.edges_among(g, g.nodes.where(F.col("kind").isin("Class", "Test"))).select(*EDGE_KEY)


@query("SELECT n.* FROM nodes n JOIN (SELECT source_qualified AS q FROM edges WHERE kind = 'TESTED_BY') s ON s.q = n.qualified_name")
def subgraph_nodes(spark, sf_dir):
    """Nodes for a list of names with repetitions: the sources of all TESTED_BY edges."""
    g = _graph(spark, sf_dir)
    names = g.edges.where(F.col("kind") == "TESTED_BY").select(F.col("source_qualified").alias("qualified_name"))
    return lookup.subgraph(g, names).nodes


@query("SELECT kind, name, qualified_name, file_path, line_start, line_end, language, parent_name, is_test FROM nodes")
def node_view(spark, sf_dir):
    return lookup.node_view(_graph(spark, sf_dir).nodes)


@query("SELECT kind, source_qualified AS source, target_qualified AS target, file_path, line FROM edges")
def edge_view(spark, sf_dir):
    return lookup.edge_view(_graph(spark, sf_dir).edges)


# ---------------------------------------------------------------- patterns, for all nodes

_CALLERS = _TO + """, direct AS (SELECT i.target, i.source_qualified, i.line, n.name AS caller FROM incoming i LEFT JOIN nodes n ON n.qualified_name = i.source_qualified WHERE i.kind = 'CALLS'),
rest AS (SELECT qualified_name AS target, name FROM nodes WHERE qualified_name NOT IN (SELECT target FROM direct WHERE caller IS NOT NULL)),
callers AS (SELECT * FROM direct UNION ALL SELECT r.target, e.source_qualified, e.line, n.name FROM rest r JOIN edges e ON e.kind = 'CALLS' AND e.target_qualified = r.name LEFT JOIN nodes n ON n.qualified_name = e.source_qualified)"""


@query(_CALLERS + " SELECT target, source_qualified, line, caller FROM callers")
def callers_of(spark, sf_dir):
    g = _stored(spark, sf_dir)
    return patterns.callers_of(g, _all_names(g)).select("target", "source_qualified", "line", F.col("node_name").alias("caller"))


_PLACE = "/repo/AFRICA/KENYA.py"


@query(f"SELECT * FROM edges WHERE source_qualified = '{_PLACE}'")
def edges_from_one(spark, sf_dir):
    return lookup.edges_from(_graph(spark, sf_dir), _PLACE)


@query(f"SELECT * FROM nodes WHERE file_path = '{_PLACE}'")
def nodes_in_file(spark, sf_dir):
    return lookup.nodes_in_file(_graph(spark, sf_dir), _PLACE)


@query("SELECT * FROM nodes WHERE qualified_name = '/repo/AFRICA/KENYA.py' OR qualified_name LIKE '%::Supplier#000000001'")
def node_by_name(spark, sf_dir):
    """A file and a class by their qualified names."""
    g = _graph(spark, sf_dir)
    supplier = g.nodes.where(F.col("name") == "Supplier#000000001").select("qualified_name").first()
    return lookup.node(g, _PLACE).unionByName(lookup.node(g, supplier[0] if supplier else ""))


@query("SELECT * FROM edges WHERE target_qualified = 'Brand#12'")
def edges_to_bare_name(spark, sf_dir):
    """No edge ends at the brand's full name, so those to its bare name are found."""
    return lookup.edges_to(_stored(spark, sf_dir), "/lib/Brand#12.go::Brand#12")


@query("SELECT * FROM edges WHERE kind = 'CALLS' AND target_qualified IN (SELECT min(part_name) FROM pt)")
def calls_of_bare_name(spark, sf_dir):
    g = _graph(spark, sf_dir)
    name = _read(spark, sf_dir, "part").agg(F.min(F.replace("p_name", F.lit(" "), F.lit("_")))).first()[0]
    return lookup.edges_by_target_name(g, name)


@query("""SELECT e.* FROM edges e WHERE source_qualified IN (SELECT source_qualified FROM edges WHERE kind = 'TESTED_BY') AND target_qualified IN (SELECT source_qualified FROM edges WHERE kind = 'TESTED_BY')
UNION ALL SELECT e.* FROM edges e WHERE source_qualified IN (SELECT qualified_name FROM nodes WHERE kind = 'File') AND target_qualified IN (SELECT qualified_name FROM nodes WHERE kind = 'File')""")
def subgraph_edges(spark, sf_dir):
    """Edges among the sources of TESTED_BY edges, and among files."""
    g = _stored(spark, sf_dir)
    tested = g.edges.where(F.col("kind") == "TESTED_BY").select(F.col("source_qualified").alias("qualified_name"))
    among = lookup.subgraph(g, tested).edges.unionByName(lookup.subgraph(g, g.nodes.where(F.col("kind") == "File").select("qualified_name")).edges)
    return among.select(*EDGE_KEY)


@query("SELECT e.source_qualified AS target, e.target_qualified AS callee, e.line, n.kind AS callee_kind, n.file_path AS callee_file FROM edges e LEFT JOIN nodes n ON n.qualified_name = e.target_qualified WHERE e.kind = 'CALLS' AND e.source_qualified IN (SELECT qualified_name FROM nodes)")
def callees_of(spark, sf_dir):
    g = _graph(spark, sf_dir)
    found = patterns.callees_of(g, _all_names(g))
    return found.select("target", F.col("target_qualified").alias("callee"), "line", F.col("node_kind").alias("callee_kind"), F.col("node_file_path").alias("callee_file"))


@query("SELECT source_qualified AS target, target_qualified AS import_target, line FROM edges WHERE kind = 'IMPORTS_FROM' AND source_qualified IN (SELECT qualified_name FROM nodes)")
def imports_of(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return patterns.imports_of(g, _all_names(g))


@query("SELECT n.qualified_name AS target, e.source_qualified AS importer, e.file_path AS file, e.line FROM nodes n JOIN edges e ON e.kind = 'IMPORTS_FROM' AND e.target_qualified = n.file_path WHERE n.kind = 'File'")
def importers_of(spark, sf_dir):
    """For every file. A file's own node stands for it; other nodes of the file give the same rows."""
    g = _graph(spark, sf_dir)
    return patterns.importers_of(g, g.nodes.where(F.col("kind") == "File").select(F.col("qualified_name").alias("target")))


@query("SELECT e.source_qualified AS target, e.target_qualified AS child, n.kind AS node_kind, n.name AS node_name, n.file_path AS node_file_path FROM edges e JOIN nodes n ON n.qualified_name = e.target_qualified WHERE e.kind = 'CONTAINS' AND e.source_qualified IN (SELECT qualified_name FROM nodes)")
def children_of(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return patterns.children_of(g, _all_names(g))


@query(_TO + " SELECT i.target, i.source_qualified AS test, n.kind AS node_kind, n.name AS node_name FROM incoming i JOIN nodes n ON n.qualified_name = i.source_qualified WHERE i.kind = 'TESTED_BY'")
def tests_linked(spark, sf_dir):
    """The first branch of ``tests_for`` alone."""
    g = _stored(spark, sf_dir)
    return patterns.tests_linked(g, _all_names(g))


@query(_TO + """, linked AS (SELECT i.target, i.source_qualified AS test, n.kind AS node_kind, n.name AS node_name FROM incoming i JOIN nodes n ON n.qualified_name = i.source_qualified WHERE i.kind = 'TESTED_BY'),
terms AS (SELECT qualified_name AS target, unnest(['test_' || name, 'Test' || name]) AS term FROM nodes),
split AS (SELECT DISTINCT term, list_filter(string_split_regex(lower(term), '\\s+'), lambda w: w <> '') AS words FROM terms),
hits AS (SELECT s.term, n.*, row_number() OVER (PARTITION BY s.term ORDER BY n.name, n.qualified_name) AS r FROM split s JOIN nodes n
  ON (lower(n.name) LIKE '%' || s.words[1] || '%' OR lower(n.qualified_name) LIKE '%' || s.words[1] || '%')
  AND (len(s.words) = 1 OR len(list_filter(s.words, lambda w: NOT (lower(n.name) LIKE '%' || w || '%' OR lower(n.qualified_name) LIKE '%' || w || '%'))) = 0))
SELECT * FROM linked UNION ALL SELECT t.target, h.qualified_name, h.kind, h.name FROM terms t JOIN hits h ON h.term = t.term AND h.r <= 10 AND h.is_test
WHERE NOT EXISTS (SELECT 1 FROM linked l WHERE l.target = t.target AND l.test = h.qualified_name)""")
def tests_for(spark, sf_dir):
    """Tests that are linked or named after the node, as for a single target. Of other kinds' edges only the ends are looked at, so
    these are neither merged nor stored."""
    linked, other = adapter.edges(spark, sf_dir).where("kind = 'TESTED_BY'"), adapter.raw_edges(spark, sf_dir).where("kind <> 'TESTED_BY'")
    g = Graph(written(adapter.nodes(spark, sf_dir), "nodes"), written(linked, "edges").unionByName(other))
    return patterns.tests_of(g, _all_names(g))


_BRANDS = ", targets AS (SELECT DISTINCT file_path || '::' || p_brand AS target, p_brand FROM pt)"


@query(_BRANDS + " SELECT t.target, e.source_qualified AS inheritor, n.kind AS node_kind FROM targets t JOIN edges e ON e.kind IN ('INHERITS', 'IMPLEMENTS') AND e.target_qualified = t.p_brand LEFT JOIN nodes n ON n.qualified_name = e.source_qualified")
def inheritors_of(spark, sf_dir):
    """Of every brand: no edge has a brand's full name, so the bare name is found."""
    g = _graph(spark, sf_dir)
    brands = _read(spark, sf_dir, "part").select(F.concat(F.lit("/lib/"), "p_brand", F.lit(".go::"), "p_brand").alias("target")).distinct()
    return patterns.inheritors_of(g, brands).select("target", F.col("source_qualified").alias("inheritor"), "node_kind")


@query(_TO + """, targets AS (SELECT qualified_name AS target FROM nodes WHERE kind IN ('Class', 'Function') UNION SELECT file_path || '::' || p_brand FROM pt),
kinds AS (SELECT * FROM edges WHERE kind IN ('INHERITS', 'IMPLEMENTS')), hit AS (SELECT t.target, k.* FROM targets t JOIN kinds k ON k.target_qualified = t.target),
bare AS (SELECT t.target, k.* FROM targets t JOIN kinds k ON k.target_qualified = regexp_extract(t.target, '(?s)^.*::(.*)$', 1) WHERE contains(t.target, '::') AND t.target NOT IN (SELECT target_qualified FROM kinds))
SELECT x.target, x.source_qualified AS inheritor, n.kind AS node_kind FROM (SELECT * FROM hit UNION ALL SELECT * FROM bare) x LEFT JOIN nodes n ON n.qualified_name = x.source_qualified""")
def inheritors_of_kind_first(spark, sf_dir):
    """``fixed``: of every class, function and brand, by inheritance edges alone before the bare name is tried."""
    g = _graph(spark, sf_dir)
    brands = _read(spark, sf_dir, "part").select(F.concat(F.lit("/lib/"), "p_brand", F.lit(".go::"), "p_brand").alias("target"))
    targets = g.nodes.where(F.col("kind").isin("Class", "Function")).select(F.col("qualified_name").alias("target")).union(brands).distinct()
    return patterns.inheritors_of(g, targets, fixed=True).select("target", F.col("source_qualified").alias("inheritor"), "node_kind")


@query("SELECT file_path AS target, kind, name, qualified_name, line_start, line_end, is_test FROM nodes")
def file_summary(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return patterns.file_summary(g, g.nodes.select(F.col("file_path").alias("target")).distinct())


_TARGETS = "SELECT qualified_name AS target FROM nodes WHERE kind = 'File' UNION SELECT replace(p_name, ' ', '_') FROM part UNION SELECT p_brand FROM part UNION SELECT c_name FROM customer"


@query(f""", t AS ({_TARGETS}), h AS (SELECT t.target, max((q.qualified_name IS NOT NULL)::INT) AS exact FROM t LEFT JOIN nodes q ON q.qualified_name = t.target GROUP BY t.target),
c AS (SELECT h.target, count(*) AS found FROM h JOIN nodes n ON h.exact = 0 AND len(trim(h.target)) > 0
  AND len(list_filter(string_split_regex(lower(h.target), '\\s+'), lambda w: w <> '' AND NOT (lower(n.name) LIKE '%' || w || '%' OR lower(n.qualified_name) LIKE '%' || w || '%'))) = 0 GROUP BY h.target),
m AS (SELECT h.target, CASE WHEN exact = 1 THEN 1 ELSE coalesce(found, 0) END::BIGINT AS hits FROM h LEFT JOIN c USING (target))
SELECT target, hits, CASE WHEN hits = 1 THEN 'ok' WHEN hits > 1 THEN 'ambiguous' ELSE 'not_found' END AS status FROM m""")
def resolve_target_status(spark, sf_dir):
    """By keyword search as a single target is resolved: every word in the name or the qualified name."""
    nodes = written(adapter.nodes(spark, sf_dir), "nodes")
    return patterns.resolution_status(Graph(nodes, adapter.edges(spark, sf_dir)), _mixed_targets(spark, sf_dir))


def _mixed_targets(spark, sf_dir) -> DataFrame:
    g, part = _graph(spark, sf_dir), _read(spark, sf_dir, "part")
    parts = [
        g.nodes.where(F.col("kind") == "File").select(F.col("qualified_name").alias("target")), part.select(F.replace("p_name", F.lit(" "), F.lit("_"))),
        part.select("p_brand"), _read(spark, sf_dir, "customer").select("c_name"),
    ]
    targets = parts[0]
    for p in parts[1:]:
        targets = targets.union(p)
    return targets.distinct()


# ---------------------------------------------------------------- traversal

_IMPACT = f""", und AS (SELECT source_qualified AS s, target_qualified AS d FROM edges UNION SELECT target_qualified, source_qualified FROM edges),
l0 AS (SELECT DISTINCT qualified_name AS name FROM nodes WHERE file_path = '{BRAND_FILE}'),
l1 AS (SELECT DISTINCT d AS name FROM und WHERE s IN (SELECT name FROM l0) AND d NOT IN (SELECT name FROM l0)),
l2 AS (SELECT DISTINCT d AS name FROM und WHERE s IN (SELECT name FROM l1) AND d NOT IN (SELECT name FROM l0) AND d NOT IN (SELECT name FROM l1)),
lv AS (SELECT name, 0 AS dist FROM l0 UNION ALL SELECT name, 1 FROM l1 UNION ALL SELECT name, 2 FROM l2)"""
_NO_CAP = 1 << 62


@query(_IMPACT + " SELECT n.qualified_name, n.kind, lv.dist FROM lv JOIN nodes n ON n.qualified_name = lv.name WHERE dist > 0")
def impact_nodes(spark, sf_dir):
    g = _walked(spark, sf_dir)
    return traverse.impacted_nodes(g, traverse.impact_radius(g, _brand_files(g), 2, _NO_CAP)).select("qualified_name", "kind", "dist")


@query(_IMPACT + " SELECT DISTINCT n.file_path FROM lv JOIN nodes n ON n.qualified_name = lv.name WHERE dist > 0")
def impact_files(spark, sf_dir):
    g = _walked(spark, sf_dir)
    return traverse.impacted_files(g, traverse.impact_radius(g, _brand_files(g), 2, _NO_CAP))


@query(_IMPACT + " SELECT e.* FROM edges e WHERE source_qualified IN (SELECT name FROM lv) AND target_qualified IN (SELECT name FROM lv)")
def impact_edges(spark, sf_dir):
    g = _walked(spark, sf_dir)
    return traverse.impact_edges(g, traverse.impact_radius(g, _brand_files(g), 2, _NO_CAP)).select(*EDGE_KEY).distinct()


@query(_IMPACT + """, c AS (SELECT (SELECT count(*) FROM l0) AS n0, (SELECT count(*) FROM l1) AS n1, (SELECT count(*) FROM l2) AS n2)
SELECT n0 + n1 > 500 OR n0 + n1 + n2 > 500 AS truncated, CASE WHEN n0 + n1 > 500 THEN n1 ELSE n1 + n2 END::BIGINT AS total_impacted FROM c""")
def impact_truncated(spark, sf_dir):
    """The default node cap: the level that passes it is kept whole, and the traversal stops there."""
    g = _walked(spark, sf_dir)
    i = traverse.impact_radius(g, _brand_files(g), 2, 500)
    return spark.createDataFrame([(i.truncated, i.total_impacted)], "truncated boolean, total_impacted long")


@query(_TO + """, used AS (SELECT n.file_path, i.file_path AS dependent FROM incoming i JOIN nodes n ON n.qualified_name = i.target WHERE i.kind IN ('CALLS', 'IMPORTS_FROM', 'INHERITS', 'IMPLEMENTS')
  UNION SELECT f.file_path, e.file_path FROM (SELECT DISTINCT file_path FROM nodes) f JOIN edges e ON e.kind = 'IMPORTS_FROM' AND e.target_qualified = f.file_path)
SELECT DISTINCT file_path, dependent FROM used WHERE file_path <> dependent""")
def dependents(spark, sf_dir):
    g = _stored(spark, sf_dir)
    return traverse.dependents(g, g.nodes.select("file_path"))


# ---------------------------------------------------------------- search and size

_HIT = "(lower(name) LIKE '%order%' OR lower(qualified_name) LIKE '%order%') AND (lower(name) LIKE '%12%' OR lower(qualified_name) LIKE '%12%')"


@query(f"SELECT kind, name, qualified_name FROM nodes WHERE {_HIT}")
def search_nodes_multiword(spark, sf_dir):
    return search.search_nodes(_graph(spark, sf_dir), WORDS, limit=None).select("kind", "name", "qualified_name")


@query(f"SELECT kind, name, qualified_name FROM nodes WHERE {_HIT} AND kind = 'Test' ORDER BY name, qualified_name LIMIT 20")
def search_with_kind(spark, sf_dir):
    return search.search_nodes(_graph(spark, sf_dir), WORDS, kind="Test").select("kind", "name", "qualified_name")


@query("""SELECT name, qualified_name, CASE WHEN lower(name) = 'order_1' THEN 0 WHEN starts_with(lower(name), 'order_1') THEN 1 ELSE 2 END AS score
FROM (SELECT * FROM nodes WHERE lower(name) LIKE '%order_1%' OR lower(qualified_name) LIKE '%order_1%' ORDER BY name, qualified_name LIMIT 40) ORDER BY score, name, qualified_name LIMIT 20""")
def search_ranked(spark, sf_dir):
    return search.search_ranked(_graph(spark, sf_dir), "order_1").select("name", "qualified_name", "score")


@query("""SELECT name, qualified_name, 2 - starts_with(lower(name), '1')::INT AS score FROM (SELECT * FROM nodes WHERE lower(name) LIKE '%1%' OR lower(qualified_name) LIKE '%1%' ORDER BY name, qualified_name LIMIT 40)
WHERE kind = 'File' ORDER BY score, name, qualified_name LIMIT 20""")
def search_ranked_kind(spark, sf_dir):
    """The kind is looked at after the cut, so hits of that kind are lost."""
    return search.search_ranked(_graph(spark, sf_dir), "1", kind="File").select("name", "qualified_name", "score")


@query("""SELECT name, qualified_name, CASE WHEN lower(name) = '1' THEN 0 ELSE 2 - starts_with(lower(name), '1')::INT END AS score FROM (SELECT * FROM nodes WHERE (lower(name) LIKE '%1%' OR lower(qualified_name) LIKE '%1%') AND kind = 'Class' ORDER BY name, qualified_name LIMIT 40)
ORDER BY score, name, qualified_name LIMIT 20""")
def search_ranked_kind_first(spark, sf_dir):
    """``fixed``: of that kind alone."""
    return search.search_ranked(_graph(spark, sf_dir), "1", kind="Class", fixed=True).select("name", "qualified_name", "score")


@query("SELECT kind, qualified_name, line_end - line_start + 1 AS line_count, CASE WHEN starts_with(file_path, '/repo/') THEN substr(file_path, 7) ELSE file_path END AS relative_path FROM nodes WHERE line_end - line_start + 1 >= 50 ORDER BY line_count DESC, qualified_name LIMIT 50")
def large_functions(spark, sf_dir):
    return search.large_functions(_graph(spark, sf_dir), ROOT).select("kind", "qualified_name", "line_count", "relative_path")


@query("SELECT qualified_name, line_end - line_start + 1 AS line_count FROM nodes WHERE line_end - line_start + 1 BETWEEN 10 AND 200 AND kind = 'Function' AND file_path ILIKE '%LIB/%'")
def nodes_by_size(spark, sf_dir):
    return search.nodes_by_size(_graph(spark, sf_dir), 10, 200, "Function", "LIB/", None).select("qualified_name", "line_count")


@query("""SELECT file_path, line, kind, name, qualified_name, line_start, line_end FROM (SELECT n.file_path, p.line, n.kind, n.name, n.qualified_name, n.line_start, n.line_end,
row_number() OVER (PARTITION BY n.file_path, p.line ORDER BY n.line_end - n.line_start, n.qualified_name) AS r FROM (SELECT DISTINCT file_path, line FROM edges) p JOIN nodes n ON n.file_path = p.file_path AND p.line BETWEEN n.line_start AND n.line_end) WHERE r = 1""")
def innermost_at(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return search.innermost_at(g, g.edges.select("file_path", "line").distinct())


# ---------------------------------------------------------------- counts


@query("SELECT 'node' AS relation, kind, count(*)::BIGINT AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind")
def graph_stats_by_kind(spark, sf_dir):
    return stats.counts_by_kind(_graph(spark, sf_dir))


@query("SELECT (SELECT count(*) FROM nodes)::BIGINT AS total_nodes, (SELECT count(*) FROM nodes WHERE kind = 'File')::BIGINT AS files_count, (SELECT count(DISTINCT language) FROM nodes WHERE language <> '')::BIGINT AS languages, (SELECT count(*) FROM edges)::BIGINT AS total_edges")
def graph_stats_total(spark, sf_dir):
    return stats.totals(_graph(spark, sf_dir))


@query("SELECT DISTINCT language FROM nodes WHERE language <> ''")
def languages(spark, sf_dir):
    return stats.languages(_graph(spark, sf_dir))


# ---------------------------------------------------------------- review

_FLAGS = _IMPACT + """, ie AS (SELECT e.* FROM edges e WHERE source_qualified IN (SELECT name FROM lv) AND target_qualified IN (SELECT name FROM lv)),
im AS (SELECT n.* FROM lv JOIN nodes n ON n.qualified_name = lv.name WHERE dist > 0)
SELECT (SELECT count(*) FROM nodes WHERE file_path = '/lib/Brand#2.go' AND kind = 'Function' AND NOT is_test AND qualified_name NOT IN (SELECT source_qualified FROM ie WHERE kind = 'TESTED_BY'))::BIGINT AS untested_functions,
(SELECT count(*) FROM im)::BIGINT AS impacted_nodes, (SELECT count(*) FROM ie WHERE kind IN ('INHERITS', 'IMPLEMENTS'))::BIGINT AS inheritance_edges, (SELECT count(DISTINCT file_path) FROM im)::BIGINT AS impacted_files"""


@query(_FLAGS)
def review_guidance_counts(spark, sf_dir):
    g = _stored(spark, sf_dir)
    return review.guidance_counts(g, traverse.impact_radius(g, _brand_files(g), 2, _NO_CAP))


@query("SELECT qualified_name, file_path FROM nodes WHERE kind = 'Function' AND NOT is_test AND qualified_name NOT IN (SELECT source_qualified FROM edges WHERE kind = 'TESTED_BY')")
def untested_functions(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return review.untested(g, g.nodes).select("qualified_name", "file_path")


@query(""", r AS (SELECT DISTINCT file_path, greatest(0, line_start - 3) AS lo, line_end + 2 AS hi FROM nodes WHERE kind <> 'File'),
b AS (SELECT *, max(hi) OVER (PARTITION BY file_path ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r),
i AS (SELECT *, sum(CASE WHEN lo <= p + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY file_path ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM b)
SELECT file_path, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY file_path, g""")
def line_ranges_merged(spark, sf_dir):
    return review.merged_ranges(_graph(spark, sf_dir).nodes, fixed=True)


@query(""", r AS (SELECT DISTINCT file_path, greatest(0, line_start - 3) AS lo, line_end + 2 AS hi FROM nodes),
b AS (SELECT *, max(hi) OVER (PARTITION BY file_path ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r),
i AS (SELECT *, sum(CASE WHEN lo <= p + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY file_path ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM b)
SELECT file_path, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY file_path, g""")
def line_ranges_with_files(spark, sf_dir):
    """As review context takes them: a File node makes its file one range."""
    return review.merged_ranges(_graph(spark, sf_dir).nodes)


@query("SELECT doc_id::VARCHAR AS file_path, array_to_string(list_transform(range(0, least(len(l), 50)), lambda x: (x + 1)::VARCHAR || ': ' || l[x + 1]), chr(10)) AS snippet FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)", graph=False)
def first_lines_snippet(spark, sf_dir):
    """Files without any node: their first lines."""
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "text")
    none = spark.createDataFrame([], "file_path string, lo int, hi int")
    return review.snippets(d, none)


@query("""WITH f AS (SELECT doc_id::VARCHAR AS file_path, string_split(text, chr(10)) AS l, 1 + n_chars % 7 AS s FROM documents),
r AS (SELECT file_path, l, greatest(0, s - 3) AS lo, least(len(l), s + 3) AS hi FROM f UNION ALL SELECT file_path, l, 6, least(len(l), 11) FROM f),
b AS (SELECT *, max(hi) OVER (PARTITION BY file_path ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r),
i AS (SELECT *, sum(CASE WHEN lo <= p + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY file_path ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM b),
m AS (SELECT file_path, min(lo) AS lo, max(hi) AS hi, any_value(l) AS l FROM i GROUP BY file_path, g),
p AS (SELECT file_path, lo, array_to_string(list_transform(range(lo, hi), lambda x: (x + 1)::VARCHAR || ': ' || l[x + 1]), chr(10)) AS part FROM m)
SELECT file_path, string_agg(part, chr(10) || '...' || chr(10) ORDER BY lo) AS snippet FROM p GROUP BY file_path""", graph=False)
def numbered_snippet(spark, sf_dir):
    """Snippets of every document as a file, around two line ranges each."""
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "text", "n_chars")
    start = (1 + F.col("n_chars") % 7).cast("int")
    one = d.select("file_path", F.lit("Function").alias("kind"), start.alias("line_start"), (start + 1).alias("line_end"))
    two = d.select("file_path", F.lit("Function").alias("kind"), F.lit(9).alias("line_start"), F.lit(9).alias("line_end"))
    sizes = d.select("file_path", F.size(F.split("text", "\n")).alias("n"))
    return review.snippets(d, review.merged_ranges(one.unionByName(two), sizes))


# ---------------------------------------------------------------- vectors


@query("""SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q
ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, vec_id LIMIT 20""", graph=False)
def cosine_topk(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    q = e.orderBy("vec_id").limit(1).collect()[0]["embedding"]
    return embed.top_k(e, q, 20, "vec_id", "embedding").select("vec_id", F.round("similarity", 4).alias("similarity"))


@query("""SELECT vec_id, CASE WHEN vec_id % 3 = 2 THEN round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) ELSE 0.0 END AS similarity
FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q""", graph=False)
def cosine_of_odd_vectors(spark, sf_dir):
    """A third of the vectors without length, a third one number short: their similarity is zero."""
    e = _read(spark, sf_dir, "embeddings")
    q = e.orderBy("vec_id").limit(1).collect()[0]["embedding"]
    third = F.col("vec_id") % 3
    odd = F.when(third == 0, F.transform("embedding", lambda x: (x * 0).cast("float"))).when(third == 1, F.slice("embedding", 1, F.size("embedding") - 1)).otherwise(F.col("embedding"))
    return embed.top_k(e.withColumn("embedding", odd), q, None, "vec_id", "embedding").select("vec_id", F.round("similarity", 4).alias("similarity"))


@query(""", v AS (SELECT c.customer_q AS qualified_name, e.embedding FROM embeddings e JOIN cu c ON c.c_custkey = e.vec_id WHERE vec_id % 2 = 0
  UNION ALL SELECT p.part_q, e.embedding FROM embeddings e JOIN pt p ON p.p_partkey = e.vec_id WHERE vec_id % 2 = 1 UNION ALL SELECT 'gone', embedding FROM embeddings WHERE vec_id = 0),
s AS (SELECT qualified_name, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS x FROM v, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY x DESC, qualified_name LIMIT 30)
SELECT n.kind, n.name, s.qualified_name, round(s.x, 4) AS similarity_score FROM s JOIN nodes n ON n.qualified_name = s.qualified_name WHERE n.kind = 'Class' ORDER BY s.x DESC, s.qualified_name LIMIT 15""")
def semantic_search(spark, sf_dir):
    """Classes near a vector, among classes, functions and a name that is no node. The kind is looked at after the cut."""
    g, e = _graph(spark, sf_dir), _read(spark, sf_dir, "embeddings")
    q = e.orderBy("vec_id").limit(1).collect()[0]["embedding"]
    customers = g.nodes.where((F.col("kind") == "Class") & F.col("name").startswith("Customer")).select("qualified_name", F.substring("name", 10, 9).cast("long").alias("k"))
    parts = g.nodes.where(F.col("file_path").startswith("/lib/")).select("qualified_name", F.regexp_extract("parent_name", r"(\d+)$", 1).cast("long").alias("k"))
    even = e.where(F.col("vec_id") % 2 == 0).join(customers, F.col("vec_id") == F.col("k"))
    odd = e.where(F.col("vec_id") % 2 == 1).join(parts, F.col("vec_id") == F.col("k"))
    gone = e.where(F.col("vec_id") == 0).select(F.lit("gone").alias("qualified_name"), "embedding")
    vectors = even.select("qualified_name", "embedding").union(odd.select("qualified_name", "embedding")).union(gone).withColumnRenamed("embedding", "vector")
    return embed.semantic_search(g, vectors, q, "Class", 15).select("kind", "name", "qualified_name", "similarity_score")


@query("""SELECT label, vec_id, similarity, rank FROM (SELECT label, vec_id, similarity, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id)::INT AS rank FROM
(SELECT q.label, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS similarity FROM embeddings e, (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) q)) WHERE rank <= 5""", graph=False)
def cosine_topk_by_kind(spark, sf_dir):
    """Nearest five of each label's first vector; the ten query vectors are sent to every task."""
    e = _read(spark, sf_dir, "embeddings")
    queries = e.groupBy(F.col("label").alias("query")).agg(F.min_by("embedding", "vec_id").alias("q"))
    return embed.nearest_batch(e, queries, "vec_id", "embedding", 5).withColumnRenamed("query", "label")


@query("""SELECT qualified_name, concat_ws(' ', nullif(name, ''), CASE WHEN kind <> 'File' THEN lower(kind) END, 'in ' || nullif(parent_name, ''), nullif(language, '')) AS text FROM nodes""")
def node_texts(spark, sf_dir):
    n, none = _graph(spark, sf_dir).nodes, F.lit(None).cast("string")
    return n.select("qualified_name", node_text(F.col("name"), F.col("kind"), F.col("parent_name"), none, none, F.col("language")).alias("text"))


@query("""SELECT qualified_name, sha256(concat_ws(' ', nullif(name, ''), lower(kind), 'in ' || nullif(parent_name, ''), nullif(language, ''))) AS text_hash FROM nodes WHERE kind NOT IN ('File', 'Class')""")
def embed_pending(spark, sf_dir):
    """Classes are embedded already; the rest is pending."""
    n = _graph(spark, sf_dir).nodes
    done = embed.texts_of(n.where(F.col("kind") == "Class")).select("qualified_name", "text_hash", F.lit("hashing").alias("provider"))
    return embed.pending(n, done, "hashing").select("qualified_name", "text_hash")


_HASHED = """, f AS (SELECT DISTINCT file_path FROM nodes WHERE kind = 'File'), t AS (SELECT qualified_name, concat_ws(' ', nullif(name, ''), lower(kind), 'in ' || nullif(parent_name, ''), nullif(language, '')) AS text
  FROM nodes SEMI JOIN f USING (file_path) WHERE kind <> 'File'),
parts AS (SELECT qualified_name, unnest(list_concat(list_filter(string_split(lower(text), ' '), lambda w: w <> ''), list_transform(range(1, greatest(len(text) - 1, 1)), lambda i: substr(lower(text), i, 3)))) AS part FROM t),
c AS (SELECT qualified_name, (md5_number_lower(part) % 64)::INT AS i, sum(CASE WHEN md5_number_lower(part) >= 9223372036854775808 THEN 1 ELSE -1 END) AS x FROM parts GROUP BY ALL),
v AS (SELECT t.qualified_name, list_transform(range(64), lambda k: coalesce(m[k], 0)) AS x FROM t JOIN (SELECT qualified_name, map(list(i), list(x)) AS m FROM c GROUP BY qualified_name) USING (qualified_name)),
s AS (SELECT qualified_name, list_transform(x, lambda z: round(10000 * z / greatest(list_max(list_transform(x, lambda y: abs(y))), 1))::BIGINT) AS x FROM v)
SELECT s.qualified_name, sha256(t.text) AS text_hash, 'hashing' AS provider, md5(array_to_string(s.x, ',')) AS digest FROM s JOIN t USING (qualified_name)"""


@query(_HASHED)
def embed_all_nodes(spark, sf_dir):
    """Vectors of all nodes of files that have a File node, by the hashing backend. The digest is that of every vector's numbers as
    ten-thousandths of its greatest."""
    g = _graph(spark, sf_dir)
    made = embed.embed(embed.texts_of(embed.embeddable(g)), embed.HashingBackend(64))
    most = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    parts = F.transform("vector", lambda x: F.round(10_000 * x.cast("double") / F.col("_most")).cast("long").cast("string"))
    made = made.withColumn("_most", F.when(most > 0, most).otherwise(1.0))
    return made.select("qualified_name", "text_hash", "provider", F.md5(F.array_join(parts, ",")).alias("digest"))


# ---------------------------------------------------------------- extraction

#: A source file of every customer, which imports from the next one's.
_SOURCE = """import os
from src.c_{n} import f_{n}

class Base{k}:
    def run(self, x):
        return f_{n}(x)

class Sub{k}(Base{k}):
    pass

def f_{k}(x):
    return helper(x)

def test_f_{k}():
    f_{k}(2)
"""
_FILES = "WITH f AS (SELECT c_custkey AS k, c_custkey + 1 AS n, 'src/c_' || c_custkey || '.py' AS p FROM customer)"


def _project(spark: SparkSession, sf_dir: str) -> Graph:
    key = lambda shift: F.replace(F.replace(F.lit(_SOURCE), F.lit("{k}"), F.col("c_custkey").cast("string")), F.lit("{n}"), (F.col("c_custkey") + shift).cast("string"))
    c = _read(spark, sf_dir, "customer").select(F.concat(F.lit("src/c_"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("path"), F.encode(key(1), "UTF-8").alias("content"))
    return extract(c.select("path", F.lit("python").alias("language"), "content", F.sha2("content", 256).alias("file_hash")))[0]


@query(_FILES + """ SELECT 'File' AS kind, p AS name, p AS qualified_name, 1 AS line_start, 16 AS line_end, NULL AS parent_name, NULL AS params, false AS is_test FROM f
UNION ALL SELECT 'Class', 'Base' || k, p || '::Base' || k, 4, 6, NULL, NULL, false FROM f UNION ALL SELECT 'Function', 'run', p || '::Base' || k || '.run', 5, 6, 'Base' || k, '(self, x)', false FROM f
UNION ALL SELECT 'Class', 'Sub' || k, p || '::Sub' || k, 8, 9, NULL, NULL, false FROM f UNION ALL SELECT 'Function', 'f_' || k, p || '::f_' || k, 11, 12, NULL, '(x)', false FROM f
UNION ALL SELECT 'Test', 'test_f_' || k, p || '::test_f_' || k, 14, 15, NULL, '()', true FROM f""", graph=False)
def extracted_nodes(spark, sf_dir):
    return _project(spark, sf_dir).nodes.select("kind", "name", "qualified_name", "line_start", "line_end", "parent_name", "params", "is_test")


@query(_FILES + """, e AS (SELECT 'IMPORTS_FROM' AS kind, p AS source_qualified, 'os' AS target_qualified, p AS file_path, 1 AS line FROM f UNION ALL SELECT 'IMPORTS_FROM', p, 'src.c_' || n, p, 2 FROM f
UNION ALL SELECT 'CONTAINS', p, p || '::Base' || k, p, 4 FROM f UNION ALL SELECT 'CONTAINS', p || '::Base' || k, p || '::Base' || k || '.run', p, 5 FROM f UNION ALL SELECT 'CONTAINS', p, p || '::Sub' || k, p, 8 FROM f
UNION ALL SELECT 'CONTAINS', p, p || '::f_' || k, p, 11 FROM f UNION ALL SELECT 'CONTAINS', p, p || '::test_f_' || k, p, 14 FROM f UNION ALL SELECT 'INHERITS', p || '::Sub' || k, 'Base' || k, p, 8 FROM f
UNION ALL SELECT 'CALLS', p || '::f_' || k, 'helper', p, 12 FROM f UNION ALL SELECT 'CALLS', p || '::test_f_' || k, p || '::f_' || k, p, 15 FROM f
UNION ALL SELECT 'CALLS', f.p || '::Base' || f.k || '.run', coalesce(g.p || '::', '') || 'f_' || f.n, f.p, 6 FROM f LEFT JOIN f g ON g.k = f.n)
SELECT * FROM e""", graph=False)
def extracted_edges(spark, sf_dir):
    """Calls of imported names end at the file that defines them, where it is in the project."""
    return _project(spark, sf_dir).edges


# ---------------------------------------------------------------- writes and incremental update


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id", graph=False)
def upsert_latest(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return dml.keep_last(e, ["user_id"], F.struct("ts", "event_id")).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id FROM (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id) WHERE last_type <> 'error'", graph=False)
def apply_change_log(spark, sf_dir):
    """Events as a change log of files (users): an error event deletes."""
    e = _read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return dml.apply_changes(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id")


@query("""SELECT *, 'old' AS state FROM edges WHERE kind = 'CALLS' AND line < 4 AND (source_qualified, target_qualified, file_path, line) NOT IN (SELECT (source_qualified, target_qualified, file_path, line) FROM raw_edges WHERE kind = 'CALLS' AND line IN (2, 5))
UNION ALL SELECT DISTINCT *, 'new' FROM raw_edges WHERE kind = 'CALLS' AND line IN (2, 5)""")
def upsert_edges(spark, sf_dir):
    """Raw calls, some of them equal, over a table that has a part of them already: equal keys leave one row, the new one."""
    calls = adapter.raw_edges(spark, sf_dir).where(F.col("kind") == "CALLS")
    old = calls.where("line < 4").dropDuplicates(EDGE_KEY).withColumn("state", F.lit("old"))
    return dml.upsert_edges(old, calls.where("line IN (2, 5)").withColumn("state", F.lit("new")).withColumn("seq", F.lit(1)))


@query("SELECT * FROM edges WHERE NOT starts_with(file_path, '/repo/ASIA/')")
def remove_file_data(spark, sf_dir):
    g = _graph(spark, sf_dir)
    gone = g.nodes.where(F.col("file_path").startswith("/repo/ASIA/")).select("file_path")
    return dml.remove_files(g.edges, gone)


@query("SELECT kind, name, qualified_name, file_path, CASE WHEN starts_with(file_path, '/repo/ASIA/') THEN line_end + 1 ELSE line_end END AS line_end FROM nodes WHERE NOT (starts_with(file_path, '/repo/ASIA/') AND kind = 'Class')")
def replace_file(spark, sf_dir):
    """Files of one folder come back one line longer and without classes."""
    n = _graph(spark, sf_dir).nodes.select("kind", "name", "qualified_name", "file_path", "line_end")
    new = n.where(F.col("file_path").startswith("/repo/ASIA/") & (F.col("kind") != "Class")).withColumn("line_end", F.col("line_end") + 1)
    return dml.replace_files(n, new, n.where(F.col("file_path").startswith("/repo/ASIA/")).select("file_path"), ["qualified_name"])


@query("""SELECT coalesce(o.doc_id, n.doc_id) AS path, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE lang <> 'fr') o FULL JOIN (SELECT doc_id, sha256(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS h FROM documents WHERE lang <> 'es') n ON o.doc_id = n.doc_id
WHERE o.h IS DISTINCT FROM n.h""", graph=False)
def hash_changed_files(spark, sf_dir):
    """Two snapshots of the documents: one without French, one without Spanish and with German edited."""
    d = _read(spark, sf_dir, "documents")
    old = d.where(F.col("lang") != "fr").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("file_hash"))
    text = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = d.where(F.col("lang") != "es").select(F.col("doc_id").alias("path"), F.sha2(text, 256).alias("file_hash"))
    return dml.change_set(old, new)


@query("""SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*)::BIGINT AS events FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g
FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events)) GROUP BY user_id, g""", graph=False)
def debounce_batches(spark, sf_dir):
    """Changes of one file join a batch until a quiet gap of half an hour."""
    from ..streaming.watch import debounced

    return debounced(_read(spark, sf_dir, "events"), "user_id", "ts", "30 minutes")


# ---------------------------------------------------------------- functions


@query("SELECT doc_id, substr(regexp_replace(text, '[\\x00-\\x08\\x0B-\\x1F]', '', 'g'), 1, 256) AS clean FROM documents", graph=False)
def sanitize_names(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", sanitize_name(F.col("text")).alias("clean"))


_PATHS = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'src/node_modules/' WHEN 2 THEN 'build/' WHEN 3 THEN 'tests/' ELSE 'src/' END || replace(p_name, ' ', '_') || CASE p_size % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.min.js' WHEN 2 THEN '.lock' WHEN 3 THEN '.TS' WHEN 4 THEN '_test.go' WHEN 5 THEN '' ELSE '.rs' END AS path FROM part"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up path of every part."""
    p = _read(spark, sf_dir, "part")
    pick = lambda c, n, xs: F.element_at(F.array(*map(F.lit, xs)), (F.col(c) % n).cast("int") + 1)
    folder = pick("p_partkey", 6, ["node_modules/", "src/node_modules/", "build/", "tests/", "src/", "src/"])
    suffix = pick("p_size", 7, [".py", ".min.js", ".lock", ".TS", "_test.go", "", ".rs"])
    return p.select("p_partkey", F.concat(folder, F.replace("p_name", F.lit(" "), F.lit("_")), suffix).alias("path"))


@query(f"SELECT p_partkey, path, path LIKE 'node_modules/%' OR path LIKE 'build/%' OR path LIKE '%.min.js' OR path LIKE '%.lock' AS ignored FROM ({_PATHS})", graph=False)
def ignore_filter(spark, sf_dir):
    return _paths(spark, sf_dir).withColumn("ignored", ignored(F.col("path"), DEFAULT_IGNORES))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'new/' || path ELSE path END AS path FROM ({_PATHS}) WHERE p_partkey % 11 > 0", graph=False)
def status_paths(spark, sf_dir):
    """Porcelain status lines: changed paths, renames and lines too short to be one."""
    line = F.when(F.col("p_partkey") % 11 == 0, "?? ").when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("R  "), "path", F.lit(" -> new/"), "path")).otherwise(F.concat(F.lit(" M "), "path"))
    lines = _paths(spark, sf_dir).withColumn("value", line)
    # The key rides behind the path, which status lines do not have.
    tagged = files.status_paths(lines.select(F.concat("value", F.when(F.length("value") > 3, F.concat(F.lit("#"), F.col("p_partkey").cast("string"))).otherwise("")).alias("value")))
    return tagged.select(F.substring_index("path", "#", -1).cast("long").alias("p_partkey"), F.regexp_replace("path", r"#\d+$", "").alias("path"))


@query("SELECT doc_id, doc_id % 3 = 0 OR text IS NULL AS is_binary FROM documents", graph=False)
def binary_content_check(spark, sf_dir):
    """A NUL at the first byte, at the last one that is looked at, or behind it."""
    d = _read(spark, sf_dir, "documents")
    whole = F.rpad("text", 9000, "x")
    text = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("\0"), "text")).when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x" * 8191 + "\0"), "text")).when(F.col("doc_id") % 3 == 1, F.concat(whole, F.lit("\0")))
    return d.select("doc_id", binary_content(F.encode(F.coalesce(text, "text"), "UTF-8")).alias("is_binary"))


@query(f"SELECT p_partkey, CASE lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.go' THEN 'go' WHEN '.rs' THEN 'rust' END AS language FROM ({_PATHS})", graph=False)
def language_of_path(spark, sf_dir):
    return _paths(spark, sf_dir).select("p_partkey", detect_language(F.col("path")).alias("language"))


@query("SELECT qualified_name, regexp_matches(name, '^test_|^Test|_test$|\\.test\\.|\\.spec\\.|_spec$') AS is_test_name, regexp_matches(file_path, 'test_.*\\.py$|.*_test\\.py$|.*\\.test\\.[jt]sx?$|.*\\.spec\\.[jt]sx?$|.*_test\\.go$|tests?/') AS is_test_file FROM nodes")
def test_names(spark, sf_dir):
    return _graph(spark, sf_dir).nodes.select("qualified_name", is_test_name(F.col("name")).alias("is_test_name"), is_test_file(F.col("file_path")).alias("is_test_file"))


