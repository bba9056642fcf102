"""Keyword search, ranking and top-k by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import Graph
from ..shared import written


def _pattern(word: str, escape: bool) -> str:
    """A LIKE pattern for ``word`` anywhere. Wildcards in the word stay wildcards unless escaped; a backslash is literal."""
    word = word.replace("\\", "\\\\")
    return "%" + (word.replace("%", "\\%").replace("_", "\\_") if escape else word) + "%"


def matches(query: str, fixed: bool = False) -> Column | None:
    """Every word of ``query`` in the name or the qualified name, ignoring case; None for no words."""
    found = None
    for w in query.lower().split():
        p = _pattern(w, fixed)
        one = F.lower("name").like(p) | F.lower("qualified_name").like(p)
        found = one if found is None else found & one
    return found


def search_nodes(g: Graph, query: str, kind: str | None = None, limit: int | None = 20, fixed: bool = False) -> DataFrame:
    where = matches(query, fixed)
    found = g.nodes.where(F.lit(False) if where is None else where)
    if kind:
        found = found.where(F.col("kind") == kind)
    return found if limit is None else found.orderBy("name", "qualified_name").limit(limit)


#: How much of a term may name the places where it can begin (``head``) and be looked up there (``key``): the first choice is taken that gives few
#: kinds of heads and keys, since every task of the nodes holds them.
CUTS = ((12, 1 << 30), (8, 1 << 30), (4, 1 << 30), (8, 16), (4, 12), (4, 8), (3, 6), (2, 4), (1, 2))
FEW_HEADS, FEW_KEYS = 64, 4096


def _cut(part: Column, length: int) -> Column:
    """The first characters of ``part``, without wildcards at the end."""
    return part if length >= 1 << 30 else F.regexp_replace(F.substring(part, 1, length), "_+$", "")


def _shape(s: Column) -> Column:
    """Where ``s`` has wildcards, and its length."""
    return F.regexp_replace(s, "(?s)[^_]", "x")


def _begins(parts: DataFrame) -> tuple[int, list[tuple[str, str]]]:
    """The length of keys for column ``part``, and the distinct pairs of a key's head and its shape."""
    for head, key in CUTS:
        pairs = parts.select(F.substring(_cut(F.col("part"), key), 1, head).alias("h"), _shape(_cut(F.col("part"), key)).alias("k")).distinct()
        last = (head, key) == CUTS[-1]
        found = [tuple(r) for r in (pairs if last else pairs.limit(FEW_KEYS + 1)).collect()]
        if last or (len(found) <= FEW_KEYS and len({k[: len(h)] for h, k in found}) <= FEW_HEADS):
            return key, found


def _runs(shape: str) -> list[tuple[int, int]]:
    """From and to of each run between wildcards, empty ones too."""
    found, at = [], 0
    for run in shape.split("_"):
        found.append((at, at + len(run)))
        at += len(run) + 1
    return found


def _key_reader(begins: list[tuple[str, str]], columns: list[str]):
    """For ``mapInArrow``: (key, *columns) for each row and each distinct key in its texts ``_low`` and ``_full``.

    A key is a stretch of text with its wildcards' places written ``_``. Places where none of the heads begins are passed over by a table
    of two characters and a hash; what is left is compared as text.
    """
    import numpy as np

    heads: dict[str, dict[str, list]] = {}
    for head, shape in begins:
        heads.setdefault("".join("_" if c == "_" else "x" for c in head), {}).setdefault(head, []).append((len(shape), _runs(shape)))
    odd = np.random.default_rng(1).integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
    points = lambda s: np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    plans = []
    for shape, of in heads.items():
        literal = [i for i, c in enumerate(shape) if c != "_"]
        wide = 1 in literal  # two characters are known
        codes = np.stack([points(h) for h in of])
        table = np.zeros(1 << 16, bool)
        table[((codes[:, 0] * 31 + codes[:, 1]) if wide else codes[:, 0]) & 0xFFFF] = True
        hashes = np.unique(sum(codes[:, i].astype(np.uint64) * odd[i % 64] for i in literal))
        for group in of.values():
            group.sort()
        plans.append((len(shape), _runs(shape), literal, wide, table, hashes, of))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            texts, row = [], []
            for i, (low, full) in enumerate(zip(batch["_low"].to_pylist(), batch["_full"].to_pylist(), strict=True)):
                if full is not None:
                    texts.append(full)
                    row.append(i)
                if low is not None and (full is None or low not in full):
                    texts.append(low)
                    row.append(i)
            code = points("".join(texts))
            if not len(code):
                continue
            start = np.cumsum([0, *map(len, texts)])
            one = code & 0xFFFF
            two = (code * 31 + np.append(code[1:], np.uint32(0))) & 0xFFFF
            found = {}
            for length, runs, literal, wide, table, hashes, of in plans:
                at = np.flatnonzero(table[two if wide else one])
                at = at[at + length <= len(code)]
                h = np.zeros(len(at), np.uint64)
                for i in literal:
                    h += code[at + i].astype(np.uint64) * odd[i % 64]
                at = at[hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h]
                which = np.searchsorted(start, at, "right") - 1
                for t, a in zip(which.tolist(), (at - start[which]).tolist(), strict=True):
                    text, r = texts[t], row[t]
                    for size, parts in of.get("_".join([text[a + x : a + y] for x, y in runs]), ()):
                        if a + size > len(text):
                            break
                        found["_".join([text[a + x : a + y] for x, y in parts]), r] = None
            if found:
                keys, rows = zip(*found, strict=True)
                taken = batch.select(columns).take(pa.array(rows, pa.int32())).columns if columns else []
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *taken], names=["_key", *columns])

    return read


def _holding(nodes: DataFrame, begins: list[tuple[str, str]], columns: list[str]) -> DataFrame:
    """(_key, *columns) for each node and each key that its name or qualified name may hold."""
    schema = T.StructType([T.StructField("_key", T.StringType()), *[nodes.schema[c] for c in columns]])
    texts = nodes.select(*columns, F.lower("name").alias("_low"), F.lower("qualified_name").alias("_full"))
    return texts.mapInArrow(_key_reader(begins, columns), schema) if begins else nodes.sparkSession.createDataFrame([], schema)


def search_all(g: Graph, terms: DataFrame, columns: list[str] | None = None, first: int | None = None) -> DataFrame:
    """``search_nodes`` without a limit for a whole column ``term`` at once: (term, *columns of the nodes), each term once.

    Nodes are read for the places where a term can begin and give the stretches of text that can be a term; these meet the terms by
    equality, so a node moves once for each of its hits. A term of several words or of parts between ``%`` meets nodes by the part
    that the fewest hold and is then compared word by word as ``matches`` does. Terms of wildcards alone are compared with every
    node. ``first``: only so many hits of each term, by name and qualified name.
    """
    columns = g.nodes.columns if columns is None else columns
    ordered = list(dict.fromkeys([*columns, "name", "qualified_name"])) if first else columns
    checked = list(dict.fromkeys([*ordered, "name", "qualified_name"]))

    def cut(df: DataFrame, by: str) -> DataFrame:
        if not first:
            return df
        rank = F.row_number().over(W.partitionBy(by).orderBy("name", "qualified_name"))
        return df.withColumn("_r", rank).where(F.col("_r") <= first).drop("_r")

    words = F.filter(F.split(F.lower("term"), r"(?U)\s+"), lambda w: w != "")
    parts = F.filter(F.transform(F.flatten(F.transform("_words", lambda w: F.split(w, "%"))), lambda p: F.trim(p, F.lit("_"))), lambda p: p != "")
    told = written(terms.select("term").distinct().withColumn("_words", words).where(F.size("_words") > 0).withColumn("_parts", F.array_distinct(parts)), "terms")
    one = (F.size("_words") == 1) & (F.size("_parts") == 1) & (F.element_at("_words", 1) == F.element_at("_parts", 1))
    plain = told.where(one).select("term", "_words", F.element_at("_parts", 1).alias("part"))
    several = told.where(~one & (F.size("_parts") > 0))
    split = several.select("term", "_words", F.explode("_parts").alias("part"))

    low, full = F.lower("name"), F.lower("qualified_name")
    pattern = lambda w: F.concat(F.lit("%"), F.replace(w, F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    inside = lambda s, w: F.when(w.rlike("[%_]"), F.like(s, pattern(w))).otherwise(F.contains(s, w))
    exact = F.forall("_words", lambda w: F.coalesce(inside(low, w), F.lit(False)) | F.coalesce(inside(full, w), F.lit(False)))

    length, begins = _begins(plain)
    if whole := length >= 1 << 30:
        near = cut(_holding(g.nodes, begins, ordered), "_key").join(plain.select("term", "part"), F.col("_key") == F.col("part"))
    else:
        near = _holding(g.nodes, begins, checked).join(plain.withColumn("part", _cut(F.col("part"), length)), F.col("_key") == F.col("part")).where(exact)
    found = near.select("term", *columns) if whole or not first else cut(near, "term").select("term", *columns)

    length, begins = _begins(split)
    if begins:
        keyed = split.withColumn("part", _cut(F.col("part"), length)).distinct()
        count = _holding(g.nodes, begins, []).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
        least = keyed.join(count, F.col("part") == F.col("_key"), "left").groupBy("term").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "part", "_words")).alias("_k"))
        least = least.where("_k.n > 0").select("term", "_k.part", "_k._words")
        more = _holding(g.nodes, begins, checked).join(least, F.col("_key") == F.col("part")).where(exact)
        found = found.unionByName(cut(more, "term").select("term", *columns))
    rest = told.where(F.size("_parts") == 0).select("term", "_words").crossJoin(g.nodes.select(*checked)).where(exact)
    return found.unionByName(cut(rest, "term").select("term", *columns))


def rank_score(query: str) -> Column:
    """0 for the exact name, 1 for a prefix, 2 otherwise; the whole query counts, ignoring case."""
    q = query.lower()
    return F.when(F.lower("name") == q, 0).when(F.lower("name").startswith(q), 1).otherwise(2)


def search_ranked(g: Graph, query: str, kind: str | None = None, limit: int = 20, fixed: bool = False) -> DataFrame:
    """Keyword search for twice the limit, then the kind, then the order exact, prefix, other. ``fixed`` filters the kind first."""
    found = search_nodes(g, query, kind if fixed else None, 2 * limit, fixed)
    if kind and not fixed:
        found = found.where(F.col("kind") == kind)
    return found.withColumn("score", rank_score(query)).orderBy("score", "name", "qualified_name").limit(limit)


def nodes_by_size(g: Graph, min_lines: int = 50, max_lines: int | None = None, kind: str | None = None, path: str | None = None, limit: int | None = 50) -> DataFrame:
    """Nodes of at least ``min_lines`` lines, largest first, with ``line_count``. ``path`` is a part of the file's path, any case."""
    size = F.col("line_end") - F.col("line_start") + 1
    found = g.nodes.withColumn("line_count", size).where(F.col("line_count") >= min_lines)
    if max_lines is not None:
        found = found.where(F.col("line_count") <= max_lines)
    if kind:
        found = found.where(F.col("kind") == kind)
    if path:
        found = found.where(F.col("file_path").ilike(_pattern(path, False)))
    found = found.orderBy(F.desc("line_count"), "qualified_name")
    return found if limit is None else found.limit(limit)


def large_functions(g: Graph, root: str, min_lines: int = 50, kind: str | None = None, path: str | None = None, limit: int | None = 50) -> DataFrame:
    """``nodes_by_size`` with the path relative to ``root``; a path outside stays as it is."""
    base = root.rstrip("/") + "/"
    relative = F.when(F.col("file_path").startswith(base), F.substring(F.col("file_path"), len(base) + 1, 1 << 20)).otherwise(F.col("file_path"))
    return nodes_by_size(g, min_lines, None, kind, path, limit).withColumn("relative_path", relative)


#: Lines of a block by which positions and nodes meet.
LINE_BLOCK = 64


def innermost_at(g: Graph, positions: DataFrame) -> DataFrame:
    """For each (file_path, line) the smallest node around it: (file_path, line, *node).

    Positions meet nodes by file and block of lines. A node stands in the blocks in which it begins or ends; of those that reach over a
    whole block only the smallest can be innermost, so one goes for all of them. No file meets in one task.
    """
    size, block = F.col("line_end") - F.col("line_start"), lambda c: F.floor(F.col(c) / LINE_BLOCK)
    fields = ["kind", "name", "qualified_name", "line_start", "line_end"]
    n = g.nodes.where(F.col("line_start").isNotNull() & F.col("line_end").isNotNull() & (F.col("line_start") <= F.col("line_end")))
    n = n.select(F.col("file_path").alias("_f"), F.struct(size.alias("size"), F.col("qualified_name").alias("by"), F.struct(*fields).alias("n")).alias("node"), block("line_start").alias("_a"), block("line_end").alias("_b"))
    edge = n.select("_f", "node", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("_block"))
    over = n.where(F.col("_b") - F.col("_a") > 1).select("_f", "node", F.explode(F.sequence(F.col("_a") + 1, F.col("_b") - 1)).alias("_block"))
    over = over.groupBy("_f", "_block").agg(F.min("node").alias("node"))
    at = positions.select(F.col("file_path").alias("_p"), F.col("line").alias("at_line"), block("line").alias("_at")).distinct()
    found = at.join(edge.unionByName(over.select("_f", "node", "_block")), (F.col("_p") == F.col("_f")) & (F.col("_at") == F.col("_block")))
    found = found.where((F.col("node.n.line_start") <= F.col("at_line")) & (F.col("node.n.line_end") >= F.col("at_line")))
    best = found.groupBy("_p", "at_line").agg(F.min("node").alias("node"))
    return best.select(F.col("_p").alias("file_path"), F.col("at_line").alias("line"), "node.n.*")
