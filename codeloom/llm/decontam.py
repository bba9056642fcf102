"""Benchmark decontamination by size-partitioned MinHash containment search (operator 7, DataFrame operations only).

A test item counts as leaked into a document when at least ``threshold`` of the item's distinct word shingles occur in
it, however long the document is. Items are partitioned by the size of their shingle set (powers of two). Each item is
stood for by the k smallest values of a MinHash permutation of its shingles, where k follows from the largest size u in
its partition: k = floor((1 - threshold) * u) + 1. An item of at most u shingles that reaches the threshold misses fewer
than k shingles, so a document that holds it holds one of its k minima at least: the search loses nothing. Documents are
probed with all their shingles, in one pass, and the few candidates are verified by exact containment on the shingles'
words.

Words are runs of letters and digits, lower-cased. An item of fewer words than a shingle is one shingle of all its
words; an item without words is never found. Null or empty texts hold nothing. An item is its id and its shingles: rows of
one id and different texts are searched each by itself and give one result, the one of highest containment; repeated rows
and repeated document rows give one result too. Items without an id are searched like others and reported with a null
item_id. Documents that share an id share its verdict; documents without one are told apart by their text.
Extra columns are ignored. Either table may be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

WORDS = 5
THRESHOLD = 0.8
#: A side of a join is broadcast only when it has been counted and has at most so many rows (16 bytes each).
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: inside a lambda an expression would be evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(w: Column, k: int) -> Column:
    each = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), each)).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(w: Column, k: int) -> Column:
    each = lambda i: F.array_join(F.slice(w, i + 1, k), " ")
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), each)).otherwise(F.array().cast("array<string>"))


def shingle_set(text: Column, lengths: list[int], of) -> Column:
    """Distinct shingles of ``text`` for all of ``lengths``, by ``shingle_hashes`` or ``shingle_texts``."""
    return bound(words(text), lambda w: F.array_distinct(F.concat(*[of(w, k) for k in lengths]) if len(lengths) > 1 else of(w, lengths[0])))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n_words: int = WORDS, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every leaked item. Of several rows of one document id and one item id, the
    pair of highest containment counts, of equal ones that with the larger item."""
    best = F.max(F.struct("containment", "n_item", "n_shared")).alias("b")
    found = _leaks(docs, items, threshold, n_words, doc_col, item_col, text_col).groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", "b.n_item", "b.n_shared", "b.containment")


def _text_key(doc_id: Column, text: Column) -> Column:
    """What tells documents without an id apart; null for those with one."""
    return F.when(doc_id.isNull(), F.xxhash64(text))


def _same_doc(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & a["_text_key"].eqNullSafe(b["_text_key"])


def _leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n_words: int = WORDS, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _text_key, item_id, n_item, n_shared, containment) of every item row that leaked."""
    docs = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"), _text_key(F.col(doc_col), F.col(text_col)).alias("_text_key"))
    tests = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"), F.least(F.size(words(F.col(text_col))), F.lit(n_words)).alias("k")).where(F.col("k") > 0)
    own_length = F.coalesce(*[F.when(F.col("k") == k, shingle_set(F.col("text"), [k], shingle_texts)) for k in range(1, n_words + 1)])
    tests = tests.select("item_id", own_length.alias("shingles"), "k")
    tests = tests.withColumn("item", F.xxhash64("item_id", F.array_sort("shingles"))).dropDuplicates(["item"])
    tests = materialize(tests.select("item", "item_id", "k", "shingles", F.size("shingles").alias("n"), F.floor(F.log2(F.size("shingles"))).cast("int").alias("part")), "leak-items")
    head = tests.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"), F.array_sort(F.collect_set("k")).alias("lengths")).first()
    schema = "doc_id long, _text_key long, item_id long, n_item long, n_shared long, containment double"
    if not head["rows"]:
        return docs.sparkSession.createDataFrame([], schema)
    lengths = list(head["lengths"])

    # Size partitions: the sketch of every item is as long as the partition's largest item needs.
    largest = tests.groupBy("part").agg(F.max("n").alias("u"))
    sketch = tests.join(F.broadcast(largest), "part")  # one row a power of two
    hashed = sketch.select("item", "k", "u", F.explode("shingles").alias("s"))
    parts = F.split("s", " ")
    by_k = F.coalesce(*[F.when(F.col("k") == k, F.xxhash64(*[F.get(parts, j) for j in range(k)])) for k in lengths])
    hashed = hashed.select("item", "u", by_k.alias("h")).distinct()
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.xxhash64("h", F.lit(7)), "h"))
    keep = F.floor(F.col("u") * (1 - threshold) + 1e-9) + 1
    sketch = materialize(hashed.withColumn("_r", rank).where(F.col("_r") <= keep).select("h", "item"), "leak-sketch")

    probes = docs.select("doc_id", "_text_key", F.explode(shingle_set(F.col("text"), lengths, shingle_hashes)).alias("h"))
    found = probes.join(_small(sketch, sketch.count()), "h").select("doc_id", "_text_key", "item").distinct()
    found = materialize(found, "leak-candidates")

    n = found.count()
    pairs = docs.join(_small(found, n), _same_doc(docs, found)).drop(found["doc_id"], found["_text_key"])
    pairs = pairs.join(_small(tests.select("item", "item_id", "shingles"), head["shingles"]), "item")
    shared = F.size(F.array_intersect(shingle_set(F.col("text"), lengths, shingle_texts), F.col("shingles")))
    pairs = pairs.select("doc_id", "_text_key", "item_id", F.size("shingles").cast("long").alias("n_item"), shared.cast("long").alias("n_shared"))
    return pairs.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("n_shared") >= threshold * F.col("n_item") - 1e-9)


def drop_leaked(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", **rules) -> DataFrame:
    """``docs`` without those that hold a test item."""
    leaked = _leaks(docs, items, doc_col=doc_col, **rules).select(F.col("doc_id").alias("_leaked"), F.col("_text_key").alias("_leaked_text")).distinct()
    text_key = _text_key(docs[doc_col], docs[rules.get("text_col", "text")])
    return docs.join(leaked, docs[doc_col].eqNullSafe(leaked["_leaked"]) & text_key.eqNullSafe(leaked["_leaked_text"]), "left_anti")


#: Rows of documents and items are judged each by itself, as above.
ORACLE = r"""
WITH i AS (SELECT row_number() OVER () AS r, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ik AS (SELECT r, item_id, w, least(len(w), 5) AS k FROM i WHERE len(w) > 0),
ish AS (SELECT DISTINCT r, item_id, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT r, item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM ik)),
n AS (SELECT r, count(*) AS n_item FROM ish GROUP BY r),
d AS (SELECT row_number() OVER () AS q, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT DISTINCT k FROM ik),
dsh AS (SELECT DISTINCT q, doc_id, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT q, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, k WHERE len(w) >= k)),
found AS (SELECT q, r, doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item::DOUBLE AS containment
  FROM dsh JOIN ish USING (s) JOIN n USING (r) GROUP BY q, r, doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item - 1e-9)
SELECT doc_id, item_id, n_item, n_shared, containment FROM found
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY containment DESC, n_item DESC) = 1
"""
