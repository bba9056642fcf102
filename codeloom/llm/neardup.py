"""Near-duplicate classes by consistent weighted sampling (operator 8).

Five-word shingles are weighted by TF-IDF: (1 + ln tf) times the mean inverse document frequency of the shingle's words,
scaled to between 1 and 2 so that no rare word outweighs a text.
Document frequencies are counted over all documents, by word-hash bucket (a table of fixed size). Improved consistent
weighted sampling draws ``bands * rows`` samples from every text; two texts' samples agree with the probability of their
weighted Jaccard similarity. Samples are banded, texts that share a band meet in a bucket, and what meets is verified by
exact weighted Jaccard similarity on all shingles.

No bucket is expanded into all its pairs. What a text shares with another is at most what it does not have alone among
the candidates, also cell by cell when shingles are dealt into cells by hash. That bounds every pair's similarity from
above by a few numbers of each text; pairs that cannot reach the threshold are left out. Links are found in rounds: each bucket that holds more than one class so far compares its members with one
leader, first with the one that has least alone, and connected components merge. What the rounds leave apart is settled
exactly: members outside their bucket's largest class are compared with every member of another class that the bound
does not rule out. So no pair of different classes that could be a link stays unverified.

Equal texts are one text from the start (MD5 of the bytes). Words are runs of letters, digits and underscores,
lower-cased. A text of one to four words is one shingle. Null counts as empty; texts without words form classes by
equality only. Repeated rows are in one class; extra columns are ignored; ``class_id`` is the class's least ``doc_id``, null
for a class of rows without ids, which ``class_md5`` tells apart.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, map_rows, materialize

_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class NearRules:
    words: int = 5
    threshold: float = 0.8
    bands: int = 12
    rows: int = 3
    buckets: int = 1 << 16  #: of word hashes, for document frequencies
    rounds: int = 1
    cells: int = 64  #: of shingle hashes, for the bound on what two texts share
    broadcast_rows: int = 200_000  #: a side of so many counted rows of fixed width, at most, may be broadcast


# ---------------------------------------------------------------- texts as weighted shingles


def word_hash(w: str) -> int:
    return int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


_PAIR = np.dtype([("h", "<u8"), ("b", "<u4")])


def hashed_words(rules: NearRules) -> WordMemo:
    def make(words):
        for w in words:
            h = word_hash(w)
            yield h.to_bytes(8, "little") + ((h >> 40) % rules.buckets).to_bytes(4, "little")

    return WordMemo(lambda words: list(make(words)), 300_000)


def words_of(text: str | None, memo: WordMemo) -> np.ndarray:
    words = _WORD.findall((text or "").lower())
    memo.ensure(words)
    return np.frombuffer(b"".join(map(memo.at, words)), dtype=_PAIR)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def vector(text: str | None, memo: WordMemo, idf: np.ndarray, rules: NearRules) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and their weights."""
    words = words_of(text, memo)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.float32)
    k = min(n, rules.words)
    h, w = words["h"], idf[words["b"]]
    key, weight = np.zeros(n - k + 1, np.uint64), np.zeros(n - k + 1, np.float32)
    for j in range(k):
        key = mixed(key * _MIX + h[j : n - k + 1 + j])
        weight += w[j : n - k + 1 + j]
    if k < rules.words:
        key = mixed(key + np.uint64(k))
    key, first, tf = np.unique(key, return_index=True, return_counts=True)
    return key, (weight[first] / np.float32(k) * (1 + np.log(tf))).astype(np.float32)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    (x, u), (y, v) = a, b
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = y[at] == x
    common = float(np.minimum(u[same], v[at[same]]).sum(dtype=np.float64))
    return common / (float(u.sum(dtype=np.float64)) + float(v.sum(dtype=np.float64)) - common)


# ---------------------------------------------------------------- consistent weighted sampling


class Sampler:
    """Improved consistent weighted sampling: of shingles with weights S, sample k is the one of least
    ln a = ln c - r * (t - b) - r with t = floor(ln S / r + b), where r and c are Gamma(2, 1) and b uniform, all three
    read off the shingle's k-th hash. The sample is the pair (shingle, t)."""

    def __init__(self, rules: NearRules):
        self.rules = rules
        k = rules.bands * rules.rows
        draw = np.random.default_rng(20_240_229)
        self.odd = (draw.integers(0, 1 << 63, size=(k, 1), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        # Quantiles of Gamma(2, 1) at cell midpoints: solve 1 - (1 + x) e^-x = u by bisection.
        self.r = self.quantiles(1 << 12).astype(np.float32)
        self.log_c = np.log(self.quantiles(1 << 16)).astype(np.float32)
        self.band = (draw.integers(0, 1 << 63, size=k, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

    @staticmethod
    def quantiles(cells: int) -> np.ndarray:
        u = (np.arange(cells) + 0.5) / cells
        lo, hi = np.zeros(cells), np.full(cells, 60.0)
        for _ in range(70):
            mid = (lo + hi) / 2
            low = 1 - (1 + mid) * np.exp(-mid) < u
            lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
        return (lo + hi) / 2

    def bands(self, key: np.ndarray, weight: np.ndarray) -> list[int]:
        """One 64-bit value a band; none for a text without shingles."""
        n, k = len(key), len(self.odd)
        if not n:
            return []
        log_s = np.log(weight)
        best, sample = np.full(k, np.inf, np.float32), np.zeros(k, np.uint64)
        rows = np.arange(k)
        for at in range(0, n, 4096):
            h = key[None, at : at + 4096] * self.odd
            h ^= h >> np.uint64(32)
            r = self.r[(h & np.uint64(0xFFF)).astype(np.intp)]
            c = self.log_c[((h >> np.uint64(12)) & np.uint64(0xFFFF)).astype(np.intp)]
            b = (h >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
            t = np.floor(log_s[None, at : at + 4096] / r + b)
            a = c - r * (t - b + 1)
            i = a.argmin(axis=1)
            low = a[rows, i]
            drawn = mixed(h[rows, i] + t[rows, i].astype(np.int64).view(np.uint64) * _MIX)
            sample = np.where(low < best, drawn, sample)
            best = np.minimum(low, best)
        drawn = mixed(sample * self.band).reshape(self.rules.bands, self.rules.rows)
        out = np.arange(1, self.rules.bands + 1).astype(np.uint64)
        for j in range(self.rules.rows):
            out = mixed(out * _MIX + drawn[:, j])
        return out.view(np.int64).tolist()


# ---------------------------------------------------------------- passes over documents


def inverse_frequencies(docs: DataFrame, rules: NearRules, text_col: str) -> np.ndarray:
    """Inverse document frequency of every word bucket, from 1 (in all documents) to 2 (in none), counted over all documents.

    1 + ln((1 + documents) / (1 + documents with a word of the bucket)) / ln(2 + documents)
    """

    def run(batches: Iterator[pa.RecordBatch]):
        memo, seen, n = hashed_words(rules), np.zeros(rules.buckets, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[np.unique(words_of(text, memo)["b"])] += 1
                n += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], n))], names=["bucket", "n"])

    rows = docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = dict(zip(rows["bucket"].to_pylist(), rows["n"].to_pylist(), strict=True))
    n = counts.pop(-1, 0)
    df = np.zeros(rules.buckets)
    df[list(counts)] = list(counts.values())
    return (1 + np.log((1 + n) / (1 + df)) / math.log(2 + n)).astype(np.float32)


def signatures(docs: DataFrame, idf: np.ndarray, rules: NearRules, id_col: str, text_col: str) -> DataFrame:
    def make():
        memo, sampler, known = hashed_words(rules), Sampler(rules), {}

        def sign(doc_id, text):
            tkey = hashlib.md5((text or "").encode(), usedforsecurity=False).digest()
            if tkey not in known:
                if len(known) >= 10_000:
                    known.clear()
                known[tkey] = sampler.bands(*vector(text, memo, idf, rules))
            return doc_id, tkey, known[tkey]

        return lambda ids, texts: map(sign, ids, texts)

    return map_rows(docs.select(id_col, text_col), "doc_id long, tkey binary, bands array<long>", make)


def links(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, rules: NearRules) -> DataFrame:
    """Those of ``pairs`` (a, b) that reach the threshold, with their similarity."""
    a = texts.select(F.col("tkey").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("tkey").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "text_a", "text_b")

    def make():
        memo, kept = hashed_words(rules), {}

        def of(key, text):
            if key not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[key] = vector(text, memo, idf, rules)
            return kept[key]

        def run(xs, ys, text_x, text_y):
            for x, y, s, t in zip(xs, ys, text_x, text_y, strict=True):
                like = weighted_jaccard(vector(s, memo, idf, rules), of(y, t))
                if like >= rules.threshold:
                    yield x, y, like

        return run

    return map_rows(joined, "a binary, b binary, similarity double", make, 512)


# ---------------------------------------------------------------- classes


def components(edges: DataFrame) -> DataFrame:
    """(tkey, comp) for every end of ``edges``: the least key reachable. Labels spread to neighbours and then jump."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "near-edges")
    labels = materialize(both.groupBy(F.col("a").alias("tkey")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "near-labels")
    while True:
        around = both.join(labels, both.b == labels.tkey).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(around, labels.tkey == around.a).select("tkey", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("tkey").alias("_k"), F.col("comp").alias("_c"))
        step = step.join(jump, step.next == jump._k, "left").select("tkey", (F.least("next", F.coalesce("_c", "next"))).alias("comp"), F.col("comp").alias("old"))
        step = materialize(step, "near-labels")
        labels = step.select("tkey", "comp")
        if step.where(F.col("comp") != F.col("old")).isEmpty():
            return labels


def weights(texts: DataFrame, idf: np.ndarray, rules: NearRules) -> DataFrame:
    """(tkey, w, u, s) of every text with shingles: its weight; that part of it which lies on shingles that no other of
    ``texts`` has; and the other part, dealt by shingle hash into ``rules.cells`` sums."""

    def run(batches):
        memo = hashed_words(rules)
        cells = np.arange(rules.cells)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, w = vector(text, memo, idf, rules)
                if not len(h):
                    continue
                w = w.astype(np.float64)
                cell = (h % np.uint64(rules.cells)).astype(np.int64)
                # Minus the cells' sums on keys of the text's own: what stays when its lone shingles are added is minus the rest.
                own = np.uint64(int.from_bytes(key[:8], "little")) ^ np.uint64(0x5555555555555555)
                h = np.concatenate([h, mixed(own + cells.astype(np.uint64) * _MIX)])
                total, w = float(w.sum()), np.concatenate([w, -np.bincount(cell, w, rules.cells)])
                halves = np.frombuffer(key, ">i8").astype(np.int64)
                cols = [h.view(np.int64), np.concatenate([cell, cells]), *(np.full(len(h), x) for x in halves), w, np.full(len(h), total)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["h", "cell", "k1", "k2", "weight", "total"])

    # Keys travel as two numbers, for which Spark aggregates by hash.
    one = texts.select("tkey", "text").mapInArrow(run, "h long, cell long, k1 long, k2 long, weight double, total double")
    one = one.groupBy("h").agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in ("cell", "k1", "k2", "weight", "total")]).where(F.col("n") == 1)
    sums = one.groupBy("k1", "k2", "cell").agg((-F.sum("weight")).alias("shared"), F.max("total").alias("w"))
    sums = sums.groupBy("k1", "k2").agg(F.max("w").alias("w"), F.sum("shared").alias("_s"), F.array_sort(F.collect_list(F.struct("cell", "shared"))).alias("_l"))
    whole = F.unhex(F.concat(*[F.lpad(F.hex(k), 16, "0") for k in ("k1", "k2")]))
    return sums.select(whole.alias("tkey"), "w", (F.col("w") - F.col("_s")).alias("u"), F.col("_l.shared").alias("s"))


def reachable(wa, wb, common, threshold: float):
    """Whether texts of such weights that share at most ``common`` can reach the threshold."""
    return common >= (threshold - 1e-5) * (wa + wb - common)


def near_classes(docs: DataFrame, rules: NearRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size (documents), class_texts (different texts), is_first (of the
    class's least id), text_md5, class_md5 (least in the class), and the most similar text that the row's text was found linked
    to, as link_md5 with its similarity; null where no other text is linked."""
    rules = rules or NearRules()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    idf = inverse_frequencies(docs, rules, "text")
    signed = materialize(signatures(docs, idf, rules, "doc_id", "text"), "near-signed")

    # Texts that meet in a bucket.
    met = signed.select("tkey", F.explode("bands").alias("v")).distinct()
    sizes = met.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("v")
    members = materialize(met.join(sizes, "v"), "near-members")
    keys = members.select("tkey").distinct()
    reps = materialize(signed.join(keys, "tkey", "left_semi").groupBy("tkey").agg(F.min("doc_id").alias("rep")), "near-reps")
    n_reps = reps.count()
    links_found = None
    if n_reps:
        # A text is read from the row of its least id, or from rows without one if it has no other.
        picked = reps.select("tkey", "rep")
        picked = F.broadcast(picked) if n_reps <= rules.broadcast_rows else picked
        texts = docs.join(picked, docs.doc_id.eqNullSafe(F.col("rep")) & (F.unhex(F.md5(F.coalesce("text", F.lit("")))) == F.col("tkey")))
        texts = materialize(texts.select("tkey", "text").dropDuplicates(["tkey"]), "near-texts")
        links_found, labels = _link(members, texts, idf, rules)
    if links_found is None:
        labels = reps.select("tkey", F.col("tkey").alias("comp")).limit(0)
        best = reps.select("tkey", F.lit(None).cast("binary").alias("link"), F.lit(None).cast("double").alias("similarity")).limit(0)
    else:
        ends = links_found.select(F.col("a").alias("tkey"), F.col("b").alias("link"), "similarity").union(links_found.select("b", "a", "similarity"))
        best = ends.groupBy("tkey").agg(F.max(F.struct("similarity", "link")).alias("m")).select("tkey", "m.link", "m.similarity")

    # Classes of documents. Most texts are alone; the label of the others comes by key.
    own = signed.groupBy("tkey").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    own = own.join(labels, "tkey", "left").withColumn("comp", F.coalesce("comp", "tkey")).join(best, "tkey", "left")
    classes = own.groupBy("comp").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("class_texts"))
    own = own.select("tkey", "comp", "link", "similarity").join(classes, "comp")
    own = materialize(own, "near-classes")
    result = signed.select("doc_id", "tkey").join(own, "tkey")
    first = F.col("doc_id").eqNullSafe(F.col("class_id"))
    md5 = lambda c, name: F.lower(F.hex(c)).alias(name)
    return result.select("doc_id", "class_id", "class_size", "class_texts", first.alias("is_first"), md5("tkey", "text_md5"), md5("comp", "class_md5"), md5("link", "link_md5"), "similarity")


def _link(members: DataFrame, texts: DataFrame, idf: np.ndarray, rules: NearRules) -> tuple[DataFrame | None, DataFrame | None]:
    """All links that matter for the classes, and the classes' labels."""
    t, found, labels, tested = rules.threshold, None, None, None
    info = materialize(weights(texts, idf, rules).where(F.col("u") <= (1 - t + 1e-5) * F.col("w")), "near-weights")
    rows = materialize(members.select("v", "tkey").join(info.drop("s"), "tkey"), "near-members")
    alone = lambda w, u: F.col(w) - F.col(u)

    def open_rows() -> DataFrame:
        """Members of the buckets that hold more than one class so far, with their classes."""
        if labels is None:
            now = rows.withColumn("comp", F.col("tkey"))
        else:
            now = rows.join(labels, "tkey", "left").withColumn("comp", F.coalesce("comp", "tkey"))
        now = materialize(now.select("v", "tkey", "w", "u", "comp"), "near-open")
        several = now.groupBy("v").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where(F.col("_lo") != F.col("_hi")).select("v")
        return now.join(several, "v", "left_semi")

    def verify(pairs: DataFrame) -> None:
        """Compares the pairs (tkey, other) that were not compared before, in either order."""
        nonlocal found, labels, tested
        pairs = pairs.select(F.least("tkey", "other").alias("a"), F.greatest("tkey", "other").alias("b")).distinct()
        pairs = materialize(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "near-pairs")
        tested = pairs if tested is None else tested.union(pairs)
        new = materialize(links(pairs, texts, idf, rules), "near-links")
        if not new.isEmpty():
            found = new if found is None else found.union(new)
            labels = components(found)

    for r in range(rules.rounds):
        now = open_rows()
        # First the member with the least of its own, which is nearest to all others; later ones in hash order.
        order = F.col("u") / F.col("w") if r == 0 else (F.xxhash64("tkey", F.lit(r)) / F.lit(2.0**63))
        lead = now.groupBy("v").agg(F.min(F.struct(order.alias("o"), "tkey", "comp", "w", "u")).alias("l"))
        lead = lead.select("v", F.col("l.tkey").alias("other"), F.col("l.comp").alias("comp_l"), F.col("l.w").alias("w_l"), F.col("l.u").alias("u_l"))
        pairs = now.join(lead, "v").where((F.col("comp") != F.col("comp_l")) & reachable(F.col("w"), F.col("w_l"), F.least(alone("w", "u"), alone("w_l", "u_l")), t))
        verify(pairs.select("tkey", "other"))

    # What is still apart, exactly: every member outside its bucket's largest class against every member of another class.
    now = open_rows().join(info.select("tkey", "s"), "tkey")
    sizes = now.groupBy("v", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("v").agg(F.max(F.struct("n", "comp")).alias("m")).select("v", F.col("m.comp").alias("main"))
    rest = now.join(main, "v").where(F.col("comp") != F.col("main")).drop("main")
    other = now.select(F.col("v").alias("v_o"), F.col("tkey").alias("other"), F.col("comp").alias("comp_o"), F.col("w").alias("w_o"), F.col("u").alias("u_o"), F.col("s").alias("s_o"))
    in_cells = F.aggregate(F.zip_with("s", "s_o", lambda x, y: F.least(x, y)), F.lit(0.0), lambda a, x: a + x)
    can = reachable(F.col("w"), F.col("w_o"), F.least(alone("w", "u"), alone("w_o", "u_o")), t) & reachable(F.col("w"), F.col("w_o"), in_cells, t)
    verify(rest.join(other, (F.col("v") == F.col("v_o")) & (F.col("comp") != F.col("comp_o")) & can).select("tkey", "other"))
    return found, labels


def drop_near_copies(docs: DataFrame, rules: NearRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class: the one of least id, or, in a class without ids, the one of least text hash. Of
    several texts of one id in a class the one of least hash stays; a repeated row of that id and text stays once. Null texts are
    copies of empty ones."""
    first = near_classes(docs, rules, id_col, text_col).where("is_first")
    first = materialize(first.groupBy(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5"), "class_md5").agg(F.count(F.lit(1)).alias("_n")), "near-first")
    md5 = F.md5(F.coalesce(docs[text_col], F.lit("")))
    pick = lambda ids: docs.join(ids, docs[id_col].eqNullSafe(ids["_id"]) & (md5 == ids["_md5"]), "left_semi")
    one = first.groupBy("class_md5", "_id").agg(F.min("_md5").alias("_md5"), F.min_by("_n", "_md5").alias("_n"))
    kept, again = pick(one.where(F.col("_n") == 1)), one.where(F.col("_n") > 1)
    if again.isEmpty():
        return kept
    # Repeated rows: null and empty texts are one text here.
    row = pick(again).withColumn("_text", F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return kept.union(row.dropDuplicates([id_col, "_text"]).drop("_text"))
