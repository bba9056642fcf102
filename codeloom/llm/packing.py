"""Sequence packing by cutting-stock column generation (operator 2).

Each document's token ids and a closing id are cut at multiples of the sequence length. Whole pieces fill a sequence by
themselves. The rest pieces are counted by length (a histogram of fixed size), and a linear program over packing
patterns is solved by column generation: the dual prices go to an unbounded knapsack dynamic program that proposes the
patterns worth most, until the total is at the bound that the tokens or the prices prove. The solution is rounded down, what
is left over is packed first-fit-decreasing, and the patterns are assigned to pieces by their rank within the length. The
little that then is free in some sequences is filled exactly by slices of a few whole pieces ("fill pieces"); what the last
of them has over makes sequences of power-of-two lengths. So no sequence has padding, unless the input has too few long
documents to fill all room.

Only the histogram and the patterns reach the driver; both have a size that the parameters fix. Ranks and running sums
are taken in two steps (salted groups, then a small table of group totals), so one frequent length does not meet in one
task. Null text counts as empty: its only id is the closing one. Repeated rows are packed row by row; extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WordMemo, map_rows, materialize, tokenizer_path

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class PackRules:
    length: int = 2048
    unit: int = 1  #: width of a length class in tokens; must divide ``length``
    end_id: int = 1
    vocabulary: str = "word_bpe_49k.json"
    folder: str | None = None
    fill_every: int = 4  #: one whole piece in so many keeps its ids and may be used as filling


# ---------------------------------------------------------------- tokens


#: Words whose lower case and normal form are beyond doubt, with the punctuation behind them.
_PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([.,;:!?]*)")


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def word_ids(rules: PackRules):
    """Memo of a white-space-free word's ids as little-endian unsigned 32-bit bytes.

    The vocabulary's normaliser and pre-tokeniser never join text across white space, so a text's ids are its words' ids.
    They lower-case, and part letters from punctuation, so a plain word goes to the tokeniser's model by itself, once for
    all its capitals and punctuation; any other word takes the whole tokeniser.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(rules.vocabulary, rules.folder))
    model, letters = t.model.tokenize, byte_letters()
    whole = lambda words: [array("I", e.ids).tobytes() for e in t.encode_batch_fast(words, add_special_tokens=False)]
    cores = WordMemo(lambda words: [array("I", [x.id for x in model(w if w.isascii() else w.encode().decode("latin-1").translate(letters))]).tobytes() for w in words])
    tails = WordMemo(whole, 10_000)

    def make(words):
        parts = list(map(_PLAIN.fullmatch, words))
        cores.ensure([m[1].lower() for m in parts if m])
        tails.ensure([m[2] for m in parts if m])
        other = iter(whole([w for w, m in zip(words, parts, strict=True) if not m]))
        return [cores.at(m[1].lower()) + tails.at(m[2]) if m else next(other) for m in parts]

    return WordMemo(make)


def ids_of(text: str | None, memo: WordMemo, end: bytes) -> bytes:
    words = (text or "").replace("\n", " ").split(" ")
    memo.ensure(words)
    return b"".join(map(memo.at, words)) + end


def chunks(docs: DataFrame, rules: PackRules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces cut at multiples of the sequence length. ``cls``: length class; 0 a whole piece; -1 one that keeps its ids."""
    size = 4 * rules.length

    def make():
        memo = word_ids(rules)
        end = array("I", [rules.end_id]).tobytes()

        def cut(doc_id, text):
            ids = ids_of(text, memo, end)
            for at in range(0, len(ids), size):
                part = ids[at : at + size]
                n, crc, cls = len(part) // 4, zlib.crc32(part), 0
                if n < rules.length:
                    cls = -(-n // rules.unit)
                elif crc % rules.fill_every == 0:
                    cls = -1
                yield doc_id, at // 4, n, crc, len(ids) // 4, cls, part if cls < 0 else None

        return lambda ids, texts: (p for i, t in zip(ids, texts, strict=True) for p in cut(i, t))

    return map_rows(docs.select(id_col, text_col), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cls int, ids binary", make)


# ---------------------------------------------------------------- patterns


def knapsack(value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: item i (1..size) has weight i. Best value in every capacity up to ``size``, and the item to take there
    (0: leave one unit empty)."""
    best, pick = np.zeros(size + 1), np.zeros(size + 1, dtype=int)
    for cap in range(1, size + 1):
        worth = value[:cap] + best[cap - 1 :: -1][:cap]
        i = int(worth.argmax())
        if worth[i] > best[cap - 1] + 1e-12:
            best[cap], pick[cap] = worth[i], i + 1
        else:
            best[cap], pick[cap] = best[cap - 1], 0
    return best, pick


def pattern(pick: np.ndarray, size: int, first: int) -> np.ndarray:
    """How often each item is taken when ``first`` is, and then what ``pick`` says."""
    taken = np.zeros(size, dtype=np.int64)
    taken[first - 1] += 1
    cap = size - first
    while cap > 0:
        if pick[cap]:
            taken[pick[cap] - 1] += 1
            cap -= pick[cap]
        else:
            cap -= 1
    return taken


def greedy_basis(demand: np.ndarray) -> tuple[list[np.ndarray], list[float]]:
    """Patterns by first fit decreasing, each used until the first of its classes is used up, in fractions: as many patterns as
    classes, and, as a class that is used up is in no later pattern, a feasible basis of the linear program."""
    size = len(demand)
    sizes = (np.flatnonzero(demand) + 1).tolist()
    left = {w: float(demand[w - 1]) for w in sizes}
    patterns, times = [], []
    while sizes:
        room, p, k = size, {}, len(sizes) - 1
        while k >= 0:
            w = sizes[k]
            p[w] = min(room // w, max(1, int(left[w])))
            room -= p[w] * w
            k = min(k - 1, bisect_right(sizes, room) - 1)
        out = min(p, key=lambda w: left[w] / p[w])
        n = left[out] / p[out]
        for w, c in p.items():
            left[w] = max(left[w] - n * c, 0.0)
        sizes.remove(out)
        column = np.zeros(size, dtype=np.int64)
        column[np.array(list(p)) - 1] = list(p.values())
        patterns.append(column)
        times.append(n)
    return patterns, times


def fractional(demand: np.ndarray, gap: float, per_round: int, stall: int) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used, in fractions, by column generation with an explicit basis inverse, from
    ``greedy_basis`` on. Every knapsack proposes the best pattern through each of its ``per_round`` best items.

    Ends when no pattern is worth more than one, when the total is within ``gap`` of it (or half a sequence) of what the tokens
    need or the prices prove, or when ``stall`` knapsacks in a row have not lowered it, as happens at ties. Every end leaves a
    usable solution.
    """
    size, used = len(demand), np.flatnonzero(demand)
    m, number = len(used), np.full(len(demand), -1)
    number[used] = np.arange(m)
    wanted = demand[used].astype(float)
    basis, times = greedy_basis(demand)
    x, least, still = np.array(times), np.inf, 0
    bound = float(wanted @ (used + 1)) / size
    near = lambda: x.sum() - bound <= max(0.5, gap * x.sum())
    if near():
        return list(zip(basis, x.tolist(), strict=True))
    inverse = np.linalg.inv(np.array(basis, dtype=float)[:, used].T)
    while still < stall:
        price = inverse.sum(axis=0)
        prices = np.zeros(size)
        prices[used] = np.maximum(price, 0)
        best, pick = knapsack(prices, size)
        total = float(x.sum())
        bound = max(bound, prices[used] @ wanted / best[size])
        if best[size] <= 1 + 1e-7 or near():
            break
        still = 0 if total < least - 1e-6 * total else still + 1
        least = min(least, total)
        through = prices[used] + best[size - used - 1]
        for i in np.argsort(-through, kind="stable")[:per_round]:
            if through[i] <= 1 + 1e-7:
                break
            column = pattern(pick, size, int(used[i]) + 1)
            items = np.flatnonzero(column)
            rows, times = number[items], column[items]
            if price[rows] @ times <= 1 + 1e-7:  # an earlier one of this round has taken its worth
                continue
            d = inverse[:, rows] @ times
            ratio = np.full(m, np.inf)
            np.divide(x, d, out=ratio, where=d > 1e-9)
            out = int(ratio.argmin())
            if not np.isfinite(ratio[out]):
                continue
            step, row = ratio[out], inverse[out] / d[out]
            x = np.maximum(x - step * d, 0)
            x[out] = step
            some = np.flatnonzero(np.abs(d) > 1e-12)
            inverse[some] -= np.outer(d[some], row)
            inverse[out] = row
            price = price - d.sum() * row + row
            basis[out] = column
    return list(zip(basis, x.tolist(), strict=True))


def cutting_stock(demand: np.ndarray, gap: float = 1e-4, per_round: int = 8, stall: int = 60) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used. ``demand[i]``: pieces of size i + 1; a pattern's sizes sum to at most len(demand).

    The linear program's solution is rounded down; what is left of the demand is packed first-fit-decreasing. Uses exactly
    ``demand``.
    """
    if not demand.any():
        return []
    size, left, found = len(demand), demand.astype(np.int64).copy(), []
    for p, n in sorted(fractional(demand, gap, per_round, stall), key=lambda b: -b[1]):
        at = np.flatnonzero(p)
        n = min(int(n + 1e-6), int((left[at] // p[at]).min()))
        if n > 0:
            found.append((p, n))
            left -= p * n
    while left.any():
        # First fit decreasing: one pattern at a time, repeated as often as the remaining pieces allow.
        p, room = np.zeros(size, dtype=np.int64), size
        for i in np.flatnonzero(left)[::-1]:
            if i < room:
                p[i] = min(left[i], room // (i + 1))
                room -= int(p[i]) * (int(i) + 1)
        at = np.flatnonzero(p)
        n = int((left[at] // p[at]).min())
        found.append((p, n))
        left -= p * n
    return found


# ---------------------------------------------------------------- ranks and layout


def ranked(df: DataFrame, group: str, order: list[str], salts: int) -> DataFrame:
    """``df`` with ``rank``: 0, 1, ... within ``group``, in no set order but without gaps. No group meets in one task."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    totals = salted.groupBy(group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1))
    totals = totals.select(F.col(group).alias("_g"), F.col("_salt").alias("_s"), F.coalesce(before, F.lit(0)).alias("_before"))
    own = salted.withColumn("_row", F.row_number().over(W.partitionBy(group, "_salt").orderBy(*order)))
    joined = own.join(totals, (F.col(group) == F.col("_g")) & (F.col("_salt") == F.col("_s")))
    return joined.withColumn("rank", F.col("_row") - 1 + F.col("_before")).drop("_salt", "_row", "_g", "_s", "_before")


def layout(spark: SparkSession, patterns: list[tuple[np.ndarray, int]]) -> tuple[DataFrame, int]:
    """Patterns as rows (class, ranks lo up to hi, first sequence, pieces of the class a sequence, first slot)."""
    rows, at, base = [], {}, 0
    for p, n in patterns:
        slot = 0
        for i in np.flatnonzero(p)[::-1]:
            mult, lo = int(p[i]), at.get(i, 0)
            at[i] = lo + mult * n
            rows.append((int(i) + 1, lo, at[i], base, mult, slot))
            slot += mult
        base += n
    return spark.createDataFrame(rows, "p_cls int, lo long, hi long, first long, mult int, slot0 int"), base


def pack(docs: DataFrame, rules: PackRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their place: see the module's text. Columns as ``PIECES``."""
    rules = rules or PackRules()
    spark, length = docs.sparkSession, rules.length
    cut = materialize(chunks(docs, rules, id_col, text_col), "pack-chunks")
    counted = {r.cls: (r.n, r.tokens) for r in cut.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens")).collect()}
    if not counted:
        return spark.createDataFrame([], PIECES)
    demand = np.array([counted.get(c, (0, 0))[0] for c in range(1, length // rules.unit + 1)], dtype=np.int64)
    plan, n_packed = layout(spark, cutting_stock(demand))
    free = n_packed * length - sum(t for c, (_, t) in counted.items() if c > 0)
    n_whole, n_fill = counted.get(0, (0, 0))[0], counted.get(-1, (0, 0))[0]
    n_used = min(-(-free // length), n_fill)  # whole pieces that are sliced into what is free
    salts = int(min(max(sum(n for n, _ in counted.values()) // 50_000, 256), 65_536))

    order = ["doc_id", "start", "ids_crc32"]
    placed = ranked(cut.drop("ids"), "cls", order, salts)
    whole = placed.where(F.col("cls") <= 0)
    rest = placed.where(F.col("cls") > 0).join(F.broadcast(plan), (F.col("cls") == F.col("p_cls")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    step = F.col("rank") - F.col("lo")
    rest = rest.withColumn("sequence_id", F.col("first") + F.floor(step / F.col("mult"))).withColumn("slot", F.col("slot0") + step % F.col("mult"))
    # Ties in rank order are broken once: what is written here is what every later step reads.
    placed = materialize(
        rest.select(*order, "length", "doc_tokens", "cls", "sequence_id", "slot").unionByName(
            whole.select(*order, "length", "doc_tokens", "cls", F.col("rank").alias("sequence_id"), F.lit(0).alias("slot").cast("long"))
        ),
        "pack-placed",
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    in_sequence = W.partitionBy("sequence_id").orderBy("slot", *order)
    rest = placed.where(F.col("cls") > 0).withColumn("offset", F.coalesce(F.sum("length").over(in_sequence.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    alone = placed.where(F.col("cls") == 0).withColumn("sequence_id", F.col("sequence_id") + n_packed).withColumn("offset", F.lit(0).cast("long"))
    kept = placed.where((F.col("cls") == -1) & (F.col("sequence_id") >= n_used)).withColumn("sequence_id", F.col("sequence_id") + (n_packed + n_whole - n_used)).withColumn("offset", F.lit(0).cast("long"))
    result = rest.select(*columns).unionByName(alone.select(*columns)).unionByName(kept.select(*columns))
    if not n_used:
        return result

    # The free room of all sequences, end to end, is one line; fill piece j covers it from j * length on.
    width = -(-n_packed // 1024)
    room = rest.groupBy("sequence_id").agg((length - F.sum("length")).alias("room")).withColumn("_b", F.floor(F.col("sequence_id") / width))
    sums = room.groupBy("_b").agg(F.sum("room").alias("_r"))
    sums = sums.select("_b", F.coalesce(F.sum("_r").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inner = F.coalesce(F.sum("room").over(W.partitionBy("_b").orderBy("sequence_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    room = room.withColumn("_in", inner).join(F.broadcast(sums), "_b").withColumn("a", F.col("_in") + F.col("_base"))
    room = room.withColumn("b", F.least(F.col("a") + F.col("room"), F.lit(n_used * length))).where(F.col("a") < F.col("b"))
    room = room.select("sequence_id", "room", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / length), F.floor((F.col("b") - 1) / length))).alias("j"))
    lo, hi = F.greatest("a", F.col("j") * length), F.least("b", (F.col("j") + 1) * length)
    slices = room.select("j", (lo - F.col("j") * length).alias("lo"), (hi - F.col("j") * length).alias("hi"), "sequence_id", (length - F.col("room") + lo - F.col("a")).alias("offset"))
    if free < n_used * length:
        # What the last fill piece has over makes sequences whose lengths are powers of two, which need no padding.
        over, at, last = [], free - (n_used - 1) * length, n_packed + n_whole + n_fill - n_used
        for bit in reversed(range(length.bit_length())):
            if (length - at) >> bit & 1:
                over.append((n_used - 1, at, at + (1 << bit), last, 0))
                at, last = at + (1 << bit), last + 1
        slices = slices.unionByName(spark.createDataFrame(over, "j long, lo long, hi long, sequence_id long, offset long"))
    slices = slices.groupBy("j").agg(F.collect_list(F.struct("lo", "hi", "sequence_id", "offset")).alias("slices"))  # at most ``length`` a fill piece
    fill = placed.where((F.col("cls") == -1) & (F.col("sequence_id") < n_used)).select(*order, F.col("sequence_id").alias("j"))
    ids = cut.where(F.col("cls") == -1).select(*order, "doc_tokens", "ids").dropDuplicates(order)
    ids = ids.select(*[F.col(c).alias(f"i_{c}") for c in order], "doc_tokens", "ids")
    same = [F.col(c).eqNullSafe(F.col(f"i_{c}")) for c in order]
    filled = fill.join(ids, same).join(slices, "j").select("doc_id", "start", "doc_tokens", "ids", "slices")

    def make():
        def slice_up(doc_id, start, doc_tokens, ids, parts):
            for p in parts:
                yield doc_id, start + p["lo"], p["hi"] - p["lo"], zlib.crc32(ids[4 * p["lo"] : 4 * p["hi"]]), doc_tokens, p["sequence_id"], p["offset"]

        return lambda *cols: (x for row in zip(*cols, strict=True) for x in slice_up(*row))

    return result.unionByName(map_rows(filled, PIECES, make))
