"""Repeated byte strings by merging shard Burrows-Wheeler transforms (operator 6).

A byte goes when a ``length``-byte string that covers it also starts anywhere else, in the same document or another.
Beside that, the same intervals tell the passages of ``passage`` bytes or more that other documents hold too.

1. Candidates. Every window of ``passage`` bytes belongs to the position of the least 32-byte gram in it, so equal windows
   belong to equal grams at equal distance. Windows of one gram are dealt into pieces of at most ``step`` neighbours; all
   windows of a piece share a block of ``passage - step + 1`` bytes. Only pieces whose block occurs twice go on: nothing is
   lost, and most of the text never leaves its row. Equal pieces are counted before they move (by 128 bits of hash), and one
   of them stands for all with its multiplicity and the range of documents that have it.
2. Suffix order. A piece's string runs on to ``length`` bytes from its last window. Strings are spread by their block, so all
   equal windows meet in one task. There they are cut into shards; each shard gets its suffix array and Burrows-Wheeler
   transform over an alphabet of ``letter``-byte blocks, in which a window has up to ``length / letter`` letters. The shard
   transforms are merged by iterative interleave refinement: starting from one interleave of all shards, each round reads
   the transforms in the order of the interleave and sorts the suffixes stably by the letter in front, which orders them by
   one letter more. The round in which two neighbours part is their common prefix. Suffixes are sorted within a shard
   only; the merge reads transforms and never compares suffixes again.
3. Repeated intervals. Runs of neighbours whose common prefix reaches ``length`` bytes, with two or more occurrences in all, are
   the strings to remove; runs that reach ``passage`` bytes and span two documents are the shared passages.
4. Removal. Intervals become byte ranges of all documents that hold the pieces; ranges are merged and cut out.

A block that very many different strings share (``hot``) is split: its strings are cut into pieces of a tenth of the windows,
which share longer blocks, and so on down to single windows; every level goes through step 2. Single windows of one block
are equal in ``passage`` bytes already, and different strings of theirs have no longer interval in common.

Null text counts as empty. Repeated rows repeat every string in them; a row is known by its id and text, and rows that share
both are one document for the shared passages. Extra columns are ignored. Texts shorter than ``length`` keep all bytes.
Letters and pieces are compared by 64-bit hashes within a block, which is told by another 64 bits.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, own_tables

_U = np.uint64


@dataclass(frozen=True)
class RepeatRules:
    length: int = 400
    passage: int = 200  #: a multiple of ``letter``, at least ``length / 2``
    passage_words: int = 50  #: whole words from which a shared run of ``passage`` bytes or more counts as a passage
    gram: int = 32  #: a power of two
    step: int = 100
    letter: int = 100  #: of the transforms' alphabet, in bytes; divides ``length``
    block_bytes: int = 1_000_000  #: longer texts are read in overlapping blocks of so many bytes
    hot: int = 2_000  #: different strings of one block from which the block is split
    merge_bytes: int = 1_500_000  #: of strings whose transforms are merged together; whole blocks always are
    shard_bytes: int = 500_000
    task_bytes: int = 24 << 20  #: of strings in a task of step 2, in expectation


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


_draw = np.random.default_rng(400_032)
_BYTE = (_draw.integers(0, 1 << 63, 256, dtype=np.uint64) << _U(1)) | _U(1)
_FACTOR = (_draw.integers(0, 1 << 63, 2, dtype=np.uint64) << _U(1)) | _U(1)


_BASE = 0x9E3779B97F4A7C15 | 5
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of the base and of its inverse


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[i] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Hashes of all substrings of a byte array: sums of byte values times powers of a base, modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:-1], out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        """Of every substring of one length."""
        return (self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size]

    def at(self, starts: np.ndarray, sizes) -> np.ndarray:
        """Of the substrings at ``starts``, of one length or of their own."""
        return (self.sums[starts + sizes] - self.sums[starts]) * self.down[starts]


def windows_by_gram(n: int, rules: RepeatRules, rolling: Rolling) -> np.ndarray:
    """For each of the first ``n`` windows: the start of the least gram in the window (the first of equals)."""
    width = rules.passage - rules.gram + 1
    g = mixed(rolling.all(rules.gram))
    least = ((g >> _U(24)) << _U(24)) | np.arange(len(g), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return (np.minimum(least[:n], least[width - size : width - size + n]) & _U(0xFFFFFF)).astype(np.int64)


PIECE = ("key", "whole", "first", "place")
_BITS, _LOW = 20, (1 << 20) - 1


def place_of(n: np.ndarray, size: np.ndarray, back: np.ndarray) -> np.ndarray:
    return n.astype(np.int64) << 2 * _BITS | size.astype(np.int64) << _BITS | back.astype(np.int64)


def unplace(place: int) -> tuple[int, int, int]:
    return place >> 2 * _BITS, place >> _BITS & _LOW, place & _LOW


def pieces(data: np.ndarray, rules: RepeatRules) -> tuple[np.ndarray, ...]:
    """Columns ``PIECE`` of every piece: hash of its shared block, hash of its string, first window; and in one number, by
    ``place_of``, its windows, the bytes of its string and how far behind the first window the shared block starts."""
    found = []
    for at in range(0, len(data) - rules.passage + 1, rules.block_bytes):
        part = data[at : at + rules.block_bytes + rules.length - 1]
        rolling = Rolling(part)
        anchor = windows_by_gram(min(len(part) - rules.passage + 1, rules.block_bytes), rules, rolling)
        start = np.arange(len(anchor))
        cell = (anchor - start) // rules.step
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])]))
        count = np.diff(np.append(first, len(anchor)))
        block_at = anchor[first] - cell[first] * rules.step  # where the cell's last window starts, or would
        key = mixed(rolling.at(block_at, rules.passage - rules.step + 1) + cell[first].astype(np.uint64) * _FACTOR[0])
        size = np.minimum(count + rules.length - 1, len(part) - first)
        about = (anchor[first] - first) << 40 | count << _BITS | size
        whole = mixed(rolling.at(first, size) + about.astype(np.uint64) * _FACTOR[1])
        found.append((key.view(np.int64), whole.view(np.int64), first + at, place_of(count, size, block_at - first)))
    if not found:
        return (np.empty(0, np.int64),) * len(PIECE)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


# ---------------------------------------------------------------- step 2: suffix order


def by_letter(letters: np.ndarray) -> np.ndarray:
    """Stable order of letters given as numbers from 0 on, 16 bits at a time."""
    order = np.argsort(letters.astype(np.uint16), kind="stable")
    if len(letters) and letters.max() >> 16:
        order = order[np.argsort((letters >> 16).astype(np.uint16)[order], kind="stable")]
    return order


class Shard:
    """Texts of some letters each, with their suffix array and Burrows-Wheeler transform.

    Text ``i`` is the next ``size[i]`` of ``letters``. ``transform`` has the letter before each suffix, in suffix order, and -1
    before whole texts. Suffixes are ordered by their first ``depth`` letters; a text's end is unlike everything.
    """

    def __init__(self, letters: np.ndarray, size: np.ndarray, depth: int):
        self.letters = letters.astype(np.int32)
        end = np.cumsum(size, dtype=np.int64)
        self.ends = (end - 1).astype(np.int32)
        before = np.empty_like(self.letters)  # the letter before each suffix
        before[1:] = self.letters[:-1]
        before[end - size] = -1
        order = np.arange(len(letters), dtype=np.int32)
        for _ in range(depth):
            order = self.refine(order, before)
        self.suffixes = order
        self.transform = before[order]
        self.whole = self.transform < 0

    def refine(self, order: np.ndarray, before: np.ndarray) -> np.ndarray:
        """From an order of the suffixes by k letters, the order by k + 1."""
        source = np.concatenate([self.ends, order[before[order] >= 0] - 1])
        return source[by_letter(self.letters[source])]


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, common prefix with the suffix before, in letters up to ``depth``) of all suffixes in merged order.

    The interleave is a sequence of shard numbers. A round reads each shard's transform along the interleave and sorts the
    suffixes stably by the letter in front of them. Last letters are the only suffixes that no transform entry yields; they
    lead every round. Where a block of suffixes that agreed so far splits in a round, the letters agreed on before that round
    are the common prefix at the split; later rounds move suffixes only between the splits.
    """
    kind = np.uint8 if len(shards) < 256 else np.int32
    last = np.concatenate([s.letters[s.ends] for s in shards])
    last_shard = np.repeat(np.arange(len(shards), dtype=kind), [len(s.ends) for s in shards])
    inter = np.repeat(np.arange(len(shards), dtype=kind), [len(s.suffixes) for s in shards])
    block = np.zeros(len(inter), np.int32)
    common = np.full(len(inter), depth, np.int8)
    for r in range(depth):
        letters = along([s.transform for s in shards], inter)
        has = letters >= 0
        letters = np.concatenate([last, letters[has]])
        # A last letter may equal another; what would follow it is unlike everything.
        ends = -1 - np.arange(len(last), dtype=np.int32) if r else np.zeros(len(last), np.int32)
        behind = np.concatenate([ends, block[has]])
        order = by_letter(letters)
        inter = np.concatenate([last_shard, inter[has]])[order]
        letters, behind = letters[order], behind[order]
        split = np.empty(len(inter), bool)
        split[:1] = True
        np.not_equal(letters[1:], letters[:-1], out=split[1:])
        split[1:] |= behind[1:] != behind[:-1]
        common[split & (common == depth)] = r
        block = np.cumsum(split, dtype=np.int32)
    return inter, common


def along(parts: list[np.ndarray], inter: np.ndarray) -> np.ndarray:
    """The parts' entries, each in its order, along an interleave."""
    if len(parts) == 1:
        return parts[0]
    out = np.empty(len(inter), parts[0].dtype)
    for i, p in enumerate(parts):
        out[inter == i] = p
    return out


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the true runs."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def repeated_intervals(data: np.ndarray, size: np.ndarray, windows: np.ndarray, copies: np.ndarray, d_lo: np.ndarray, d_hi: np.ndarray, rules: RepeatRules) -> list[tuple[np.ndarray, ...]]:
    """(string, first window, end window) of runs of windows: first those where ``length`` bytes from each window on occur twice in
    all, then those where ``passage`` bytes occur in two documents. ``data`` holds the strings, of ``size`` bytes each, one behind the
    other; ``copies`` and the documents from ``d_lo`` to ``d_hi`` are those of a whole string."""
    depth, letter = rules.length // rules.letter, rules.letter
    base = np.cumsum(size) - size
    before = np.cumsum(windows) - windows
    string = np.repeat(np.arange(len(size)), windows)
    window = np.arange(len(string)) - before[string]
    n_letters = np.minimum((size[string] - window) // letter, depth)
    text_at = np.cumsum(n_letters) - n_letters
    text = np.repeat(np.arange(len(string), dtype=np.int32), n_letters)
    starts = (base[string] + window - letter * text_at)[text] + letter * np.arange(len(text))
    letters = np.unique(Rolling(data).at(starts, letter), return_inverse=True)[1]

    # Shards of whole strings.
    number = np.cumsum(size) // rules.shard_bytes
    cuts = np.unique(before[np.flatnonzero(np.diff(number, prepend=-1))])  # first text of each shard
    shards, owners = [], []
    for lo, hi in zip(cuts, [*cuts[1:], len(string)], strict=True):
        at, end = text_at[lo], text_at[hi] if hi < len(string) else len(letters)
        s = Shard(letters[at:end], n_letters[lo:hi], depth)
        shards.append(s)
        owners.append(np.where(s.whole, text[at:end][s.suffixes], -1))
    inter, common = merge(shards, depth)
    member = along(owners, inter)  # the text of each suffix that is a whole one
    whole = member >= 0
    member = member[whole]
    of = string[member]
    out = []
    for reach in (depth, rules.passage // letter):
        interval = np.cumsum(common < reach, dtype=np.int32)[whole]
        first = np.flatnonzero(np.diff(interval, prepend=-1))
        if len(out):
            hit = np.minimum.reduceat(d_lo[of], first) != np.maximum.reduceat(d_hi[of], first)
        else:
            hit = np.add.reduceat(np.minimum(copies, 2)[of], first) > 1
        hit = np.repeat(hit, np.diff(first, append=len(interval))) & (n_letters[member] >= reach)
        flags = np.zeros(len(string) + len(size), bool)  # with a gap behind every string
        flags[member[hit] + of[hit]] = True
        a, b = runs(flags)
        gapped = before + np.arange(len(size))
        owner = np.searchsorted(gapped, a, side="right") - 1
        out.append((owner, a - gapped[owner], b - gapped[owner]))
    return out


# ---------------------------------------------------------------- the operator

STRING = "key long, whole long, kinds long, copies long, d_lo long, d_hi long, place long, s binary"
HITS = "key long, whole long, r_lo int, r_hi int, s_lo int, s_hi int"  #: byte ranges in a string: to remove, shared with other documents
RANGE = ("r_lo", "r_hi", "s_lo", "s_hi")
PARTS = "key0 long, whole0 long, off int, key long, whole long, copies long, d_lo long, d_hi long, place long, s binary"


def with_kinds(strings: DataFrame) -> DataFrame:
    """``strings`` that can repeat, with the number of different strings of their block."""
    kinds = strings.groupBy(F.col("key").alias("_k")).agg(F.count(F.lit(1)).alias("kinds"))
    joined = strings.join(materialize(kinds, "repeat-kinds").hint("shuffle_hash"), strings.key == F.col("_k")).drop("_k")
    return joined.where((F.col("kinds") > 1) | (F.col("copies") > 1))


def hits_of_rows(rows: pa.RecordBatch, rules: RepeatRules) -> pa.RecordBatch:
    """``HITS`` of (key, whole, kinds, copies, d_lo, d_hi, place, s): all strings of their blocks."""
    key, whole, kinds, copies, d_lo, d_hi, place = (rows.column(i).to_numpy() for i in range(7))
    s = rows.column(7).cast(pa.large_binary())
    at = np.frombuffer(s.buffers()[1], np.int64)[s.offset : s.offset + len(s) + 1]
    data = np.frombuffer(s.buffers()[2], np.uint8)[at[0] : at[-1]]
    n, full = place >> 2 * _BITS, place >> _BITS & _LOW
    # A string that is alone in its block repeats as a whole or not at all: its first window stands for all.
    alone = kinds == 1
    found = []
    for (of, a, b), reach, all_of_it in zip(repeated_intervals(data, np.diff(at), np.where(alone, 1, n), copies, d_lo, d_hi, rules), (rules.length, rules.passage), (full, n - 1 + rules.passage), strict=True):
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        found.append((of << 10 | rank, a, np.where(alone[of], all_of_it[of], b - 1 + reach)))
    # The i-th runs of both kinds share a row.
    rows_of = np.unique(np.concatenate([f[0] for f in found]))
    cols = [pa.array(key[rows_of >> 10]), pa.array(whole[rows_of >> 10])]
    for slot, lo, hi in found:
        row, none = np.searchsorted(rows_of, slot), np.ones(len(rows_of), bool)
        none[row] = False
        for v in (lo, hi):
            x = np.zeros(len(rows_of), np.int32)
            x[row] = v
            cols.append(pa.array(x, mask=none))
    return pa.RecordBatch.from_arrays(cols, names=["key", "whole", *RANGE])


def merged_hits(opened: DataFrame, total: int, rules: RepeatRules) -> DataFrame:
    """``HITS`` of strings, of ``total`` bytes about, whose blocks are not hot: by merged transforms, some whole blocks at a time."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size < rules.merge_bytes:
                continue
            rows = pa.concat_batches(held)
            keys, length = rows.column(0).to_numpy(), np.cumsum(pa.compute.binary_length(rows.column(7)).to_numpy())
            first = np.flatnonzero(np.diff(keys, prepend=keys[0] ^ 1))  # of each block
            done = 0
            for at in first[1:]:
                if length[at - 1] - (length[done - 1] if done else 0) >= rules.merge_bytes or at == first[-1]:
                    yield hits_of_rows(rows.slice(done, at - done), rules)
                    done = int(at)
            held, size = [rows.slice(done)], int(length[-1] - (length[done - 1] if done else 0))
        if held and sum(b.num_rows for b in held):
            yield hits_of_rows(pa.concat_batches(held), rules)

    tasks = int(max(1, -(-total // rules.task_bytes)))
    columns = ["key", "whole", "kinds", "copies", "d_lo", "d_hi", "place", "s"]
    return opened.select(*columns).repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(run, HITS)


def hash_of(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def finer(hot: DataFrame, span: int, rules: RepeatRules) -> DataFrame:
    """``PARTS``: strings cut into pieces of ``span`` windows at most, which share a block of ``passage - span + 1`` bytes."""

    def split():
        def run(key0, whole0, copies, d_lo, d_hi, place, s):
            (n, _, back), w0 = unplace(place), 0
            while w0 < n:
                sub = (back - w0) // span
                block = back - sub * span
                w1 = min(n, block + 1)  # the end of the windows whose block starts where this one's does
                part = s[w0 : w1 - 1 + rules.length]
                key = hash_of(key0.to_bytes(8, "little", signed=True), sub.to_bytes(8, "little"), s[block : block + rules.passage - span + 1])
                own = (w1 - w0) << 2 * _BITS | len(part) << _BITS | (block - w0)
                yield key0, whole0, w0, key, hash_of(part, (w1 - w0).to_bytes(4, "little")), copies, d_lo, d_hi, own, part
                w0 = w1

        return lambda *cols: (x for row in zip(*cols, strict=True) for x in run(*row))

    return map_rows(hot.select("key", "whole", "copies", "d_lo", "d_hi", "place", "s"), PARTS, split)


def hits_of(strings: DataFrame, fetch, rules: RepeatRules, span: int) -> DataFrame:
    """``HITS`` of all strings, which are pieces of at most ``span`` windows; ``fetch`` adds their bytes as ``s``, in one pass."""
    size = F.shiftright("place", _BITS).bitwiseAND(F.lit(_LOW))
    total, hot = strings.agg(F.sum(F.when(F.col("kinds") == 1, F.least(size, F.lit(rules.length))).otherwise(size)), F.max("kinds")).first()
    opened = fetch(strings)
    if (hot or 0) < rules.hot:
        return merged_hits(opened, total or 0, rules)
    opened = materialize(opened, "repeat-opened")
    found = merged_hits(opened.where(F.col("kinds") < rules.hot), total or 0, rules)
    hot = opened.where(F.col("kinds") >= rules.hot)
    if span == 1:
        # Single windows of one block agree in their first ``passage`` bytes, and no two strings agree in all.
        docs = hot.groupBy(F.col("key").alias("_k")).agg(F.min("d_lo").alias("_lo"), F.max("d_hi").alias("_hi")).where(F.col("_lo") != F.col("_hi"))
        docs = materialize(docs.select("_k", F.lit(True).alias("_shared")), "repeat-shared")
        ranged = hot.join(docs, F.col("key") == F.col("_k"), "left")
        when = lambda c, hi: (F.when(c, F.lit(0)), F.when(c, F.lit(hi)))
        twice = (F.col("copies") > 1) & (size >= rules.length)
        cols = (*when(twice, rules.length), *when(F.col("_shared"), rules.passage))
        return found.unionByName(ranged.select("key", "whole", *[c.alias(n) for c, n in zip(cols, RANGE, strict=True)]))
    span = max(span // 10, 1)
    parts = materialize(finer(hot, span, rules), "repeat-parts")
    sums = [F.sum("copies").alias("copies"), F.min("d_lo").alias("d_lo"), F.max("d_hi").alias("d_hi")]
    inner = parts.groupBy("key", "whole").agg(*sums, *[F.first(c).alias(c) for c in ("place", "s")])
    inner = with_kinds(materialize(inner, "repeat-strings"))
    inner = hits_of(materialize(inner, "repeat-open"), lambda x: x, rules, span).select(F.col("key").alias("_k"), F.col("whole").alias("_w"), *RANGE)
    back = parts.select("key0", "whole0", "off", "key", "whole").join(inner, (F.col("key") == F.col("_k")) & (F.col("whole") == F.col("_w")))
    return found.unionByName(back.select(F.col("key0").alias("key"), F.col("whole0").alias("whole"), *[(F.col(c) + F.col("off")).alias(c) for c in RANGE]))


def cut_pieces(rows: DataFrame, rules: RepeatRules) -> DataFrame:
    """``PIECE`` of every row of (doc_id, t, text)."""

    def run(batches):
        held, size = [], 0

        def flush():
            nums = [len(p[0]) for _, _, p in held]
            ids = [np.repeat(np.array([h[j] for h in held], np.int64), nums) for j in range(2)]
            cols = [np.concatenate([h[2][j] for h in held]) for j in range(len(PIECE))]
            return pa.RecordBatch.from_arrays([*map(pa.array, ids), *map(pa.array, cols)], names=["doc_id", "t", *PIECE])

        for b in batches:
            for i, t, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                p = pieces(np.frombuffer((x or "").encode(), np.uint8), rules)
                if len(p[0]):
                    held.append((i, t, p))
                    size += len(p[0])
                if size > 100_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return rows.mapInArrow(run, "doc_id long, t long, key long, whole long, first long, place long")


def key_of() -> dict[str, Column]:
    """What a row of (doc_id, text) is known by: its id (0 for none) and the text's hash."""
    return {"doc_id": F.coalesce("doc_id", F.lit(0)), "t": F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull())}


def repeated_ranges(docs: DataFrame, rules: RepeatRules) -> DataFrame:
    """(doc_id, t) and ``RANGE``: byte ranges of the rows known by ``key_of``, not yet merged."""
    spark = docs.sparkSession
    rows = docs.select(*[c.alias(n) for n, c in key_of().items()], "text")
    with own_tables(spark):
        all_pieces = materialize(cut_pieces(rows, rules), "repeat-pieces")
        twice = all_pieces.groupBy(F.col("key").alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_k")
        twice = materialize(twice, "repeat-keys")
        some = materialize(all_pieces.join(twice.hint("shuffle_hash"), F.col("key") == F.col("_k"), "left_semi"), "repeat-some", outer=True)
        del all_pieces, twice
    with own_tables(spark):
        row = F.xxhash64("doc_id", "t")
        counts = [F.count(F.lit(1)).alias("copies"), F.min(row).alias("d_lo"), F.max(row).alias("d_hi")]
        strings = some.groupBy("key", "whole").agg(*counts, *[F.first(c).alias(c) for c in ("doc_id", "t", "first", "place")])
        strings = materialize(with_kinds(materialize(strings, "repeat-strings")), "repeat-open", outer=True)

    def fetch(strings: DataFrame) -> DataFrame:
        """The bytes of one occurrence of each string; what one text is asked for is bounded by the text."""
        fields = ["key", "whole", "kinds", "copies", "d_lo", "d_hi", "place"]
        wanted = strings.groupBy("doc_id", "t").agg(F.collect_list(F.struct("first", *fields)).alias("asked"))
        text = rows.dropDuplicates(["doc_id", "t"]).select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), "text")
        joined = wanted.join(text, (F.col("doc_id") == F.col("_d")) & (F.col("t") == F.col("_t"))).select("asked", "text")

        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, 128):
                    asked, texts = (c.slice(at, 128) for c in b.columns)
                    flat = asked.flatten()
                    first, kinds, place = (flat.field(f).to_numpy() for f in ("first", "kinds", "place"))
                    size = place >> _BITS & _LOW
                    ends = (first + np.where(kinds == 1, np.minimum(size, rules.length), size)).tolist()
                    first, k, parts = first.tolist(), 0, []
                    for n, x in zip(pa.compute.list_value_length(asked).to_pylist(), texts.to_pylist(), strict=True):
                        raw = (x or "").encode()
                        parts += [raw[first[j] : ends[j]] for j in range(k, k + n)]
                        k += n
                    yield pa.RecordBatch.from_arrays([*(flat.field(f) for f in fields), pa.array(parts, type=pa.binary())], names=[*fields, "s"])

        return joined.mapInArrow(run, STRING)

    with own_tables(spark):
        hits = materialize(hits_of(strings, fetch, rules, rules.step), "repeat-hits", outer=True)
    hits = hits.select(F.col("key").alias("_k"), F.col("whole").alias("_w"), *RANGE)
    found = some.select("doc_id", "t", "key", "whole", "first").join(hits.hint("shuffle_hash"), (F.col("key") == F.col("_k")) & (F.col("whole") == F.col("_w")))
    return found.select("doc_id", "t", *[(F.col("first") + F.col(c)).alias(c) for c in RANGE])


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_words long"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def unions(ranges: pa.ListArray, lo: str, hi: str) -> list[list[tuple[int, int]]]:
    """For each row of ``RANGE``s, the merged ranges of one kind, in order."""
    flat, n = ranges.flatten(), pa.compute.fill_null(pa.compute.list_value_length(ranges), 0).to_numpy()
    a, b = flat.field(lo).fill_null(-1).to_numpy(), flat.field(hi).fill_null(-1).to_numpy()
    some = a >= 0
    row, a, b = np.repeat(np.arange(len(n)), n)[some], a[some], b[some]
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(n))]
    if not len(a):
        return out
    gap = int(b.max()) + 2  # rows one behind the other, so that ranges of two never touch
    a, b = a + row * gap, b + row * gap
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(b[order])
    first = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
    start, end = a[first], reach[np.append(first[1:], len(a)) - 1]
    row = start // gap
    for i, x, y in zip(row.tolist(), (start - row * gap).tolist(), (end - row * gap).tolist(), strict=True):
        out[i].append((x, y))
    return out


def whole_words(raw: bytes, lo: int, hi: int) -> int:
    """Words that begin and end within ``raw[lo:hi]``."""
    n, cut = 0, False
    for m in _WORD.finditer(raw, lo, hi):
        n += 1
        cut = m.end() == hi
        n -= m.start() == lo > 0 and bool(_WORD.match(raw, lo - 1, lo))
    return max(n - (cut and hi < len(raw) and bool(_WORD.match(raw, hi, hi + 1))), 0)


def repeated_spans(docs: DataFrame, rules: RepeatRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text, ranges (``RANGE``, not yet merged; null for none)."""
    rules = rules or RepeatRules()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # A set: rows that share id and text give the same ranges. So at most one element a window of a text.
    ranges = repeated_ranges(docs, rules).groupBy("doc_id", "t").agg(F.collect_set(F.struct(*RANGE)).alias("ranges"))
    ranges = materialize(ranges.select(F.col("doc_id").alias("_d"), F.col("t").alias("_t2"), "ranges"), "repeat-ranges")
    rows = docs.select("doc_id", "text", *[c.alias(f"_{n}") for n, c in key_of().items()])
    return rows.join(ranges, (F.col("_doc_id") == F.col("_d")) & (F.col("_t") == F.col("_t2")), "left").select("doc_id", "text", "ranges")


def remove_repeats(docs: DataFrame, rules: RepeatRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: what is removed and the digest of what stays; ``n_passages`` runs of ``passage_words`` whole words or
    more in all, every ``passage`` bytes of which occur in another document, and the words in them."""
    rules = rules or RepeatRules()

    def cut(text, spans, shared):
        raw, kept, at, removed = (text or "").encode(), [], 0, 0
        for lo, hi in spans:
            kept.append(raw[at:lo])
            at, removed = hi, removed + hi - lo
        kept.append(raw[at:])
        words = [w for w in (whole_words(raw, lo, hi) for lo, hi in shared) if w >= rules.passage_words]
        return len(raw), removed, len(spans), hashlib.sha256(b"".join(kept)).hexdigest(), len(words), sum(words)

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = [f.split()[0] for f in OUT.split(", ")]
        for b in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            both = (unions(b.column(2), "r_lo", "r_hi"), unions(b.column(2), "s_lo", "s_hi"))
            cols = zip(*map(cut, b.column(1).to_pylist(), *both), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return repeated_spans(docs, rules, id_col, text_col).mapInArrow(run, OUT)
