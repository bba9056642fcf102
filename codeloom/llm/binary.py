"""Token ids in packed binary matrices (operator 5).

Every task tokenises its documents, cuts overlong ones losslessly into full rows, and packs the remaining pieces
best-fit-decreasing: a segment tree over free capacities finds the fullest open row that still has room. A row of the
matrix is ``length`` unsigned 16-bit little-endian ids, padded with ``pad_id``; beside it stand the cumulative segment
lengths (as variable-length attention wants them), the positions at which position ids restart, and each segment's
document, its place within the document's ids and whether it is the document's last one. There is no shuffle.

Null or empty text gives the closing id alone. Repeated rows are packed row by row; extra columns are ignored.
``unpack`` gives every document's ids back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path


@dataclass(frozen=True)
class BinaryRules:
    length: int = 2048
    vocabulary: str = "byte_bpe_50k.tiktoken"
    folder: str | None = None
    end_id: int = 50256
    pad_id: int = 50256
    block_tokens: int = 4_000_000  #: pieces are packed together in blocks of about so many tokens; bounds a task's memory


class CapacityTree:
    """Segment tree over free capacities 0..length: how many open rows have each, and the least one that is enough."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        i = free + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (row, free) with the least free capacity of at least ``need``; None if no row has it."""
        i = need + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        free = i - self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.rows[free].pop(), free


def best_fit_decreasing(lengths: list[int], length: int) -> list[list[int]]:
    """Rows of indices into ``lengths``."""
    tree, rows = CapacityTree(length), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        row, free = tree.take(lengths[i]) or (len(rows), length)
        if row == len(rows):
            rows.append([])
        rows[row].append(i)
        tree.add(free - lengths[i], row)
    return rows


SCHEMA = (
    "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<long>, starts array<long>, last array<boolean>, pieces array<string>"
)
_ARROW = pa.schema([
    ("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())),
    ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("last", pa.list_(pa.bool_())), ("pieces", pa.list_(pa.string())),
])


def encoder(rules: BinaryRules):
    import base64

    import public_tokenizers
    import tiktoken

    with open(tokenizer_path(rules.vocabulary, rules.folder), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("packed", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_packed(docs: DataFrame, rules: BinaryRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per packed sequence. ``pieces`` names a segment's document row as "partition-row" so that repeated ids stay apart."""
    rules = rules or BinaryRules()

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        encode, length = encoder(rules).encode_ordinary, rules.length
        made = seen = 0

        def emit(rows):
            nonlocal made
            cols = [[] for _ in _ARROW]
            for row in rows:
                ids = np.full(length, rules.pad_id, dtype="<u2")
                cu = [0]
                for piece in row:
                    ids[cu[-1] : cu[-1] + len(piece[0])] = piece[0]
                    cu.append(cu[-1] + len(piece[0]))
                for c, v in zip(cols, ((part << 40) + made, cu[-1], ids.tobytes(), cu, cu[:-1], [p[1] for p in row], [p[2] for p in row], [p[3] for p in row], [p[4] for p in row]), strict=True):
                    c.append(v)
                made += 1
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)

        full, rest, held = [], [], 0

        def flush():
            rows = best_fit_decreasing([len(p[0]) for p in rest], length)
            for at in range(0, len(rows), 512):
                yield emit([[rest[i] for i in row] for row in rows[at : at + 512]])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), rules.end_id], dtype="<u2")
                name = f"{part}-{seen}"
                seen += 1
                for at in range(0, len(ids), length):
                    piece = (ids[at : at + length], doc_id, at, at + length >= len(ids), name)
                    if len(piece[0]) == length:
                        full.append([piece])
                    else:
                        rest.append(piece)
                        held += len(piece[0])
                if len(full) >= 512:
                    yield emit(full)
                    full = []
                if held >= rules.block_tokens:
                    yield from flush()
                    rest, held = [], 0
        if full:
            yield emit(full)
        yield from flush()

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)


def segments(packed: DataFrame, length: int = 2048) -> DataFrame:
    """Pieces of a packed table: (piece, doc_id, start, last, ids as binary)."""
    at = F.posexplode("pieces").alias("_k", "piece")
    rows = packed.select("ids", "cu_seqlens", "doc_ids", "starts", "last", at)
    lo, hi = F.get("cu_seqlens", F.col("_k")), F.get("cu_seqlens", F.col("_k") + 1)
    return rows.select("piece", F.get("doc_ids", F.col("_k")).alias("doc_id"), F.get("starts", F.col("_k")).alias("start"), F.get("last", F.col("_k")).alias("last"), F.substring("ids", 2 * lo + 1, 2 * (hi - lo)).alias("ids"))


def unpack(packed: DataFrame, rules: BinaryRules | None = None) -> DataFrame:
    """doc_id and text of every packed document row: the exact inverse of ``write_packed``."""
    rules = rules or BinaryRules()
    whole = segments(packed, rules.length).groupBy("piece").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("parts"))

    def run(batches):
        decode = encoder(rules).decode_bytes
        for b in batches:
            texts = [decode(np.frombuffer(b"".join(p["ids"] for p in parts), dtype="<u2")[:-1].tolist()).decode() for parts in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return whole.select("doc_id", "parts").mapInArrow(run, "doc_id long, text string")
