"""Quality rules by tokeniser fertility (operator 9).

Every document is read whole. Beside the plain counts of words, symbols, repeated lines and repeated 3-word windows, a
public sentencepiece vocabulary measures per document

* characters per token (fertility),
* the share of byte-fallback tokens,
* the entropy of the document's token distribution,

and each must lie in the band of the document's language, or of its script when the language has no band. A document is
kept when neither the base rules nor a band rejects it.

Null or empty text: zero words, so ``base_failed`` and not kept. Null language: the band of the text's script. Repeated
rows are judged row by row. Extra columns are ignored. Lines are compared exactly; the first of equal lines is no copy.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD, WordMemo, map_rows, tokenizer_path

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Limits of one language or script. ``entropy_shift`` raises the entropy floor (bits); None for no floor."""

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy_shift: float | None = 0.0


@dataclass(frozen=True)
class FertilityRules:
    vocabulary: str = "piece_bpe_32k.model"
    folder: str | None = None
    min_words: int = 50
    max_repeat_percent: int = 50
    languages: dict[str, Band] = field(
        default_factory=lambda: {
            "en": Band((1.90, 8.0), 0.10, 0.12),
            "de": Band((1.90, 8.0), 0.10, 0.05),
            "es": Band((1.68, 8.0), 0.10),
            "fr": Band((1.75, 8.0), 0.10),
        }
    )
    #: A script is told from the majority of a text's letters. The floor was set on Latin script: Greek is written almost
    #: letter by letter and has one for that; scripts without labelled rows have none. "none" is text without letters.
    scripts: dict[str, Band] = field(
        default_factory=lambda: {
            "latin": Band((1.2, 8.0), 0.15),
            "cyrillic": Band((0.9, 8.0), 0.25, None),
            "greek": Band((0.4, 8.0), 0.40, -3.0),
            "cjk": Band((0.25, 4.0), 0.90, None),
            "other": Band((0.2, 8.0), 1.0, None),
            "none": Band((0.2, 8.0), 1.0, -3.0),
        }
    )
    #: Least entropy in bits at 2**k tokens, linear in between, level outside.
    entropy_floor: tuple[tuple[int, float], ...] = ((5, 3.6), (6, 4.9), (7, 5.3), (8, 5.75), (9, 6.05), (10, 6.2), (11, 6.35), (12, 6.45), (13, 6.5))

    def floor(self, tokens: int) -> float:
        x, pts = math.log2(max(tokens, 1)), self.entropy_floor
        if x <= pts[0][0]:
            return 0.0
        for (a, u), (b, v) in zip(pts, pts[1:], strict=False):
            if x <= b:
                return u + (v - u) * (x - a) / (b - a)
        return pts[-1][1]


def script_of(text: str) -> str:
    """Script of most letters, by Unicode range; "none" without letters."""
    seen: Counter[str] = Counter()
    for ch, n in Counter(text).items():
        if ch.isalpha():
            c = ord(ch)
            if c < 0x250 or 0x1E00 <= c < 0x1F00:
                seen["latin"] += n
            elif 0x370 <= c < 0x400:
                seen["greek"] += n
            elif 0x400 <= c < 0x530:
                seen["cyrillic"] += n
            elif 0x3040 <= c < 0x3100 or 0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4:
                seen["cjk"] += n
            else:
                seen["other"] += n
    return max(sorted(seen), key=seen.__getitem__) if seen else "none"


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    # Equal windows have equal hashes: where all hashes differ, nothing repeats and the windows need not be built.
    h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    keys = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    keys.sort()
    if (keys[1:] != keys[:-1]).all():
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    count, until = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            count += i + 3 - max(until, i)
            until = i + 3
    return count


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_tokens long, chars_per_token double, byte_share double, token_entropy double, reason string"
)


def judge(rules: FertilityRules):
    """f(text, lang) -> the columns of ``SCHEMA`` behind doc_id. Loads the vocabulary: call once a task."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(rules.vocabulary, rules.folder))
    is_byte = np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])
    memo = WordMemo(lambda words: [array("I", ids).tobytes() for ids in sp.encode(words, num_threads=1)], 500_000)

    def of(text: str | None, lang: str | None) -> tuple:
        text = text or ""
        words = WORD.findall(text)
        memo.ensure(words)
        ids = np.frombuffer(b"".join(map(memo.at, words)), dtype=np.uint32)
        n, chars = len(ids), sum(map(len, words))
        counts = np.bincount(ids, minlength=len(is_byte))
        some = counts[counts > 0]
        entropy = math.log2(n) - float(some @ np.log2(some)) / n if n else 0.0
        cpt = chars / n if n else 0.0
        share = int(counts[is_byte].sum()) / n if n else 0.0
        repeats = repeated_words(words)
        base = len(words) < rules.min_words or 100 * repeats > rules.max_repeat_percent * len(words)
        reason = "base" if base else None
        if not base:
            band = rules.languages.get(lang) or rules.scripts[script_of(text)]
            if not band.chars_per_token[0] <= cpt <= band.chars_per_token[1]:
                reason = "fertility"
            elif share > band.byte_share:
                reason = "byte_fallback"
            elif band.entropy_shift is not None and entropy < rules.floor(n) + band.entropy_shift:
                reason = "entropy"
        return len(words), chars, sum(map(text.count, SYMBOLS)), repeated_lines(text), repeats, base, reason is None, n, cpt, share, entropy, reason

    return of


def quality_rules(docs: DataFrame, rules: FertilityRules | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs`` with the counts, the fertility measures, ``kept`` and the first reason against it."""
    rules = rules or FertilityRules()

    def make():
        of = judge(rules)
        return lambda ids, texts, langs: ((i, *of(t, lang)) for i, t, lang in zip(ids, texts, langs, strict=True))

    return map_rows(docs.select(id_col, text_col, lang_col), SCHEMA, make)


def keep_good(docs: DataFrame, rules: FertilityRules | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged; no join, so repeated ids are judged row by row."""
    rules = rules or FertilityRules()
    text, lang = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches):
        of = judge(rules)
        for b in batches:
            yield b.filter(pa.array([of(t, x)[6] for t, x in zip(b.column(text).to_pylist(), b.column(lang).to_pylist(), strict=True)], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
