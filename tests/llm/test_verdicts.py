"""Quality verdicts against a plain reading of the rules, straight from the vocabulary."""

import math
import random
import unicodedata
from collections import Counter

import pytest

from codeloom.llm import quality
from codeloom.llm.common import tokenizer_path

from .conftest import prose


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def script(text):
    names = Counter(unicodedata.name(c, "?").split()[0] for c in text if c.isalpha())
    kinds = {"LATIN": "latin", "GREEK": "greek", "CYRILLIC": "cyrillic", "CJK": "cjk", "HIRAGANA": "cjk", "KATAKANA": "cjk", "HANGUL": "cjk"}
    sums = Counter()
    for k, n in names.items():
        sums[kinds.get(k, "other")] += n
    return sums.most_common(1)[0][0] if sums else "none"


def plain(text, lang, sp, rules):
    """(kept, reason)"""
    words = text.split() if text.isascii() else [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
        return False, "base"
    ids = [i for w in words for i in sp.encode(w)]
    band = rules.languages.get(lang) or rules.scripts[script(text)]
    per_token, shares = sum(map(len, words)) / len(ids), [n / len(ids) for n in Counter(ids).values()]
    if not band.chars_per_token[0] <= per_token <= band.chars_per_token[1]:
        return False, "fertility"
    if sum(map(sp.is_byte, ids)) / len(ids) > band.byte_share:
        return False, "byte_fallback"
    at, points = math.log2(len(ids)), rules.entropy_floor
    floor = 0.0
    if at > points[0][0]:
        floor = points[-1][1]
        for (a, u), (b, v) in zip(points, points[1:], strict=False):
            if a <= at <= b:
                floor = u + (v - u) * (at - a) / (b - a)
    if band.entropy_shift is not None and -sum(s * math.log2(s) for s in shares) < floor + band.entropy_shift:
        return False, "entropy"
    return True, None


def test_verdicts(spark, pieces):
    rng, rules = random.Random(3), quality.FertilityRules()
    texts = [(prose(i, rng.randrange(40, 300)), rng.choice(["en", "de", "es", "fr", "xx", None])) for i in range(40)]
    few = [prose(i, 30).split() for i in range(8)]
    texts += [(" ".join(rng.choice(w[: 3 + 4 * k]) for _ in range(150 + 40 * k)), rng.choice(["en", "fr"])) for k, w in enumerate(few)]
    texts += [(" ".join("".join(rng.choice(a) for _ in range(rng.randrange(2, 9))) for _ in range(120)), None) for a in ("αβγδεζηθικλμν", "абвгдежзикл", "日本語文字列東京都", "אבגדהוזחט", "😀☃★", "#$%&|<>", "0123456789", "aeiou bcd")]
    texts += [(" ".join("".join(rng.choice("qzxjkv#7%") for _ in range(6)) for _ in range(90)), x) for x in ("en", "de", None)]
    texts += [("short text", "en"), ("a b c " * 60, "en"), ("", "en")]
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.kept, r.reason) for r in quality.quality_rules(df).collect()}
    want = {i: plain(t, x, pieces, rules) for i, (t, x) in enumerate(texts)}
    assert got == want and {r for _, r in want.values()} >= {"base", "fertility", "entropy", None}
    assert sorted(r.doc_id for r in quality.keep_good(df).collect()) == [i for i in want if want[i][0]]
