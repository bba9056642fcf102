"""Toxicity by subword-bag embeddings (operator 1).

A word is the bag of itself and its character n-grams with word-boundary marks, hashed to a fixed number of buckets. A
text is the mean over its words of their subwords' mean embedding; a linear softmax reads the two classes off it.
Embeddings and softmax are trained jointly by Adam in numpy on a bounded sample of labelled documents, so misspelt and
unseen words score by the n-grams they share with known ones.

Scoring collapses the linear model: every bucket has one number, a word the mean of its buckets', a text the mean of its
words' plus the bias. Every whole text is scored, map-only.

Labels are learned only from rows that are not held out (crc32 of the id as text, mod 5, is not 0); a document with
several labels takes the largest, null labels are ignored. A text without words trains the bias alone. Without two classes in the sample every score is the base
rate. Null and empty texts have no words and score by the bias alone; a null id is not held out. Repeated rows are scored row by row; extra columns
are ignored. Language, source and id are never inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, map_rows, materialize

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicRules:
    buckets: int = 1 << 16
    width: int = 8
    grams: tuple[int, int] = (3, 5)
    train_rows: int = 14_000  #: the sample: at most so many labelled documents,
    train_chars: int = 56_000_000  #: of at most so many characters together
    epochs: int = 10
    batch: int = 256
    rate: float = 0.3
    seed: int = 13


def subwords(word: str, rules: ToxicRules) -> list[int]:
    """Buckets of the whole word and of its n-grams."""
    s = f"<{word}>"
    lo, hi = rules.grams
    parts = [s] + [s[i : i + n] for n in range(lo, min(hi, len(s) - 1) + 1) for i in range(len(s) - n + 1)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % rules.buckets for p in parts]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Model:
    """Per-bucket score and bias of a trained model: log-odds of a text = bias + mean of its words' scores."""

    scores: np.ndarray
    bias: float


def train(texts: list[str], labels: list[int], rules: ToxicRules) -> Model:
    """Uses up ``texts``: each is freed once its words are counted."""
    y = np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        rate = (float(y.sum()) + 0.5) / (len(y) + 1.0)
        return Model(np.zeros(rules.buckets, np.float32), float(np.log(rate / (1 - rate))))
    # Words by the hash of their spelling; a word's n-grams lie one behind the other in ``flat``.
    number: dict[int, int] = {}
    grams, starts, docs = array("i"), array("q", [0]), []
    texts.reverse()
    while texts:
        ids = array("i")
        for w in words_of(texts.pop()):
            i = number.setdefault(hash(w), len(number))
            if i == len(starts) - 1:
                grams.extend(subwords(w, rules))
                starts.append(len(grams))
            ids.append(i)
        words, times = np.unique(np.frombuffer(ids, np.int32), return_counts=True)
        docs.append((words, times.astype(np.int32)))
    flat, starts = np.frombuffer(grams, np.int32), np.frombuffer(starts, np.int64)
    del number

    rng = np.random.default_rng(rules.seed)
    E = rng.normal(0, 0.1, (rules.buckets, rules.width)).astype(np.float32).T.copy()  # a row per dimension
    V = rng.normal(0, 0.5, (rules.width, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    params = [E, V, bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    pos = float(y.mean())
    weight = np.where(y > 0, 0.5 / pos, 0.5 / (1 - pos)) ** 0.5
    steps, step = rules.epochs * -(-len(y) // rules.batch), 0
    for _ in range(rules.epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), rules.batch):
            pick = order[at : at + rules.batch]
            bag = [docs[i] for i in pick]
            n_words = np.array([len(b[0]) for b in bag])
            words, back = np.unique(np.concatenate([b[0] for b in bag]), return_inverse=True)
            share = np.concatenate([b[1] / max(b[1].sum(), 1) for b in bag]).astype(np.float32)
            doc_of = np.repeat(np.arange(len(pick)), n_words)
            sizes = starts[words + 1] - starts[words]
            gram = flat[np.repeat(starts[words] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())]
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            word_vec = [np.add.reduceat(e[gram], first) / sizes if len(words) else np.empty(0, np.float32) for e in E]
            mean = np.stack([np.bincount(doc_of, share * x[back], len(pick)) for x in word_vec], 1).astype(np.float32)
            logits = mean @ V + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            delta = p.copy()
            delta[np.arange(len(pick)), y[pick].astype(int)] -= 1
            delta *= (weight[pick] / len(pick))[:, None].astype(np.float32)
            d_mean = delta @ V.T
            d_word = [np.bincount(back, share * d_mean[doc_of, k], len(words)) / sizes for k in range(rules.width)]
            d_E = np.stack([np.bincount(gram, np.repeat(x, sizes), rules.buckets) for x in d_word]).astype(np.float32)
            step += 1
            rate = rules.rate * (1 - (step - 1) / steps)
            for q, g, a, b in zip(params, (d_E, mean.T @ delta, delta.sum(0)), m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Model((V[:, 1] - V[:, 0]) @ E, float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rules: ToxicRules, id_col: str, text_col: str) -> tuple[list[str], list[int]]:
    """The training sample: labelled rows outside the held-out fold in hash order, up to the two bounds. A text that is too long
    for what is left of the second is passed over. Of several texts of one id, the longest counts."""
    picked = labels.where(~held_out(F.col(id_col)) & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("_y"))
    picked = materialize(picked.orderBy(F.xxhash64("_id"), "_id").limit(rules.train_rows), "toxic-sample")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # Lengths first, of at most train_rows ids; texts only of those that the second bound lets in.
    sizes = texts.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("_n")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    chosen, left = [], rules.train_chars
    for r in sorted(sizes.groupBy("doc_id", "_y", F.xxhash64("doc_id").alias("_h")).agg(F.max("_n").alias("_n")).collect(), key=lambda r: (r._h, r.doc_id)):
        if r._n <= left:
            chosen.append((r.doc_id, int(r._y > 0), r._n))
            left -= r._n
    if not chosen:
        return [], []
    wanted = docs.sparkSession.createDataFrame(chosen, "_id long, _y int, _n int")
    rows = texts.join(F.broadcast(wanted), (F.col("doc_id") == F.col("_id")) & (F.length(F.coalesce("text", F.lit(""))) == F.col("_n")))
    got = rows.groupBy("doc_id", "_y").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")).toArrow().sort_by("doc_id")
    return got["text"].to_pylist(), got["_y"].to_pylist()


def score(docs: DataFrame, model: Model, rules: ToxicRules, id_col: str, text_col: str) -> DataFrame:
    def make():
        values, bias = model.scores.tolist(), model.bias

        def of(word):
            g = subwords(word, rules)
            return sum(map(values.__getitem__, g)) / len(g)

        memo = WordMemo(lambda words: list(map(of, words)))

        def run(ids, texts):
            for doc_id, text in zip(ids, texts, strict=True):
                words = words_of(text)
                memo.ensure(words)
                x = bias + (sum(map(memo.at, words)) / len(words) if words else 0.0)
                p = 1 / (1 + np.exp(-x)) if x > -500 else 0.0
                yield doc_id, float(p), int(p >= 0.5), len(words)

        return run

    return map_rows(docs.select(id_col, text_col), "doc_id long, score double, predicted int, n_words long", make)


def toxicity(docs: DataFrame, labels: DataFrame, rules: ToxicRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, n_words."""
    rules = rules or ToxicRules()
    model = train(*sample(docs, labels, rules, id_col, text_col), rules)
    scored = score(docs, model, rules, id_col, text_col)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_words")
