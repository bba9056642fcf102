"""Token counts by a linear longest-match automaton (operator 10).

The vocabulary is a trie; every trie node has a failure link and the number of pieces that following the link pops.
Greedy longest-match piece counts then need one pass over a word's characters, with no piece ever built and no
character read twice.

Words are runs of characters other than ASCII white space, marked at their start. A character that is no piece by itself
counts as its UTF-8 bytes (byte fallback), so every word has a count. Null or empty text: zero words, zero tokens.
Repeated rows are counted row by row; extra columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import WORD, WordMemo, map_rows, tokenizer_path


class PieceAutomaton:
    """Trie over ``pieces`` with failure links and popped-piece counts.

    ``weight`` of a piece is 1; of a single character of the alphabet that is no piece, its number of UTF-8 bytes.
    """

    def __init__(self, pieces: Iterable[str]):
        pieces = {p for p in pieces if p}
        self.next: list[dict[str, int]] = [{}]
        weight: list[int] = [0]
        for p in pieces:
            at = 0
            for ch in p:
                to = self.next[at].get(ch)
                if to is None:
                    to = self.next[at][ch] = len(self.next)
                    self.next.append({})
                    weight.append(0)
                at = to
            weight[at] = 1
        alphabet = {ch for p in pieces for ch in p}
        for ch in alphabet:
            to = self.next[0].get(ch)
            if to is None:
                to = self.next[0][ch] = len(self.next)
                self.next.append({})
                weight.append(0)
            weight[to] = weight[to] or len(ch.encode())
        self.fail = [0] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque((0, ch, v) for ch, v in self.next[0].items())
        while queue:
            parent, ch, v = queue.popleft()
            if weight[v]:
                # The whole path is a piece: leaving it pops just that piece.
                self.fail[v], self.popped[v] = 0, weight[v]
            else:
                # The path is cut where its parent's longest match ends, and read on from there.
                at, count = self.fail[parent], self.popped[parent]
                while ch not in self.next[at]:
                    at, count = self.fail[at], count + self.popped[at]
                self.fail[v], self.popped[v] = self.next[at][ch], count
            queue.extend((v, c, w) for c, w in self.next[v].items())

    def count(self, word: str) -> tuple[int, int]:
        """Greedy pieces of ``word`` and, of them, bytes of characters outside the vocabulary's alphabet."""
        nxt, fail, popped = self.next, self.fail, self.popped
        at = total = unknown = 0
        for ch in word:
            to = nxt[at].get(ch)
            while to is None and at:
                total += popped[at]
                at = fail[at]
                to = nxt[at].get(ch)
            if to is None:
                unknown += len(ch.encode("utf-8", "surrogatepass"))
            else:
                at = to
        while at:
            total += popped[at]
            at = fail[at]
        return total + unknown, unknown


@dataclass(frozen=True)
class CountRules:
    vocabulary: str = "piece_bpe_32k.model"
    folder: str | None = None
    word_start: str = "▁"


def pieces_of(rules: CountRules) -> list[str]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(rules.vocabulary, rules.folder))
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


SCHEMA = "doc_id long, n_chars long, n_words long, n_tokens long, n_byte_tokens long"


def token_counts(docs: DataFrame, rules: CountRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: characters, words, greedy tokens and byte-fallback tokens of the whole text."""
    rules = rules or CountRules()

    def make():
        automaton = PieceAutomaton(pieces_of(rules))
        memo = WordMemo(lambda words: [automaton.count(rules.word_start + w) for w in words])

        def count(doc_id, text):
            text = text or ""
            words = WORD.findall(text)
            memo.ensure(words)
            found = list(map(memo.at, words))
            return doc_id, len(text), len(words), sum(t for t, _ in found), sum(b for _, b in found)

        return lambda ids, texts: map(count, ids, texts)

    return map_rows(docs.select(id_col, text_col), SCHEMA, make)
