"""Token counts under a unigram vocabulary, by a Viterbi that only counts.

An Aho-Corasick automaton over the vocabulary enumerates every piece that ends
at each character; dynamic programming carries the best score up to there and
the number of pieces on that path, no back pointers.  Ties go the way of the
tokenizer: of equal scores the piece that begins first stays.  A character no
piece of one character stands for may be unknown, at the least score less ten,
and counts as its UTF-8 bytes (byte fallback).

Text is cut as the metaspace rule does: every space begins a piece of its own
and stands before it as a low line; pieces of the vocabulary never cross it, so
words are counted alone and a step counts each distinct word once.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import texts_of, with_columns, worker_state

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words a worker keeps before it starts anew.
KEPT = 500_000


def vocabulary(model_path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece model, without control, unknown and
    byte pieces."""
    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size())
            if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}


class Counter:
    """Counts pieces of texts; keeps the counts of words it has met."""

    def __init__(self, scores: dict[str, float]):
        # a piece with a space inside could cross words and cannot match
        self.pieces = {p: s for p, s in scores.items() if p and SPACE not in p[1:]}
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.single = frozenset(p for p in self.pieces if len(p) == 1)
        self.automaton = ahocorasick.Automaton()
        for p, s in self.pieces.items():
            self.automaton.add_word(p, (len(p), s))
        if self.pieces:
            self.automaton.make_automaton()
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces on the best path through a word."""
        low = float("-inf")
        best, pieces = [0.0] + [low] * len(word), [0] * (len(word) + 1)
        found = self.automaton.iter(word) if self.pieces else ()
        if self.single.issuperset(word):
            for end, (size, score) in found:  # of one end the longest comes first
                begin = end + 1 - size
                total = best[begin] + score
                if total > best[end + 1]:
                    best[end + 1], pieces[end + 1] = total, pieces[begin] + 1
            return pieces[-1]
        ends: list[list] = [[] for _ in word]
        for end, match in found:
            ends[end].append(match)
        for end, char in enumerate(word):
            for size, score in ends[end]:
                begin = end + 1 - size
                total = best[begin] + score
                if total > best[end + 1]:
                    best[end + 1], pieces[end + 1] = total, pieces[begin] + 1
            if char not in self.single and best[end] + self.unknown > best[end + 1]:
                best[end + 1] = best[end] + self.unknown
                pieces[end + 1] = pieces[end] + len(char.encode("utf-8", "replace"))
        return pieces[-1]

    def text(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if not words[0]:  # the leading space stands before the next word already
            words = words[1:]
        counts = list(map(self.known.get, words))
        if None in counts:
            if len(self.known) > KEPT:
                self.known.clear()
            for w in set(words).difference(self.known):
                self.known[w] = self.count(SPACE + w)
            counts = map(self.known.__getitem__, words)
        return sum(counts)


def counter(model_path: str) -> Counter:
    return worker_state(("unigram", model_path), lambda: Counter(vocabulary(model_path)))


def token_counts(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of pieces of ``text_col``; null and empty texts
    have none.  Other columns pass through, one named ``out_col`` is replaced."""
    def run(batch: pa.RecordBatch) -> list:
        c = counter(model_path)
        return [pa.array(np.array([c.text(t) for t in texts_of(batch, text_col)], np.int64))]

    return with_columns(docs, text_col, [T.StructField(out_col, T.LongType())], run)
