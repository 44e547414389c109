"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with a smallest period ``q`` that no neighbouring
word extends; runs of at least ``exponent`` periods (and ``least`` words) are
found.  A step of texts is one sequence of word numbers, the same word in two
texts having two numbers.  Prefix doubling sorts its suffixes and gives, on the
way, each dyadic block's interval of the suffix array.  For a block of 2**k
words a wavelet matrix over the suffix array answers the block's next and last
occurrence (range successor and predecessor).  Occurrences of a block in the
window of its own length on either side are an arithmetic progression, whose
step is a candidate period ``q`` with 2**(k-1) <= q < 2**k; every run of four
periods holds an aligned block of its level whose next or last occurrence lies
``q`` words away.  Candidates are extended both ways to the whole run.

Nothing is shuffled; a text is worked on whole, by one task.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import offsets, texts_of, with_columns, worker_state

#: Bytes of text sorted at a time.
STEP = 4 << 20


class Wavelet:
    """Wavelet matrix over distinct numbers 0..n-1; queries come as arrays."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros, self.ranks = [], []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b & 1).astype(bool)
            rank0 = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~one, out=rank0[1:])
            self.ranks.append(rank0)
            self.zeros.append(int(rank0[-1]))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the places lo..hi-1 hold a number below ``x``."""
        count = np.zeros(len(x), np.int64)
        for level, (rank0, zeros) in enumerate(zip(self.ranks, self.zeros)):
            one = (x >> (self.bits - 1 - level) & 1).astype(bool)
            lo0, hi0 = rank0[lo], rank0[hi]
            count += np.where(one, hi0 - lo0, 0)
            lo = np.where(one, zeros + lo - lo0, lo0)
            hi = np.where(one, zeros + hi - hi0, hi0)
        return count

    def ascending(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest number, from 0, of the places lo..hi-1."""
        out = np.zeros(len(k), np.int64)
        for rank0, zeros in zip(self.ranks, self.zeros):
            lo0, hi0 = rank0[lo], rank0[hi]
            one = k >= hi0 - lo0
            k = np.where(one, k - (hi0 - lo0), k)
            out = out << 1 | one
            lo = np.where(one, zeros + lo - lo0, lo0)
            hi = np.where(one, zeros + hi - hi0, hi0)
        return out


def _intervals(codes: np.ndarray):
    """Suffix array of ``codes`` by prefix doubling, and for each level k >= 1
    ``(k, starts, lo, hi)``: the aligned blocks of 2**k words that occur more
    than once, and their intervals of the suffix array.  A suffix that is alone
    in its class keeps its rank and is not sorted again."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(codes[order]) != 0]))
    size = np.diff(np.concatenate([first, [n]]))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, size)
    active, levels, k = order[np.repeat(size, size) > 1], [], 0
    while len(active):
        after = active + (1 << k)
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((second, rank[active]))
        active, second = active[by], second[by]
        old = rank[active]
        m = len(active)
        parted = np.concatenate([[True], np.diff(old) != 0])
        first = np.flatnonzero(parted | np.concatenate([[True], np.diff(second) != 0]))
        class_of_old = np.maximum.accumulate(np.where(parted, np.arange(m), 0))
        size = np.diff(np.concatenate([first, [m]]))
        rank[active] = old + np.repeat(first - class_of_old[first], size)
        size = np.repeat(size, size)
        active, size, k = active[size > 1], size[size > 1], k + 1
        aligned = active & ((1 << k) - 1) == 0
        starts = active[aligned]
        levels.append((k, starts, rank[starts], rank[starts] + size[aligned], active))
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes, levels


def _candidates(codes: np.ndarray) -> dict[int, np.ndarray]:
    """Candidate periods, each with ascending places from which words equal
    those one period further on."""
    suffixes, levels = _intervals(codes)
    out: dict[int, list[np.ndarray]] = {}
    if not levels or not len(levels[0][4]):
        return {}
    # only suffixes whose first two words come again are of interest
    shared = np.zeros(len(codes), bool)
    shared[levels[0][4]] = True
    places = np.flatnonzero(shared)                # ascending positions: number -> position
    kept = shared[suffixes]
    tree = Wavelet(np.searchsorted(places, suffixes[kept]))
    at = offsets(kept)                             # place of the suffix array -> place in the tree
    for k, starts, lo, hi, _ in levels:
        if not len(starts):
            continue
        lo, hi = at[lo], at[hi]
        upto = tree.below(lo, hi, np.searchsorted(places, starts))  # occurrences before the block
        for has, nth, back in ((upto + 1 < hi - lo, upto + 1, False), (upto > 0, upto - 1, True)):
            s = starts[has]
            if not len(s):
                continue
            met = places[tree.ascending(lo[has], hi[has], nth[has])]
            near, base = (s - met, met) if back else (met - s, s)
            ok = (near >= 1 << (k - 1)) & (near < 1 << k)
            near, base = near[ok], base[ok]
            if len(near):
                by = np.lexsort((base, near))
                near, base = near[by], base[by]
                cut = np.flatnonzero(np.diff(near)) + 1
                for q, b in zip(near[np.concatenate([[0], cut])].tolist(), np.split(base, cut)):
                    out.setdefault(q, []).append(b)
    return {q: np.unique(np.concatenate(b)) for q, b in out.items()}


def _agree(codes: np.ndarray, i: int, q: int, step: int) -> int:
    """How many words from ``i`` on (``step`` 1) or before it (-1) equal those
    ``q`` words further on."""
    total, width = 0, 32
    while True:
        if step > 0:
            lo, hi = i + total, min(i + total + width, len(codes) - q)
        else:
            lo, hi = max(i - total - width, 0), i - total
        if hi <= lo:
            return total
        odd = np.flatnonzero(codes[lo:hi] != codes[lo + q:hi + q])
        if len(odd):
            return total + (int(odd[0]) if step > 0 else hi - lo - 1 - int(odd[-1]))
        total, width = total + hi - lo, width * 2


def find_runs(codes: np.ndarray, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of a sequence of numbers, by
    start, then period; ``exponent`` is 4 at least."""
    out = []
    if len(codes) < 2:
        return out
    for q, bases in _candidates(codes).items():
        i = 0
        while i < len(bases):
            at = int(bases[i])
            start = at - _agree(codes, at, q, -1)
            length = at - start + _agree(codes, at, q, 1) + q
            if length >= max(least, exponent * q):
                out.append((start, length, q))
            i = max(i + 1, int(np.searchsorted(bases, start + length - q)))  # the rest of this stretch is known
    return sorted(set(out))


class Finder:
    """Runs of a step of texts at once."""

    def __init__(self, least: int, exponent: int):
        if exponent < 4:
            raise ValueError("exponent must be 4 at least")
        self.least, self.exponent = least, exponent

    def find(self, texts: list[str]) -> list[tuple[int, list[tuple[int, int, int]], str]]:
        """For each text its number of words, its runs, and the words that are
        left when of every run only the first period stays."""
        words = [t.encode("utf-8", "replace").split() for t in texts]  # bytes: cuts at 0x20 and 0x09-0x0D only
        lens = np.fromiter(map(len, words), np.int64, len(words))
        known: dict[bytes, int] = {}
        for w in words:
            for x in set(w).difference(known):
                known[x] = len(known)
        width = len(known) + 1  # one number more a text: an end that equals nothing
        codes = np.empty(int(lens.sum()) + len(words), np.int64)
        begin = offsets(lens + 1)
        for d, w in enumerate(words):
            lo = int(begin[d])
            codes[lo:lo + len(w)] = np.fromiter(map(known.__getitem__, w), np.int64, len(w))
            codes[lo + len(w)] = width - 1
            codes[lo:lo + len(w) + 1] += d * width
        runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
        for start, length, q in find_runs(codes, self.least, self.exponent):
            d = int(np.searchsorted(begin, start, "right")) - 1
            runs[d].append((start - int(begin[d]), length, q))
        out = []
        for w, r in zip(words, runs):
            if r:
                stays = np.ones(len(w), bool)
                for start, length, q in r:
                    stays[start + q:start + length] = False
                w_left = [x for x, s in zip(w, stays.tolist()) if s]
            else:
                w_left = w
            out.append((len(w), r, b" ".join(w_left).decode()))
        return out


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("best", _RUN),
          T.StructField("collapsed", T.StringType())]


def runs(docs: DataFrame, text_col: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (every run's ``start`` (word number),
    ``length`` and ``period``, by start, then period), ``best`` (the run with
    the greatest length in periods; of equal ones the first, then that of the
    smaller period; null without a run) and ``collapsed`` (the words no run
    holds after its first period, joined by one space).

    Words are cut at spaces and the control characters tab to carriage return.
    Null and empty texts have no words, no run and the empty text; repeated rows
    give repeated results; texts of any length are taken whole; input columns
    named as a result are replaced; an empty table gives an empty result.
    """
    def run(batch: pa.RecordBatch) -> list:
        finder = worker_state(("periodic", least, exponent), lambda: Finder(least, exponent))
        found = finder.find(texts_of(batch, text_col))

        def named(r):
            return {"start": r[0], "length": r[1], "period": r[2]}

        return [[n for n, _, _ in found], [[named(x) for x in r] for _, r, _ in found],
                [named(max(r, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]))) if r else None for _, r, _ in found], [c for _, _, c in found]]

    return with_columns(docs, text_col, _FOUND, run, limit=STEP)
