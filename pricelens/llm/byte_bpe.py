"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A Python step takes some 16 MB of texts, splits them once into the distinct
pieces of the tokenizer's pattern, and replays the merges over all those
pieces together: an inverted index maps each rank (a mergeable token pair) to
the positions where it stands, the ranks are taken in order, every valid
position of a rank is merged at once, and only the neighbours of a merged
position enter the index again.  Documents are then put together from the
piece results, so that a word costs one merge replay a step however often it
occurs.  Nothing is shuffled.

Defined results: a null or empty text has no ids; ids the vocabulary does not
hold, and a null id list, decode to nothing; other columns pass through, and an
input column named as an output column is replaced; repeated rows give
repeated results.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import offsets, quoted, ragged, steps, texts_of, with_columns, worker_state


#: Bytes of text encoded at a time.
STEP = 6 << 20


class Merges:
    """Ranks of a byte-level vocabulary, and the replay of its merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for t, r in ranks.items():
            tokens[r] = t
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.lens = np.fromiter(map(len, tokens), np.int64, size)
        self.starts = offsets(self.lens)[:-1]
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                left, right = ranks.get(t[:k]), ranks.get(t[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the pair does not merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.pair_rank[at], -1)

    def _one(self, piece: bytes) -> list[int]:
        """Merges of one piece, lowest rank first, leftmost on ties."""
        toks = [bytes([b]) for b in piece]
        while len(toks) > 1:
            best = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(toks, toks[1:])))
            if best[0] == 1 << 60:
                break
            i = best[1]
            toks[i:i + 2] = [toks[i] + toks[i + 1]]
        return [self.ranks[t] for t in toks]

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and the offsets of each."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        word = offsets(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        tok = self.byte_id[data]
        begins = np.zeros(n + 1, bool)
        begins[word] = True
        after = np.arange(1, n + 2)
        after[n] = 1 << 60
        before = np.arange(-1, n)
        alive = np.ones(n + 1, bool)
        odd: list[np.ndarray] = []
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(rank: np.ndarray, pos: np.ndarray) -> None:
            order = np.argsort(rank, kind="stable")
            rank, pos = rank[order], pos[order]
            cut = np.flatnonzero(np.diff(rank)) + 1
            for r, p in zip(rank[np.concatenate([[0], cut])].tolist(), np.split(pos, cut)):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(heap, r)

        if n > 1:
            pos = np.flatnonzero(~begins[1:n])
            rank = self._rank_of(tok[pos], tok[pos + 1])
            if (rank >= 0).any():
                enter(rank[rank >= 0], pos[rank >= 0])
        while heap:
            r = heapq.heappop(heap)
            pos = np.sort(np.concatenate(index.pop(r)))
            pos = pos[np.concatenate([[True], pos[1:] != pos[:-1]])]
            # a pair still stands if its two tokens cover the bytes of the merged one
            pos = pos[alive[pos]]
            right = after[pos]
            ok = right < n
            pos, right = pos[ok], right[ok]
            ok = after[right] == pos + self.lens[r]
            pos, right = pos[ok], right[ok]
            if not len(pos):
                continue
            chained = np.concatenate([[False], right[:-1] == pos[1:]])
            if chained.any():  # a run of one token: every second pair, from the left
                at = np.arange(len(pos))
                ok = (at - np.maximum.accumulate(np.where(chained, 0, at))) % 2 == 0
                pos, right = pos[ok], right[ok]
            end = after[right]
            tok[pos] = r
            alive[right] = False
            after[pos] = end
            before[end] = pos
            lead = before[pos[~begins[pos]]]
            trail = pos[~begins[end]]
            where = np.concatenate([lead, trail])
            if not len(where):
                continue
            rank = self._rank_of(tok[where], tok[after[where]])
            ok = rank >= 0
            if ok.any():
                rank, where = rank[ok], where[ok]
                if (rank < r).any():
                    odd.append(where[rank < r])
                enter(rank, where)
        left = np.flatnonzero(alive[:n])
        ids = tok[left]
        counts = np.diff(np.searchsorted(left, word))
        if odd:  # a merge made a pair of lower rank: such pieces are taken alone
            runs = np.split(ids, np.cumsum(counts)[:-1])
            for w in np.unique(np.searchsorted(word, np.concatenate(odd), "right") - 1).tolist():
                runs[w] = np.array(self._one(pieces[w]), np.int64)
            ids, counts = np.concatenate(runs), np.fromiter(map(len, runs), np.int64, len(runs))
        return ids, offsets(counts)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`replay`; a piece that is a token as a whole is that token."""
        whole = [self.ranks.get(p, -1) for p in pieces]
        known = np.array(whole, np.int64)
        ids, off = self.replay([p for p, w in zip(pieces, whole) if w < 0])
        lens = np.ones(len(pieces), np.int64)
        starts = np.full(len(pieces), len(ids), np.int64) + np.arange(len(pieces))
        merged = known < 0
        lens[merged], starts[merged] = np.diff(off), off[:-1]
        flat = np.concatenate([ids, known])
        return ragged(flat, starts, lens), offsets(lens)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the id lists, one after another, and the offsets of each."""
        ok = (ids >= 0) & (ids < len(self.lens))
        at = np.where(ok, ids, 0)
        lens = np.where(ok, self.lens[at], 0)
        return ragged(self.flat, self.starts[at], lens), offsets(lens)[off]


@lru_cache(maxsize=1)
def load(path: str) -> Merges:
    """The vocabulary of a rank file (base64 token, rank on each line)."""
    with open(path, "rb") as f:
        return Merges({base64.b64decode(t): int(r) for t, r in map(bytes.split, f)})


class Encoder:
    """Encodes texts step by step and keeps the ids of the runs it has met (up
    to about ``KEPT`` bytes, then it starts anew).

    A run is the space before a word and the word up to the next space.  A
    space between two visible characters always begins a match of the pattern,
    so a text may be cut there; a text in which white space stands side by
    side is matched as a whole and its matches are its runs.
    """

    KEPT = 24 << 20
    #: Bytes a run takes beside its characters: two objects, a dictionary slot, an offset.
    RUN = 200

    def __init__(self, merges: Merges, pattern: str):
        self.merges, self.find = merges, regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.spaced: dict[str, int] = {}   # word after a space -> run
        self.plain: dict[str, int] = {}    # run as it stands -> run
        self.ids = np.zeros(0, np.int64)
        self.off = np.zeros(1, np.int64)
        self.size = 0

    def _meet(self, text: str, fresh: list[str]) -> np.ndarray:
        """The runs of a text; new ones join ``fresh``."""
        known, base = self.spaced, len(self.off) - 1
        words = text.split(" ")
        at = list(map(known.get, words))
        if None in at:
            for w in set(words).difference(known):
                if w and not w[0].isspace() and not w[-1].isspace():
                    known[w] = base + len(fresh)
                    fresh.append(" " + w)
                else:
                    known[w] = -1
            at = list(map(known.get, words))
        whole = -1 in at
        for i, run in enumerate(self.find(text) if whole else words[:1]):
            k = self.plain.get(run)
            if k is None:
                k = self.plain[run] = base + len(fresh)
                fresh.append(run)
            if not whole:
                at[0] = k
            elif i < len(at):
                at[i] = k
            else:
                at.append(k)
        if whole:
            del at[i + 1:]
        return np.array(at, np.int64)

    def _learn(self, fresh: list[str]) -> None:
        pieces: dict[str, int] = {}
        found = list(map(self.find, fresh))
        part = np.array([pieces.setdefault(p, len(pieces)) for run in found for p in run], np.int64)
        ids, off = self.merges.encode_pieces([p.encode("utf-8", "replace") for p in pieces])
        lens = np.diff(off)[part]
        self.ids = np.concatenate([self.ids, ragged(ids, off[part], lens)])
        ends = offsets(lens)[np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))]
        self.off = np.concatenate([self.off, self.off[-1] + ends])
        self.size += sum(map(len, fresh)) + self.RUN * len(fresh)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the offsets of each."""
        if self.size > self.KEPT:
            self._forget()
        fresh: list[str] = []
        runs = [self._meet(t, fresh) if t else np.zeros(0, np.int64) for t in texts]
        if fresh:
            self._learn(fresh)
        every = np.concatenate(runs) if runs else np.zeros(0, np.int64)
        lens = np.diff(self.off)[every]
        doc = offsets(np.fromiter(map(len, runs), np.int64, len(runs)))
        return ragged(self.ids, self.off[every], lens), offsets(lens)[doc]


def encoder(ranks_path: str, pattern: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return worker_state(("byte_bpe", ranks_path, pattern), lambda: Encoder(load(ranks_path), pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text_col`` as ``ids_col`` (array of int).

    Only the text goes to Python, a slice of ``STEP`` bytes at a time; all other
    columns stay where they are."""
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = encoder(ranks_path, pattern)
        for texts in batches:
            whole, parts = pa.RecordBatch.from_arrays([texts], names=["text"]), []
            for batch in steps([whole], "text", STEP):
                ids, off = coder.encode(texts_of(batch, "text"))
                parts.append(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    kept = docs.select(*[F.col(quoted(c)) for c in docs.columns if c == text_col or c.lower() != ids_col.lower()])
    return kept.withColumn(ids_col, ids_of(F.col(quoted(text_col))))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids",
               bytes_col: str = "decoded") -> DataFrame:
    """:func:`encode`, then :func:`decode` of its ids, in one Python step."""
    def run(batch: pa.RecordBatch) -> list:
        ids, off = encoder(ranks_path, pattern).encode(texts_of(batch, text_col))
        ids = ids.astype(np.int32)
        data, ends = load(ranks_path).decode(ids, off)
        return [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids)),
                pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])]

    return with_columns(docs, text_col, [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(bytes_col, T.BinaryType())],
                        run, limit=STEP)


def decode(rows: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that ``ids_col`` stands for as ``bytes_col``."""
    def run(batch: pa.RecordBatch) -> list:
        lists = batch.column(batch.schema.get_field_index(ids_col))
        lists = lists.fill_null([]) if lists.null_count else lists
        values = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.diff(lists.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
        data, off = load(ranks_path).decode(values, offsets(counts))
        return [pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])]

    return with_columns(rows, ids_col, [T.StructField(bytes_col, T.BinaryType())], run, limit=4 << 20)
