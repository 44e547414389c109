"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the ``anchor``-word hashes in every window of
``min_words`` words the least (the last of equal ones) is chosen, so a run of
``min_words`` words that two documents share holds an anchor chosen in both.
Documents meet on equal anchors and their matches are extended both ways:

1. An anchor is extended to its span, the union of the windows that chose it.
   Rows meet on the anchor; a row whose span also stands in a document with a
   smaller id is covered as a whole.
2. Where the spans under one anchor differ, a match ends somewhere inside.
   Those rows that are not covered are extended window by window, and a window
   meets its like under a 128-bit hash.

The covered windows of a document, put together, are its maximal repeats of at
least ``min_words`` words.  No pairs of documents are made: a group only needs
its smallest id.  Copies that meet inside one step of a task are settled there
and are not shuffled; an anchor with many spans in one step is passed on to the
second extension directly, with one row that tells its group so.  Either way a
passage that a third of all documents hold sends a few rows a step to its
group, whatever its number of documents.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import offsets, steps, texts_of, worker_state

STEP = 8 << 20
#: Rows of one anchor in a step above which they skip the first extension.
CROWDED = 16
GROUPED, COVERED, OPEN, BEACON = 0, 1, 2, 3

_C1, _C2, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: ``at`` packs the first window, the number of windows and the kind of a row
#: (see _pack), which costs half the bytes of three columns in a shuffle.
_SEED_SCHEMA = "key long, tail long, doc long, th long, at long"
_SEED_NAMES = ["key", "tail", "doc", "th", "at"]


def _pack(pos: np.ndarray, m: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return ((pos.astype(np.int64) << 8 | m) << 2) | kind


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX


def _word_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and the offsets."""
    h = xxhash.xxh3_64_intdigest
    parts = []
    for d in data:
        words = d.split()  # bytes: cuts at 0x20 and 0x09-0x0D only
        parts.append(np.fromiter(map(h, words), np.uint64, len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64),
            offsets(np.fromiter(map(len, parts), np.int64, len(parts))))


class _Spans:
    """Polynomial hashes of any word range in constant time."""

    def __init__(self, words: np.ndarray, base: np.uint64):
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        n = len(words)
        self.inv = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]), dtype=np.uint64)
        self.sum = np.concatenate([[np.uint64(0)], np.cumsum(words * power[:n], dtype=np.uint64)])

    def hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((self.sum[hi] - self.sum[lo]) * self.inv[lo] + (hi - lo).astype(np.uint64) * _MIX)


def _seeds(words: np.ndarray, off: np.ndarray, min_words: int, anchor: int) -> tuple:
    """(first window, windows, document, anchor hash, span hash) of each seed."""
    n, empty = len(words), np.zeros(0, np.int64)
    if n < min_words:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    spans = _Spans(words, _C1)
    at = np.arange(n - anchor + 1)
    gram = spans.hash(at, at + anchor)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    starts = np.arange(n - min_words + 1)
    starts = starts[doc[starts] == doc[starts + min_words - 1]]
    best, chosen = gram[starts], starts.copy()
    for k in range(1, min_words - anchor + 1):
        g = gram[starts + k]
        take = g <= best
        best[take] = g[take]
        chosen[take] = starts[take] + k
    if not len(starts):
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    # windows of one document that chose the same anchor stand side by side
    first = np.flatnonzero(np.concatenate([[True], (np.diff(chosen) != 0) | (np.diff(doc[starts]) != 0)]))
    m = np.diff(np.concatenate([first, [len(starts)]]))
    lo = starts[first]
    return lo, m, doc[lo], best[first], spans.hash(lo, lo + m - 1 + min_words)


def _settled(key: np.ndarray, tail: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by (key, tail, doc), and which rows in that order have
    the same key and tail as a row with a smaller document."""
    order = np.lexsort((doc, tail, key))
    k, t, d = key[order], tail[order], doc[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])])
    least = d[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
    return order, d > least


def _as_read(order: np.ndarray, cols: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted columns back in the order of the texts: rows of one document then
    follow each other in every shuffle block, which compresses their equal parts."""
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return [c[back] for c in cols]


def _seed_rows(id_col: str, text_col: str, min_words: int, anchor: int):
    def run(batches):
        worker_state("repeats", object)  # keeps nothing, and lets go what others kept
        for batch in steps(batches, text_col, STEP):
            data = [t.encode("utf-8", "replace") for t in texts_of(batch, text_col)]
            ids = batch.column(batch.schema.get_field_index(id_col)).to_numpy(zero_copy_only=False).astype(np.int64)
            ths = np.fromiter((xxhash.xxh64_intdigest(d, 42) for d in data), np.uint64, len(data)).view(np.int64)
            words, off = _word_hashes(data)
            lo, m, row, key, tail = _seeds(words, off, min_words, anchor)
            if not len(lo):
                continue
            order, covered = _settled(key, tail, ids[row])
            lo, m, row, key, tail = lo[order], m[order], row[order], key[order], tail[order]
            pos = lo - off[row]
            # rows left of each anchor; a crowded anchor goes on to the second extension
            new = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.cumsum(new) - 1
            crowded = np.bincount(group, ~covered)[group] > CROWDED
            kind = np.where(covered, COVERED, np.where(crowded, OPEN, GROUPED))
            spread = _mix(tail ^ (pos.astype(np.uint64) * _C2) ^ ids[row].view(np.uint64))
            doc, th = ids[row], ths[row]
            beacon = new & crowded
            cols = [np.where(kind == GROUPED, key, spread).view(np.int64), tail.view(np.int64), doc, th, _pack(pos, m, kind)]
            cols = _as_read(order, cols)
            lamps = [c[beacon] for c in (key.view(np.int64), tail.view(np.int64), doc, th, _pack(pos, m, np.full(len(m), BEACON)))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(cols, lamps)], names=_SEED_NAMES)
    return run


def _by_group(batches, settle):
    """Calls ``settle`` on tables of whole groups of rows sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        key = batch.column("key").to_numpy()
        if held[0].column("key")[0].as_py() == key[-1]:
            continue
        cut = int(np.searchsorted(key, key[-1]))
        done = pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
        held = [batch.slice(cut)]
        yield settle(done)
    if held:
        yield settle(pa.Table.from_batches(held))


def _extend(batches):
    """First extension, over rows sorted by (key, tail, doc)."""
    def settle(table: pa.Table) -> pa.RecordBatch:
        key, tail, doc, packed = (table.column(c).to_numpy() for c in ("key", "tail", "doc", "at"))
        kind = packed & 3
        grouped = kind == GROUPED
        at = np.arange(len(key))
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        new_tail = new_key | np.concatenate([[True], tail[1:] != tail[:-1]])
        # beacons and passed rows are no witnesses of a span
        least = np.full(int(new_tail.sum()), np.iinfo(np.int64).max)
        of_tail = np.cumsum(new_tail) - 1
        np.minimum.at(least, of_tail[grouped], doc[grouped])
        covered = grouped & (doc > least[of_tail])
        group = np.cumsum(new_key) - 1
        first = at[new_key]
        low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
        tails = np.bincount(group, new_tail)
        lit = np.bincount(group, kind == BEACON) > 0
        differs = (lit | ((low < high) & (tails > 1)))[group]
        covered |= kind == COVERED
        keep = covered | (kind == OPEN) | (grouped & differs)
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (doc, table.column("th").to_numpy(), packed >> 2, covered)],
                                          names=["doc", "th", "run", "covered"])

    yield from _by_group(batches, settle)


def _window_rows(id_col: str, text_col: str, min_words: int):
    """Second extension: the windows of each open seed."""
    def run(batches):
        worker_state("repeats", object)  # keeps nothing, and lets go what others kept
        for batch in steps(batches, text_col, STEP):
            data = [t.encode("utf-8", "replace") for t in texts_of(batch, text_col)]
            ids = batch.column(batch.schema.get_field_index(id_col)).to_numpy(zero_copy_only=False).astype(np.int64)
            ths = batch.column(batch.schema.get_field_index("__th")).to_numpy()
            lists = batch.column(batch.schema.get_field_index("__open"))
            packed = lists.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(data)), np.diff(lists.offsets.to_numpy()))
            words, off = _word_hashes(data)
            m = packed % 256
            row, lo = np.repeat(row, m), np.repeat(packed // 256, m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            at = off[row] + lo
            key, tail = (_Spans(words, c).hash(at, at + min_words) for c in (_C1, _C2))
            order, covered = _settled(key, tail, ids[row])
            row, lo, key, tail = row[order], lo[order], key[order], tail[order]
            spread = _mix(tail ^ (lo.astype(np.uint64) * _C2) ^ ids[row].view(np.uint64))
            cols = _as_read(order, [np.where(covered, spread, key).view(np.int64), tail.view(np.int64), ids[row], ths[row],
                                    _pack(lo, np.ones(len(lo), np.int64), np.where(covered, COVERED, GROUPED))])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=_SEED_NAMES)
    return run


def _meet_windows(batches):
    def settle(table: pa.Table) -> pa.RecordBatch:
        key, tail, doc, packed = (table.column(c).to_numpy() for c in ("key", "tail", "doc", "at"))
        kind = packed & 3
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (tail[1:] != tail[:-1])])
        of = np.cumsum(new) - 1
        least = np.full(int(new.sum()), np.iinfo(np.int64).max)
        grouped = kind == GROUPED
        np.minimum.at(least, of[grouped], doc[grouped])
        covered = (kind == COVERED) | (grouped & (doc > least[of]))
        return pa.RecordBatch.from_arrays([pa.array(c[covered]) for c in (doc, table.column("th").to_numpy(), packed >> 10)],
                                          names=["doc", "th", "pos"])

    yield from _by_group(batches, settle)


def _cut(id_col: str, text_col: str, min_words: int, keep_layout: bool, passed: list[str], names: list[str]):
    """Takes the covered words out of the texts."""
    def run(batches):
        worker_state("repeats", object)
        for batch in steps(batches, text_col, STEP):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            covered = batch.column(batch.schema.get_field_index("__covered")).to_pylist()
            windows = batch.column(batch.schema.get_field_index("__windows")).to_pylist()
            n_words, n_removed, kept, spans = [], [], [], []
            for text, runs, single in zip(texts, covered, windows):
                data = (text or "").encode("utf-8", "replace")
                words = data.split()
                n_words.append(len(words))
                if not runs and not single:
                    n_removed.append(0)
                    kept.append((text or "") if keep_layout else b" ".join(words).decode())
                    spans.append([])
                    continue
                runs = np.array(runs or [], np.int64)
                single = np.array(single or [], np.int64)
                lo = np.concatenate([runs // 256, single])
                hi = np.concatenate([runs // 256 + runs % 256 - 1, single]) + min_words
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, lo, 1)
                np.add.at(edge, hi, -1)
                gone = np.concatenate([np.cumsum(edge)[:-1] > 0, [False]])
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)))
                spans.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(turn[::2], turn[1::2])])
                n_removed.append(int(gone.sum()))
                if keep_layout:  # a word goes with the white space after it
                    begin = [w.start() for w in _WORD.finditer(data)] + [len(data)]
                    out, at = [], 0
                    for a, b in zip(turn[::2].tolist(), turn[1::2].tolist()):
                        out.append(data[at:begin[a]])
                        at = begin[b]
                    kept.append(b"".join([*out, data[at:]]).decode())
                else:
                    kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode())
            arr = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()),
                   pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in passed]
            yield pa.RecordBatch.from_arrays(cols + arr, names=names)
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 13, anchor: int = 5,
                   keep_layout: bool = False) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``kept`` (the text without its
    repeats) and ``repeats`` (the removed word ranges, first and last).

    A repeat is a run of at least ``min_words`` words each window of which also
    stands in a document with a smaller id.  ``kept`` joins the words left by
    one space; with ``keep_layout`` the text left keeps its white space.

    Null and empty texts have no words.  Rows with a null id neither lose words
    nor take any from others; rows that share an id are not compared with each
    other; repeated rows give repeated results.  Other columns pass through,
    those named as an output column are replaced.
    """
    if not 1 <= anchor <= min_words:
        raise ValueError("anchor must lie between 1 and min_words")
    if min_words > 128:
        raise ValueError("min_words above 128 is not supported")
    made = ["n_words", "n_removed", "kept", "repeats"]
    passed = [c for c in docs.columns if c in (id_col, text_col) or c.lower() not in made]
    docs = docs.select(*passed).withColumn("__th", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    keyed = docs.where(F.col(id_col).isNotNull())

    seeds = keyed.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(
        _seed_rows(id_col, text_col, min_words, anchor), _SEED_SCHEMA)
    met = (seeds.repartition("key").sortWithinPartitions("key", "tail", "doc")
           .mapInArrow(_extend, "doc long, th long, run long, covered boolean"))
    marks = materialize(met.groupBy("doc", "th").agg(F.collect_list(F.when(F.col("covered"), F.col("run"))).alias("__covered"),
                                                     F.collect_list(F.when(~F.col("covered"), F.col("run"))).alias("__open")))

    def marked(side: DataFrame, how: str) -> DataFrame:
        side = side.withColumnsRenamed({"doc": "__doc", "th": "__text"})
        return keyed.join(side, (keyed[id_col] == side["__doc"]) & (keyed["__th"] == side["__text"]), how).drop("__doc", "__text")

    windows = marked(marks.where(F.size("__open") > 0).select("doc", "th", "__open"), "inner").select(
        F.col(id_col).cast("long").alias(id_col), text_col, "__th", "__open").mapInArrow(_window_rows(id_col, text_col, min_words), _SEED_SCHEMA)
    found = (windows.repartition("key").sortWithinPartitions("key", "tail", "doc")
             .mapInArrow(_meet_windows, "doc long, th long, pos long")
             .groupBy("doc", "th").agg(F.collect_list("pos").alias("__windows")))
    both = marks.select("doc", "th", "__covered").join(found, ["doc", "th"], "left")
    ready = marked(both, "left").unionByName(docs.where(F.col(id_col).isNull()).withColumns(
        {c: F.lit(None).cast("array<long>") for c in ("__covered", "__windows")}))
    schema = T.StructType([docs.schema[c] for c in passed] + [
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()),
        T.StructField("repeats", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])))])
    return ready.mapInArrow(_cut(id_col, text_col, min_words, keep_layout, passed, passed + made), schema)
