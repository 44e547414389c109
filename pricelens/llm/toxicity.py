"""Toxicity by compression distance.

Two zstandard dictionaries share a part trained on windows of ordinary text.
Each has a part of its own trained on windows of its class, and the toxic one
also lists what marks the toxic training texts: words and runs of two and three
words that stand in more of them than in ordinary ones (see ``_marks``).  A
window (a word, or eight, before a fixed carrier text, since zstandard looks for
no match in the last bytes of its input) is compressed under both.  The bytes the
toxic dictionary saves are its distance.  For both kinds of windows thresholds
come from the distances of ordinary windows, and a logistic function over the
windows beyond them, fitted on the training texts, turns a whole text into a
score between 0 and 1.

The fit reads a bounded sample (``sample_docs`` distinct texts and
``sample_bytes`` of each class, by the order of their hash, so independent of
the partitioning); every document is scored, whole.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts_of, with_columns, worker_state

_PARAMS = dict(window_log=18, hash_log=17, chain_log=17, search_log=6, min_match=4, target_length=64,
               strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
#: Window distances a worker keeps before it starts anew.
KEPT = 250_000
#: One ordinary window in so many lies beyond each threshold.
QUANTILES = (300, 3_000, 30_000, 300_000)


@dataclass(frozen=True)
class Model:
    ordinary: bytes            # dictionary contents
    toxic: bytes
    carrier: bytes
    window_words: tuple        # words of a window, for each kind of windows
    thresholds: tuple          # of each kind: savings that one ordinary window in QUANTILES exceeds
    centre: tuple              # of each feature
    scale: tuple
    weights: tuple             # of each feature, then the constant

    def key(self) -> str:
        return hashlib.md5(repr(self).encode()).hexdigest()


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(**_PARAMS)
    shared = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    shared.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=shared, compression_params=params)


class Meter:
    """Distances of windows under a pair of dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes, carrier: bytes, window_words: tuple):
        self.plain, self.marked = _compressor(ordinary).compress, _compressor(toxic).compress
        self.carrier, self.sizes = b" " + carrier, window_words
        self.known: dict[bytes, int] = {}

    def _saved(self, window: bytes) -> int:
        x = b" " + window + self.carrier
        return len(self.plain(x)) - len(self.marked(x))

    def distances(self, text: str) -> list[np.ndarray]:
        words = text.lower().encode("utf-8", "replace").split()
        return [self._words(words) if n == 1 else np.array([self._saved(b" ".join(words[i:i + n])) for i in range(0, len(words), n)], np.int64)
                for n in self.sizes]

    def _words(self, words: list[bytes]) -> np.ndarray:
        out = list(map(self.known.get, words))
        if None in out:
            if len(self.known) > KEPT:
                self.known.clear()
            for w in set(words).difference(self.known):
                self.known[w] = self._saved(w)
            out = list(map(self.known.__getitem__, words))
        return np.array(out, np.int64)


def _features(distances: list[np.ndarray], thresholds) -> list[float]:
    out = []
    for d, limits in zip(distances, thresholds):
        out += [*(math.log1p(int((d > t).sum())) for t in limits), float(max(d.max(), 0)) if len(d) else 0.0, math.log1p(len(d))]
    return out


def _scores(x: np.ndarray, model: Model) -> np.ndarray:
    z = (x - np.array(model.centre)) / np.array(model.scale)
    z = z @ np.array(model.weights[:-1]) + model.weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _meter(model: Model) -> Meter:
    return worker_state(("toxicity", model.key()), lambda: Meter(model.ordinary, model.toxic, model.carrier, model.window_words))


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic function by Newton steps, the constant last; ``share`` weighs the rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (share * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _runs(texts: list[str], words: int = 8, most: int = 100_000) -> list[bytes]:
    """Windows of ``words`` words to train a dictionary on: all up to twice
    ``most``, of more every k-th, so that about ``most`` remain."""
    out = []
    for t in texts:
        w = t.lower().encode("utf-8", "replace").split()
        out += [b" " + b" ".join(w[i:i + words]) + b" " for i in range(0, len(w), words)]
    return out[::max(1, len(out) // most)]


def _dictionary(runs: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, runs, k=64, d=6, f=20, accel=1, split_point=1.0).as_bytes()
    except zstandard.ZstdError:  # too few texts to train on: their windows are the dictionary
        return b"".join(runs)[-size:]


def _marks(toxic: list[str], ordinary: list[str], words: int, min_share: float = 0.015, min_ratio: float = 20.0,
           least: float = 15.0) -> list[tuple[int, bytes]]:
    """Runs of ``words`` words that are ``min_ratio`` times rarer in ordinary
    texts, with the number of toxic texts they stand in.  That number is two at
    least, and too large for chance (a log-likelihood ratio of ``least``); a
    single word may stand in ``min_share`` of the toxic texts instead."""
    number: dict[bytes, int] = {}

    def keys(t: str) -> tuple[np.ndarray, list[bytes]]:
        w = t.lower().encode("utf-8", "replace").split()
        ids = np.array([number.setdefault(x, len(number)) for x in w], np.uint64)
        out = np.zeros(max(0, len(w) - words + 1), np.uint64)
        for k in range(words):
            out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + len(out)] + np.uint64(1)
        return out, w

    def documents(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([np.unique(keys(t)[0]) for t in texts]), return_counts=True)

    (key, n), (other, m) = documents(toxic), documents(ordinary)
    key, n = key[n > 1], n[n > 1]
    if not len(key):
        return []
    at = np.minimum(np.searchsorted(other, key), len(other) - 1)
    m = np.where(other[at] == key, m[at], 0) if len(other) else np.zeros(len(key), np.int64)
    share = len(toxic) / (len(toxic) + len(ordinary))
    part = n / (n + m)
    ratio = 2 * (n * np.log(part / share) + m * np.log(np.maximum(1 - part, 1e-300) / (1 - share)))
    often = (part > share) & (ratio >= least)
    if words == 1:
        often |= n >= min_share * len(toxic)
    good = often & ((n + 0.5) / len(toxic) >= min_ratio * (m + 0.5) / len(ordinary))
    wanted = dict(zip(key[good].tolist(), n[good].tolist()))
    found = {}
    for t in toxic:
        if len(found) == len(wanted):
            break
        k, w = keys(t)
        for i in np.flatnonzero(np.isin(k, key[good])):
            found.setdefault(int(k[i]), b" ".join(w[i:i + words]))
    return [(wanted[k], w) for k, w in found.items()]


def train(toxic: list[str], ordinary: list[str], window_words: tuple = (1, 8), base_bytes: int = 16384, own_bytes: int = 4096) -> Model:
    """Dictionaries, thresholds and weights from two lists of texts.

    The list of marks holds ``4 * base_bytes`` at most, those of most texts.
    Without texts of both classes nothing marks toxic text: the model then
    scores every text 0 (no toxic text was seen) or 1 (no ordinary one).
    """
    kinds, n_features = len(window_words), len(window_words) * (len(QUANTILES) + 2)
    if not toxic or not ordinary:
        return Model(b"", b"", b"", window_words, ((0,) * len(QUANTILES),) * kinds, (0.0,) * n_features, (1.0,) * n_features,
                     (0.0,) * n_features + (30.0 if toxic else -30.0,))
    runs = _runs(ordinary)
    carrier = max(runs, key=len, default=b" ")[:24]
    marks = sorted(x for words in (1, 2, 3) for x in _marks(toxic, ordinary, words))
    listed = (b" " + b" ".join(w for _, w in marks) + b" ")[-4 * base_bytes:]
    base = _dictionary(runs, base_bytes) + carrier
    plain, marked = _dictionary(runs[1::2], own_bytes) + base, _dictionary(_runs(toxic), own_bytes) + base + listed
    meter = Meter(plain, marked, carrier, window_words)
    seen = [[meter.distances(t) for t in texts] for texts in (toxic, ordinary)]
    thresholds = []
    for k in range(kinds):
        d = np.sort(np.concatenate([np.zeros(1, np.int64), *(x[k] for x in seen[1])]))
        thresholds.append(tuple(int(d[min(len(d) - 1, int(len(d) * (1 - 1 / q)))]) for q in QUANTILES))
    x = np.array([_features(d, thresholds) for part in seen for d in part])
    y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    centre, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    w = _logistic((x - centre) / scale, y, np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) ** 0.5)
    return Model(plain, marked, carrier, window_words, tuple(thresholds), tuple(centre.tolist()), tuple(scale.tolist()), tuple(w.tolist()))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
           sample_docs: int = 4000, sample_bytes: int = 24 << 20) -> tuple[list[str], list[str]]:
    """Toxic and ordinary training texts: distinct texts by the order of their
    hash, ``sample_docs`` and ``sample_bytes`` of each class at most; a text that
    would pass the bytes left is passed over.  A class whose texts are all longer
    than that is learned from its shortest one.  A text is toxic if any of its rows
    is labelled so; rows without a label take no part."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    label = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).alias("label"))
    rows = docs.select(id_col, F.xxhash64(text).alias("h"), F.octet_length(text).alias("size"))
    texts = (rows.join(label, rows[id_col] == label["label_id"]).groupBy("h")
             .agg(F.max("label").alias("label"), F.max("size").alias("size")).where("size > 0"))
    wanted, kinds = [], {}
    for kind, of in ((1, F.col("label") > 0), (0, F.col("label") <= 0)):
        total, rows_of = 0, texts.where(of).select("h", "size")
        found = rows_of.where(F.col("size") <= sample_bytes).orderBy("h").limit(sample_docs).collect()
        for r in found or rows_of.orderBy("size", "h").limit(1).collect():
            if found and total + r["size"] > sample_bytes:
                continue
            total += r["size"]
            wanted.append((r["h"],))
            kinds[r["h"]] = kind
    if not wanted:
        return [], []
    picked = docs.sparkSession.createDataFrame(wanted, "h long")
    found = (docs.select(F.xxhash64(text).alias("h"), text.alias("t")).join(F.broadcast(picked), "h")
             .groupBy("h").agg(F.min("t").alias("t")).orderBy("h").collect())
    return ([r["t"] for r in found if kinds[r["h"]] == 1], [r["t"] for r in found if kinds[r["h"]] == 0])


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of ``text_col``, a double from 0 to 1.

    A null text is scored as the empty text; repeated rows get the same score;
    other columns pass through, one named ``score_col`` is replaced.
    """
    def run(batch: pa.RecordBatch) -> list:
        meter = _meter(model)
        x = np.array([_features(meter.distances(t), model.thresholds) for t in texts_of(batch, text_col)])
        return [pa.array(_scores(x, model))]

    return with_columns(docs, text_col, [T.StructField(score_col, T.DoubleType())], run)
