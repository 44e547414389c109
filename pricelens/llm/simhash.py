"""SimHash near-duplicate groups by tiled exact comparison.

Fingerprints are compared with numpy, tile against tile: exclusive-or, then
bit counts.  A tile holds fingerprints in order of their population count, and
a pair of tiles whose counts differ by more than the radius is skipped, since
two fingerprints within ``radius`` bits cannot differ more in that count.

A tile grid over all fingerprints would grow with their square, so the grid is
laid inside the blocks of the pigeonhole rule: of ``radius + k`` bit ranges,
two fingerprints within the radius agree in ``k`` at least.  The values of each
``k`` ranges are a block, each block has its own grid, and no pair is lost for
any ``k``.  More ranges mean longer keys and smaller blocks, but more copies of
a fingerprint; ``k`` grows with the number of fingerprints, so that comparisons
for each of them stay bounded (see ``_agreeing``).  Blocks are cut into
tiles of about ``tile`` rows by their population-count histogram, whatever
their size, and each pair of tiles is one group of rows; a group emits, for
every row, one link at most (to the smallest fingerprint it hangs together
with), so linked copies never unfold into all pairs.  Equal fingerprints are
one row from the start.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import texts_of, with_columns, worker_state
from .components import connected_components

BITS = 64
#: Rows that carry a large group's smallest id to its members.
SALTS = 16
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str, shingle: int, seed: int = 42) -> int:
    """SimHash of the word shingles of a text, repeats included: a bit is set
    if it is set in more than half of the shingles' XXH64."""
    data = text.encode("utf-8", "replace").lower()  # bytes: lower-cases A-Z only
    words = data.split()  # bytes: cuts at 0x20 and 0x09-0x0D only
    if not words:
        return 0
    hash_, n = xxhash.xxh64_intdigest, len(words)
    if n <= shingle:
        return hash_(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    begins = [0, *ends[:n - shingle].tolist()]
    stops = (ends[shingle - 1:] - 1).tolist()
    h = np.array([hash_(line[a:b], seed) for a, b in zip(begins, stops)], np.uint64)
    lanes = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    if len(h) < 400:
        ones = np.unpackbits(lanes, axis=1).sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, text_col: str = "text", out_col: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of ``text_col`` as a signed long; a null
    text, like one without words, has fingerprint zero."""
    def run(batch: pa.RecordBatch) -> list:
        worker_state("simhash", object)  # keeps nothing, and lets go what others kept
        fps = np.array([fingerprint(t, shingle) for t in texts_of(batch, text_col)], np.uint64)
        return [pa.array(fps.view(np.int64))]

    return with_columns(docs, text_col, [T.StructField(out_col, T.LongType())], run)


def _agreeing(n: int, radius: int, tile: int) -> int:
    """Ranges that must agree, for ``n`` fingerprints: the number of least work,
    where a row that goes to a block costs as much as ``tile`` comparisons and
    an evenly filled block compares it with ``n / 2**bits`` others."""
    def work(k: int) -> float:
        bits = k * (BITS // (radius + k))
        return math.comb(radius + k, k) * (tile + n / 2.0 ** bits)

    return min(range(1, max(2, min(6, BITS - radius + 1))), key=work)


def _masks(radius: int, agreeing: int) -> list[int]:
    """The bits (as signed longs) of each choice of ``agreeing`` ranges out of
    ``radius + agreeing``."""
    cuts = [round(i * BITS / (radius + agreeing)) for i in range(radius + agreeing + 1)]
    ranges = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) - (sum(chosen) >> 63 << 64) for chosen in itertools.combinations(ranges, agreeing)]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index each of 0..n-1 hangs together with over the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _links(left: np.ndarray, right: np.ndarray | None, radius: int, chunk: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links inside ``left``, or between ``left`` and ``right``, each an array
    of fingerprints: for every linked row one link to the smallest it hangs
    together with."""
    def by_count(x):
        c = np.bitwise_count(x)
        order = np.argsort(c, kind="stable")
        return x[order], c[order].astype(np.int64)

    left, lc = by_count(left)
    other, oc = (left, lc) if right is None else by_count(right)
    base = 0 if right is None else len(left)
    root = np.arange(base + len(other))
    for lo in range(0, len(left), chunk):
        hi = min(lo + chunk, len(left))
        # rows whose population count lies beyond the radius are not compared
        first = lo if right is None else int(np.searchsorted(oc, lc[lo] - radius))
        last = int(np.searchsorted(oc, lc[hi - 1] + radius, "right"))
        for at in range(first, last, 8 * chunk):
            to = min(at + 8 * chunk, last)
            a, b = np.nonzero(np.bitwise_count(left[lo:hi, None] ^ other[None, at:to]) <= radius)
            a, b = a + lo, b + at + base
            if right is None:
                a, b = a[a < b], b[a < b]
            if len(a):
                root = _roots(len(root), np.concatenate([np.arange(len(root)), a]), np.concatenate([root, b]))
    every = left if right is None else np.concatenate([left, other])
    least = np.full(len(every), np.iinfo(np.int64).max)
    np.minimum.at(least, root, every.view(np.int64))
    v = least[root]
    linked = v != every.view(np.int64)
    return every.view(np.int64)[linked], v[linked]


def _compare(radius: int):
    """Reads rows in order of (block, a, b) and emits the links of each group;
    a group may span batches and is held until it ends."""
    def run(batches):
        held: list[pa.RecordBatch] = []

        def groups(table: pa.Table):
            block, a, b, side, fp = (table.column(c).to_numpy() for c in ("block", "a", "b", "side", "fp"))
            cut = np.flatnonzero((np.diff(block) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)) + 1
            return fp.view(np.uint64), side, a != b, [0, *cut.tolist(), len(fp)]

        def flush(table: pa.Table, keep_last: bool):
            fp, side, crossed, cut = groups(table)
            us, vs = [], []
            for lo, hi in zip(cut, cut[1:] if not keep_last else cut[1:-1]):
                if hi - lo < 2:
                    continue
                x, s = fp[lo:hi], side[lo:hi]
                u, v = _links(x[s == 0], x[s == 1], radius) if crossed[lo] else _links(x, None, radius)
                us.append(u)
                vs.append(v)
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in (us, vs)], names=["u", "v"])
            return out, table.slice(cut[-2]).to_batches() if keep_last else []

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            tail = held[0]
            same = all(tail.column(c)[0] == batch.column(c)[batch.num_rows - 1] for c in ("block", "a", "b"))
            if not same:
                out, held = flush(pa.Table.from_batches(held), True)
                yield out
        if held:
            yield flush(pa.Table.from_batches(held), False)[0]

    return run


def links(fps: DataFrame, radius: int, tile: int = 4096, agreeing: int | None = None) -> DataFrame:
    """``(u, v)`` links between the fingerprints of ``fps(fp)``, distinct longs:
    their components are those of all pairs within ``radius`` bits, whatever
    number of ranges must agree (by default as ``_agreeing`` finds for the
    number of rows)."""
    masks = _masks(radius, agreeing or _agreeing(fps.count(), radius, tile))
    blocks = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(masks)])
    rows = fps.select("fp", F.bit_count("fp").alias("pop"), F.explode(blocks).alias("block"))
    in_block = Window.partitionBy("block").orderBy("pop")
    near = in_block.rangeBetween(-radius, radius)
    cells = rows.groupBy("block", "pop").agg(F.count("*").alias("n")).withColumn(
        "start", F.sum("n").over(in_block.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    cells = cells.select(
        "block", "pop", "n", "start", F.floor(F.min("start").over(near) / tile).cast("int").alias("first"),
        F.floor((F.max(F.col("start") + F.col("n")).over(near) - 1) / tile).cast("int").alias("last"))
    # about the rank of the row in its block, by population count
    rank = F.col("start") + F.pmod(F.xxhash64("fp"), F.col("n"))
    placed = rows.join(cells, ["block", "pop"]).withColumn("t", F.floor(rank / tile).cast("int"))
    pairs = placed.select("fp", "block", "t", F.explode(F.sequence("first", "last")).alias("o")).select(
        "block", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), (F.col("t") > F.col("o")).cast("int").alias("side"), "fp")
    return (pairs.repartition("block", "a", "b").sortWithinPartitions("block", "a", "b")
            .mapInArrow(_compare(radius), "u long, v long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4,
                    tile: int = 4096) -> DataFrame:
    """``docs`` (without the text) with ``fp`` (long) and ``component_id``: the
    smallest id of the documents that can be reached over links of at most
    ``radius`` differing bits.

    Null and empty texts share fingerprint zero and are linked like any other;
    rows with a null id belong to a component and never name one; repeated rows
    are returned as often as they occur; an empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, shingle, text_col).drop(text_col).drop("component_id"))
    nodes = materialize(fps.groupBy("fp").agg(F.min(id_col).alias("least")))
    found = connected_components(links(nodes.select("fp"), radius, tile))
    rooted = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", "root")
    # a fingerprint without links names itself; the members of a large group meet its id in several rows
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")
    named = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("named")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    grouped = rooted.where("root IS NOT NULL").withColumn("salt", salt).join(named, ["root", "salt"]).select("fp", F.col("named").alias("component_id"))
    of = grouped.union(rooted.where("root IS NULL").select("fp", F.col("least").alias("component_id")))
    return fps.join(of, "fp")
