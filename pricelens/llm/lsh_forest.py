"""MinHash near-duplicates by an LSH forest.

A text is the set of its distinct word shingles.  Each of ``trees`` trees names
a set by a label of ``DEPTH`` MinHash values; in the order of the labels, sets
that share a prefix stand side by side.  A region is a run of sets with a
common prefix of three values; a region that is crowded is cut at a longer
prefix, as deep as it needs (adaptive depth), so every task holds a bounded
number of sets.  What a crowded region could lose that way is looked up again
at the shortest prefix: its sets outside the region's largest group meet all
its sets, in blocks.

Inside a region the MinHash values of all trees estimate the similarity;
groups of sets that may be similar are then confirmed on the full sets.  Equal
sets are one node, and only groups are formed, never all pairs of a group.

With ``trees`` = 20 two sets at the threshold of 0.8 share no prefix of three
values in any tree with a chance of 6e-7; a link of them is dropped by the
estimate (six standard deviations below the threshold) with one of 1e-9.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import offsets, quoted, settled, steps, texts_of, with_columns, worker_state
from .components import connected_components

#: MinHash values of a label, 16 bits each: four in ``hi``, four in ``lo``.
DEPTH = 8
#: Sets a region holds at most; a longer prefix cuts a larger one.
CROWD = 2048
#: Sets, and shingles, that are confirmed at a time.
TILE, TILE_SHINGLES = 1024, 1 << 20
#: Word codes a worker keeps before it starts anew.
KEPT = 400_000
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes; keeps the words' codes."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def of(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only, cuts at 0x20 and 0x09-0x0D only
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > KEPT:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w)
        code = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(words))
        n = len(words) - k + 1
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = _mix(h * _B + code[j:j + n])
        return np.unique(h)


def shingler(words: int) -> Shingler:
    return worker_state(("lsh_forest", words), lambda: Shingler(words))


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(12)
    return rng.integers(0, 1 << 32, count, np.uint32), rng.integers(0, 1 << 32, count, np.uint32) | np.uint32(1)


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """``count`` MinHash values of 16 bits for each set that is not empty."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = offsets(np.fromiter(map(len, sets), np.int64, len(sets)))[:-1]
    flip, times = _functions(count)
    out, buf = np.empty((len(sets), count), np.uint32), np.empty_like(flat)
    for i in range(count):
        np.bitwise_xor(flat, flip[i], out=buf)
        np.multiply(buf, times[i], out=buf)
        np.bitwise_xor(buf, buf >> np.uint32(15), out=buf)
        np.multiply(buf, np.uint32(0x2C1B3C6D), out=buf)
        out[:, i] = np.minimum.reduceat(buf, starts)
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


_FEATURES = [T.StructField("key", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("hi", T.ArrayType(T.LongType())),
             T.StructField("lo", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())]


def features(docs: DataFrame, text_col: str, words: int, trees: int) -> DataFrame:
    """``docs`` with ``key`` (digest of the set), ``n_shingles``, the labels of
    all trees and one byte of each MinHash value; an empty set has a null key."""
    def run(batch: pa.RecordBatch) -> list:
        of = shingler(words).of
        sets = [of(t) for t in texts_of(batch, text_col)]
        full = [i for i, s in enumerate(sets) if len(s)]
        keys, his, los, sigs = ([None] * len(sets) for _ in range(4))
        for at in _chunks([len(sets[i]) for i in full], 1 << 18):
            part = [full[j] for j in at]
            values = signatures([sets[i] for i in part], trees * DEPTH)
            halves = values.reshape(-1, trees, 2, 4).astype(np.uint64)
            longs = (halves[..., 0] << np.uint64(48) | halves[..., 1] << np.uint64(32) | halves[..., 2] << np.uint64(16) | halves[..., 3]).view(np.int64)
            low = values.astype(np.uint8)
            for i, x, s in zip(part, longs, low):
                keys[i], his[i], los[i], sigs[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), x[:, 0], x[:, 1], s.tobytes()
        longs = pa.list_(pa.int64())
        return [pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(his, longs), pa.array(los, longs),
                pa.array(sigs, pa.binary())]

    return with_columns(docs, text_col, _FEATURES, run, limit=4 << 20)


def _chunks(sizes: list[int], limit: int):
    """Runs of places whose sizes sum to about ``limit``, one place at least."""
    run, total = [], 0
    for i, n in enumerate(sizes):
        if run and total + n > limit:
            yield run
            run, total = [], 0
        run.append(i)
        total += n
    if run:
        yield run


def _prefix(depth: int) -> Column:
    """The first ``depth`` values of the row's label as two longs."""
    hi = F.shiftrightunsigned("hi", 16 * (4 - min(depth, 4)))
    lo = F.shiftrightunsigned("lo", 16 * (8 - depth)) if depth > 4 else F.lit(0).cast("long")
    return F.struct(hi.alias("a"), lo.alias("b"))


def regions(sets: DataFrame, crowd: int, depths: tuple[int, ...] = (3, 4, 6, 8)) -> tuple[DataFrame, DataFrame]:
    """``(rows, crowded)`` of ``sets(key, hi, lo)``, the labels of all trees.

    ``rows(key, region)`` has every set in the regions it shares with others,
    at the first of ``depths`` that leaves no more than ``crowd`` of them; a
    region that even the whole label leaves larger is dealt out by key.
    ``crowded(key, region)`` has the regions of the first depth that were cut."""
    rows = sets.select("key", F.posexplode(F.arrays_zip("hi", "lo"))).select("key", F.col("pos").alias("tree"), "col.hi", "col.lo")
    done, crowded = [], None
    for depth in depths:
        rows = rows.withColumn("p", _prefix(depth))
        sizes = rows.groupBy("tree", "p").agg(F.count("*").alias("n")).where("n > 1")
        rows = rows.join(sizes, ["tree", "p"])
        if depth == depths[0]:
            rows = settled(rows)
        region = F.xxhash64("tree", F.lit(depth), "p")
        done.append(rows.where(F.col("n") <= crowd).select("key", region.alias("region")))
        rows = rows.where(F.col("n") > crowd)
        if depth == depths[0]:
            crowded = settled(rows.select("key", region.alias("region")))
            if crowded.isEmpty():
                break
        if depth == depths[-1]:
            dealt = F.pmod(F.xxhash64("key", F.lit("deal")), F.ceil(F.col("n") / crowd))
            done.append(rows.select("key", F.xxhash64("tree", F.lit(depth), "p", dealt).alias("region")))
        rows = rows.select("key", "tree", "hi", "lo")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out, crowded


def _grouped(batches, cols: list[str]):
    """The rows of sorted batches, one table for each run of equal ``cols``."""
    held: list[pa.RecordBatch] = []

    def mark(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(batch.schema.get_field_index(c))[i].as_py() for c in cols)

    for batch in batches:
        if not batch.num_rows:
            continue
        cut = np.zeros(batch.num_rows, bool)
        for c in cols:
            x = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            cut[1:] |= x[1:] != x[:-1]
        bounds = [0, *np.flatnonzero(cut).tolist(), batch.num_rows]
        for lo, hi in zip(bounds, bounds[1:]):
            part = batch.slice(lo, hi - lo)
            if held and (lo or mark(held[0], 0) != mark(part, 0)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _spread(n: int, near, left: np.ndarray | None = None) -> np.ndarray:
    """Group of each of 0..n-1 (its first member): ``near(i, others)`` tells
    which of the places ``others`` are linked with ``i``.  Each place meets only
    those that are not yet in a group; with ``left``, places outside it meet
    those inside it only."""
    group, open_ = np.full(n, -1), np.arange(n)
    for start in range(n):
        if group[start] >= 0:
            continue
        group[start] = start
        open_ = open_[group[open_] < 0]
        wait = [start]
        while wait and len(open_):
            i = wait.pop()
            others = open_ if left is None or left[i] else open_[left[open_]]
            hit = others[near(i, others)] if len(others) else others
            if len(hit):
                group[hit] = start
                wait.extend(hit.tolist())
                open_ = open_[group[open_] < 0]
    return group


def _stars(keys: list[bytes], group: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """A link from every member of a group to its least key."""
    least: dict[int, bytes] = {}
    for k, g in zip(keys, group.tolist()):
        if g not in least or k < least[g]:
            least[g] = k
    links = [(k, least[g]) for k, g in zip(keys, group.tolist()) if k != least[g]]
    return [u for u, _ in links], [v for _, v in links]


_LINKS = "u binary, v binary"


def _emit(links: tuple[list[bytes], list[bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in links], names=["u", "v"])


def _left(table: pa.Table) -> np.ndarray | None:
    """Where a block has rows of both sides, which rows are of the left one."""
    side = table.column("side").to_numpy(zero_copy_only=False)
    return side == 0 if side.any() else None


def _screen(percent: int, count: int):
    """Groups of sets that may be similar, by their MinHash values and sizes."""
    t = percent / 100
    cut = count * (t - 6 * math.sqrt(t * (1 - t) / count))

    def run(batches):
        for table in _grouped(batches, ["region", "block"]):
            if table.num_rows < 2:
                continue
            keys = table.column("key").to_pylist()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, count)
            size = table.column("n_shingles").to_numpy()

            def near(i, others):
                fits = (100 * size[others] >= percent * size[i]) & (100 * size[i] >= percent * size[others])
                fits[fits] = np.count_nonzero(sig[others[fits]] == sig[i], axis=1) >= cut
                return fits

            yield _emit(_stars(keys, _spread(len(keys), near, _left(table))))

    return run


def _confirm(percent: int, words: int):
    """Groups of sets linked by their similarity, on the full sets."""
    def run(batches):
        of = shingler(words).of
        sliced = (s for b in batches for s in steps([b], "text", 4 << 20))

        def sets():
            # a slice of texts becomes sets at once, so that a tile holds no texts
            for b in sliced:
                names = [c for c in b.schema.names if c != "text"]
                made = [of(t).view(np.int64) for t in texts_of(b, "text")]
                cols = [b.column(b.schema.get_field_index(c)) for c in names]
                off = offsets(np.fromiter(map(len, made), np.int64, len(made))).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(made))))
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "set"])

        for table in _grouped(sets(), ["region", "block"]):
            if table.num_rows < 2:
                continue
            keys = table.column("key").to_pylist()
            lists = table.column("set").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            number = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
            start, marks = offsets(size), np.zeros(int(number.max()) + 1, np.int8)

            def near(i, others):
                out = (100 * size[others] >= percent * size[i]) & (100 * size[i] >= percent * size[others])
                fit = others[out]
                if len(fit):
                    own = number[start[i]:start[i + 1]]
                    marks[own] = 1
                    if 2 * len(fit) > len(size):  # most of the tile: one pass over all
                        both = np.add.reduceat(marks[number], start[:-1], dtype=np.int64)[fit]
                    else:
                        both = np.array([np.count_nonzero(marks[number[start[j]:start[j + 1]]]) for j in fit.tolist()])
                    marks[own] = 0
                    out[out] = 100 * both >= percent * (size[i] + size[fit] - both)
                return out

            yield _emit(_stars(keys, _spread(len(keys), near, _left(table))))

    return run


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("region", "block").sortWithinPartitions("region", "block")


def _largest(rows: DataFrame, group: Column) -> DataFrame:
    """``(region, big)``: the largest group of each region, the least of ties."""
    sizes = rows.groupBy("region", group.alias("g")).agg(F.count("*").alias("c"))
    return sizes.groupBy("region").agg(F.max_by("g", F.struct("c", F.col("g"))).alias("big"))


def _against_rest(rows: DataFrame, tile: int) -> DataFrame:
    """``rows(region, key, n_shingles, g)`` in blocks in which every row
    outside the region's largest group ``g`` meets every row of the region.

    Rows outside are dealt into tiles (side 0), all rows into tiles (side 1);
    a block is a pair of tiles.  A region that is one group has no block."""
    rows = rows.select("region", "key", "n_shingles", "g")
    big = _largest(rows, F.col("g"))
    rows = rows.join(big, "region").withColumn("out", F.col("g") != F.col("big"))
    total = rows.groupBy("region").agg(F.count_if("out").alias("outs"), F.count("*").alias("rows"), F.sum("n_shingles").alias("weight")).where("outs > 0")
    shape = total.select("region", F.greatest(F.ceil(F.col("rows") / tile), F.ceil(F.col("weight") / TILE_SHINGLES)).alias("tiles"),
                         F.ceil(F.col("outs") / tile).alias("left_tiles"))
    rows = rows.join(shape, "region")
    mine = F.pmod(F.xxhash64("key", F.lit("left")), F.col("left_tiles"))
    side0 = rows.where("out").select("region", "key", "n_shingles", F.lit(0).alias("side"), mine.alias("x"),
                                     F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("y"))
    other = F.pmod(F.xxhash64("key", F.lit("all")), F.col("tiles"))
    side1 = rows.select("region", "key", "n_shingles", F.lit(1).alias("side"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.col("left_tiles") - 1)).alias("x"), other.alias("y"))
    return side0.union(side1).select("region", F.xxhash64("x", "y").alias("block"), "key", "n_shingles", "side")


def _rooted(sets: DataFrame, links: DataFrame) -> DataFrame:
    """``sets(key, ...)`` with ``g``, the least key of its group."""
    found = connected_components(links).select(F.col("node").alias("key"), F.col("root").alias("g"))
    return sets.join(found, "key", "left").withColumn("g", F.coalesce("g", "key"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 80,
                    trees: int = 20, crowd: int = CROWD, tile: int = TILE) -> DataFrame:
    """``docs`` (without the text) with ``n_shingles``, ``component_id`` (the
    smallest id that can be reached over links) and ``kept`` (the row's id is
    that id).

    Two texts are linked if their sets' Jaccard similarity reaches ``percent``
    hundredths.  A text with fewer words than a shingle is one shingle as a
    whole; null and empty texts have the empty set and are linked with nothing.
    Rows with a null id belong to a component, never name one and are not kept;
    repeated rows are returned as often as they occur; texts of any length are
    taken whole; input columns named as a result are replaced; an empty table
    gives an empty result.
    """
    results = {"key", "n_shingles", "hi", "lo", "sig", "component_id", "kept", "g"} - {id_col.lower()}
    others = [c for c in docs.columns if c not in (id_col, text_col) and c.lower() not in results]
    digest = F.struct(F.xxhash64(F.col(quoted(text_col))).alias("a"), F.hash(F.col(quoted(text_col))).alias("b"))
    base = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"), digest.alias("digest"),
                       F.struct(*[F.col(quoted(c)) for c in others]).alias("rest") if others else F.lit(None).cast("int").alias("rest"))
    rows = settled(features(base, "text", shingle, trees).drop("text"))
    sets = settled(rows.where("key IS NOT NULL").groupBy("key").agg(
        F.min("id").alias("least"), F.min("digest").alias("digest"), *[F.first(c).alias(c) for c in ("n_shingles", "hi", "lo", "sig")]))
    slim, count = sets.select("key", "n_shingles", "sig"), trees * DEPTH

    # sets that may be similar
    placed, crowded = regions(sets.select("key", "hi", "lo"), crowd)
    one = placed.join(slim, "key").select("region", F.lit(0).cast("long").alias("block"), F.lit(0).alias("side"), "key", "n_shingles", "sig")
    maybe = settled(_in_blocks(one).mapInArrow(_screen(percent, count), _LINKS).distinct())
    if not crowded.isEmpty():
        # what a cut region may have lost: the shortest prefix again
        again = crowded.join(_rooted(sets.select("key", "n_shingles"), maybe), "key")
        blocks = _against_rest(again, tile).join(slim.select("key", "sig"), "key").select("region", "block", "side", "key", "n_shingles", "sig")
        more = _in_blocks(blocks).mapInArrow(_screen(percent, count), _LINKS)
        maybe = settled(maybe.union(more).distinct())

    # the same on the full sets
    groups = settled(connected_components(maybe).select(F.col("node").alias("key"), F.xxhash64("root").alias("region"))
                         .join(sets.select("key", "n_shingles"), "key"))
    wanted = sets.select("key", "digest").join(groups.select("key"), "key")
    text_of = settled(base.select("digest", "text").join(wanted, "digest").groupBy("key").agg(F.first("text").alias("text")))
    sizes = groups.groupBy("region").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("n_shingles") / TILE_SHINGLES)).alias("tiles"))
    sized = settled(groups.join(sizes, "region"))

    def confirmed(blocks: DataFrame) -> DataFrame:
        rows = blocks.select("region", "block", "side", "key").join(text_of, "key")
        return settled(_in_blocks(rows).mapInArrow(_confirm(percent, shingle), _LINKS))

    small = sized.where("tiles = 1").select("region", F.lit(0).cast("long").alias("block"), F.lit(0).alias("side"), "key")
    found = confirmed(small).select(F.col("u").alias("key"), F.col("v").alias("g"))
    large = sized.where("tiles > 1")
    if not large.isEmpty():
        # dealt into tiles twice: what one deal splits, the other may join
        dealt = large.select("region", "key", "tiles", F.explode(F.array(F.lit(0), F.lit(1))).alias("deal")).select(
            "region", F.xxhash64("deal", F.pmod(F.xxhash64("key", "deal"), F.col("tiles"))).alias("block"), F.lit(0).alias("side"), "key")
        links = confirmed(dealt)
        links = settled(links.union(confirmed(_against_rest(_rooted(large, links), tile))))
        found = found.union(connected_components(links).where("node != root").toDF("key", "g"))

    rooted = sets.select("key", "least").join(found, "key", "left").withColumn("g", F.coalesce("g", "key"))
    named = rooted.groupBy("g").agg(F.min("least").alias("component_id"))
    of = rooted.join(named, "g").select("key", "component_id")
    out = rows.join(of, "key", "left").withColumn("component_id", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), *[F.col("rest").getField(c).alias(c) for c in others], "n_shingles", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
