"""Document fingerprints by SpotSigs.

A spot signature is a chain of content words that follows a common-word anchor:
anchors are frequent function words, a chain is the next ``chain`` words that
are not.  The set of a text's signatures is its fingerprint; two fingerprints
are compared by Jaccard similarity.  Sets can only reach a similarity if the
smaller one's length is that share of the larger one's, so sets are partitioned
by length, each meets its own and the next partition only, and candidates come
from the rarest signatures of a set.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import steps, texts_of, with_columns, worker_state

# Common words of four languages, in alphabetical order.
ANCHORS = {
    "de": "als am an auch auf aus bei das dem den der des die ein eine einen einer es für im in ist mit nicht sich sie und von war wie zu zum",
    "en": "a an and are as at be been but by can did do for from had has have he in is it not of on or that the this to was were which will with would you",
    "es": "a al como con de del el en es la las lo los más no para pero por que se su sus un una y",
    "fr": "au aux avec ce dans de des du elle en est et il la le les mais ne ou par pas pour qu que qui se son sur un une",
}
#: Text of a range of ids, which is one task's work; the number of ranges is
#: bounded (the driver holds their ends), beyond it ranges grow with the table.
RANGE_BYTES, MOST_RANGES = 16 << 20, 100_000
#: Word codes a worker keeps before it starts anew.
KEPT = 400_000
_MIX, _STEP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_TRIM = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’…–—"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class Spotter:
    """Signature sets of texts; keeps the codes of words it has met.

    A text without any anchor that a chain follows takes every word as an
    anchor; one with fewer words than a chain has the set of its words' hash.
    """

    def __init__(self, chain: int, anchors: frozenset[str]):
        self.chain, self.anchors = chain, anchors
        self.known: dict[str, int] = {}

    def _code(self, word: str) -> int:
        """Hash of the bare word in 62 bits, lowest bit: it is an anchor;
        nothing but punctuation counts as no word (-1)."""
        bare = word.strip(_TRIM)
        if not bare:
            return -1
        return (xxhash.xxh3_64_intdigest(bare.encode("utf-8", "replace")) >> 2) << 1 | (bare in self.anchors)

    def spots(self, text: str) -> np.ndarray:
        """Sorted distinct signatures, unsigned 32 bits each."""
        words = text.lower().split()
        codes = list(map(self.known.get, words))
        if None in codes:
            if len(self.known) > KEPT:
                self.known.clear()
            for w in set(words).difference(self.known):
                self.known[w] = self._code(w)
            codes = list(map(self.known.__getitem__, words))
        codes = np.array(codes, np.int64)
        codes = codes[codes >= 0]
        if not len(codes):
            return np.zeros(0, np.uint32)
        anchor = (codes & 1).astype(bool)
        content = np.flatnonzero(~anchor)
        after = np.cumsum(~anchor)  # content words up to and with each word
        at = np.flatnonzero(anchor & (after + self.chain <= len(content)))
        if not len(at):
            content = np.arange(len(codes))
            after = content + 1
            at = content[:max(1, len(content) - self.chain)]
        h = codes[at].astype(np.uint64) * _STEP
        for k in range(self.chain):
            nxt = np.minimum(after[at] + k, len(content) - 1)
            h = _mix(h + codes[content[nxt]].astype(np.uint64) + np.uint64(k)) * _STEP
        return np.unique((_mix(h) >> np.uint64(32)).astype(np.uint32))


def spotter(chain: int, anchors: frozenset[str]) -> Spotter:
    return worker_state(("spotsigs", chain, anchors), lambda: Spotter(chain, anchors))


def every_anchor() -> frozenset[str]:
    return frozenset(w for words in ANCHORS.values() for w in words.split())


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets, 1 for two empty ones; 0 as soon as
    the lengths show that it lies below ``least``."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_text(spots: np.ndarray) -> str:
    """A fingerprint as text: eight hex digits for each signature, ascending."""
    return spots.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint", chain: int = 2,
                 anchors: frozenset[str] | None = None) -> DataFrame:
    """``docs`` with the fingerprint of ``text_col``; a null text has that of
    the empty text, the empty string."""
    anchors = anchors or every_anchor()

    def run(batch: pa.RecordBatch) -> list:
        spot = spotter(chain, anchors).spots
        return [pa.array([as_text(spot(t)) for t in texts_of(batch, text_col)], pa.string())]

    return with_columns(docs, text_col, [T.StructField(out_col, T.StringType())], run)


def _ranges(docs: DataFrame, text_col: str) -> int:
    """Ranges of about ``RANGE_BYTES`` of text."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return min(max(2, -(-size // RANGE_BYTES)), MOST_RANGES)


def in_id_order(docs: DataFrame, id_col: str, ranges: int) -> DataFrame:
    """``docs`` with ``part`` and ``border``: ranges of ids, numbered upwards.

    A range also holds, as border rows, the first document that follows it in
    descending order; the lowest range holds the table's first.  A null id is
    below all others.
    """
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)] or [F.lit(0.5)])
    cuts = docs.agg(F.percentile_approx(id_col, shares, F.lit(max(10_000, 20 * ranges)))).first()[0]
    bounds, lowest = np.unique(np.array(cuts or [], np.int64)), np.iinfo(np.int64).min

    def place(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x = ids.fill_null(lowest).to_numpy(zero_copy_only=False)
        return x, np.searchsorted(bounds, x).astype(np.int32)

    @F.arrow_udf("int")
    def part_of(ids: pa.Array) -> pa.Array:
        return pa.array(place(ids)[1])

    tops = docs.select(id_col).withColumn("part", part_of(id_col)).groupBy("part").agg(F.max(id_col).alias("head"))
    heads = sorted((r["part"], lowest if r["head"] is None else r["head"]) for r in tops.collect())  # one row a range
    kept = [c for c in docs.columns if c not in ("part", "border")]
    if not heads:
        return docs.select(*kept, F.lit(0).alias("part"), F.lit(0).alias("border"))
    head, goes = np.full(heads[-1][0] + 1, lowest), np.zeros(heads[-1][0] + 1, np.int32)
    for i, (part, top) in enumerate(heads):
        head[part], goes[part] = top, heads[(i + 1) % len(heads)][0]

    @F.arrow_udf("struct<part:int,goes:int>")
    def places(ids: pa.Array) -> pa.Array:
        x, part = place(ids)
        return pa.StructArray.from_arrays([pa.array(part), pa.array(goes[part], mask=x != head[part])], ["part", "goes"])

    own = F.struct(F.col("at.part").alias("part"), F.lit(0).alias("border"))
    next_ = F.struct(F.col("at.goes").alias("part"), F.lit(1).alias("border"))
    placed = docs.select(*kept).withColumn("at", places(id_col))
    return placed.withColumn("to", F.explode(F.when(F.col("at.goes").isNull(), F.array(own)).otherwise(F.array(own, next_)))).select(
        *kept, F.col("to.part").alias("part"), F.col("to.border").alias("border"))


_PAIR_SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = 2,
                      anchors: frozenset[str] | None = None) -> DataFrame:
    """Every document against an edited form of itself and against the next one
    by descending id (the first after the last).

    The edited text has its last third of code points replaced by the first as
    many (or all) of the next document.  Null texts are empty; a null id comes
    last; rows that share an id follow each other by the hash of their text; a
    single row is its own next.
    """
    anchors = anchors or every_anchor()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = _ranges(rows, "text")
    rows = (in_id_order(rows, "id", ranges).withColumn("hash", F.xxhash64("text")).repartitionById(ranges, "part")
            .sortWithinPartitions("part", "border", F.desc_nulls_last("id"), "hash"))

    def run(batches):
        spot = spotter(chain, anchors).spots
        last = None  # (part, id, text, spots) that waits for its next
        out: list[tuple] = []

        def settle(doc, following):
            _, id_, text, spots = doc
            n = len(text)
            edited = text[:n - n // 3] + following[2][:n // 3]
            own = spot(edited)
            return (id_, n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), as_text(spots), as_text(own),
                    likeness(spots, own), likeness(spots, following[3]))

        def batch_of(rows_):
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_), types)], names=["id", *[x.split()[0] for x in _PAIR_SCHEMA.split(", ")]])

        for batch in steps(batches, "text"):
            parts, borders, ids = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "border", "id"))
            for part, border, id_, text in zip(parts, borders, ids, texts_of(batch, "text")):
                if border and (last is None or last[0] != part):
                    continue  # a further row of the border's id
                doc = (part, id_, text, spot(text))
                if last is not None and last[0] == part:
                    out.append(settle(last, doc))
                last = None if border else doc
            if out:
                yield batch_of(out)
                out = []

    return rows.select("part", "border", "id", "text").mapInArrow(run, "id long, " + _PAIR_SCHEMA).withColumnRenamed("id", id_col)


def _length_part(n: Column, threshold: float) -> Column:
    """Number of the partition of a set of ``n`` signatures: two sets that can
    reach the threshold lie in the same partition or in neighbours.

    Partitions are equal steps of the logarithm, a thousandth wider than the
    threshold asks, so that rounding never puts two such sets further apart.
    Where the threshold leaves no room for sets of different length, every
    length is a partition."""
    if threshold > 1 - 2.0 ** -31:
        return n.cast("long")
    return F.floor(F.log(n.cast("double")) / (-math.log(threshold) * 1.001))


def similar(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", chain: int = 2,
            anchors: frozenset[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Near duplicates: ``(classes, pairs)``.

    ``classes`` has ``id_col`` and ``class`` for every row: rows with equal
    fingerprints are one class, named by its smallest id (null if none of its
    rows has one).  ``pairs`` has ``a``, ``b`` and ``likeness`` for every two
    named classes whose Jaccard similarity reaches ``threshold``; ``a`` is the
    one with the shorter set (the smaller id on ties).  Copies are never
    unfolded.  Empty sets are one class and pair with no other.

    Sets are partitioned by length and meet on their rarest signatures, so many
    of them that two similar sets share one; candidates whose lengths rule the
    threshold out are pruned before the sets are read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie above 0 and be 1 at most")
    rows = materialize(fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), text_col), text_col, "fp", chain, anchors).select(
        "id", F.sha2("fp", 256).alias("key"), "fp"))
    named = rows.groupBy("key").agg(F.min("id").alias("class"), F.first("fp").alias("fp"))
    spots = F.transform(F.sequence(F.lit(0), (F.length("fp") / 8).cast("int") - 1), lambda i: F.substr(F.col("fp"), i * 8 + 1, F.lit(8)))
    sets = materialize(named.where((F.length("fp") > 0) & F.col("class").isNotNull()).select(
        "class", (F.length("fp") / 8).cast("int").alias("n"), spots.alias("spots")))
    each = sets.select("class", "n", F.explode("spots").alias("spot"))
    rare = each.groupBy("spot").agg(F.count("*").alias("sets"))
    rank = F.row_number().over(Window.partitionBy("class").orderBy("sets", "spot"))  # a set is no longer than its text
    first = each.join(rare, "spot").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    keyed = first.withColumn("part", _length_part(F.col("n"), threshold)).select("class", "n", "spot", "part")
    short = keyed.select(F.col("class").alias("a"), F.col("n").alias("na"), "spot", "part")
    long = keyed.select(F.col("class").alias("b"), F.col("n").alias("nb"), "spot",
                        F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"))
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    met = short.join(long, ["part", "spot"]).where(ordered & (F.col("na") >= F.col("nb") * threshold - 1e-9)).select("a", "b").distinct()
    left, right = sets.select(F.col("class").alias("a"), F.col("spots").alias("sa")), sets.select(F.col("class").alias("b"), F.col("spots").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    pairs = met.join(left, "a").join(right, "b").withColumn("likeness", both / (F.size("sa") + F.size("sb") - both))
    classes = rows.select("id", "key").join(named.select("key", "class"), "key").select(F.col("id").alias(id_col), "class")
    return classes, pairs.where(F.col("likeness") >= threshold - 1e-12).select("a", "b", "likeness")
