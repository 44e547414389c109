"""Mixing sources to target weights, in DataFrame operations only.

Source token shares are raised to an exponent and normalised (temperature
mixing).  The exponent lies on a grid of 2**20 steps between 0 (equal weights)
and 1 (natural shares) and is bisected: it is the largest that keeps the
entropy of the weights at or above a share of its maximum, or, where the
repetition limit asks for more, the smallest that keeps every source within it.

The weights are then realised as budgeted block permutations: each source goes
through its documents in epochs, each epoch a permutation of its own by a hash
of (seed, epoch, document), until its part of the token budget is used.  The
mixture is cut into blocks of about ``block_tokens``; a source's stream is laid
evenly over all blocks, and inside a block the documents of all sources are
permuted by the same hash.  So any run of blocks has the target weights.

The running token sums behind this are taken in two levels: a source is cut
into chunks of about ``chunk_rows`` rows by leading hash digits, sums of chunks
are summed along, and rows only inside their chunk.  A hot source has more
chunks, not larger ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

GRID = 1 << 20
#: Characters that separate words.
WORDS = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def _search(shares: DataFrame, measure: list[Column], good, largest: bool) -> int:
    """Largest (or smallest) grid exponent whose measures are good, by
    bisection; one job takes four steps, as it measures all their midpoints.
    The first (last) grid point counts as good."""
    lo, hi = 0, GRID
    while lo < hi:
        points, spans = set(), [(lo, hi)]
        for _ in range(4):
            spans = [s for a, b in spans if a < b for m in [(a + b + largest) // 2]
                     for s in ([(a, m - 1), (m, b)] if largest else [(a, m), (m + 1, b)])]
            points |= {(a + b + largest) // 2 for a, b in [(lo, hi), *spans] if a < b}
        grid = F.explode(F.array(*[F.lit(p) for p in sorted(points)]))
        rows = shares.withColumn("point", grid).withColumn("a", F.col("point") / F.lit(GRID)).groupBy("point").agg(*measure).collect()
        seen = {r["point"]: good(r) for r in rows}
        while lo < hi and (lo + hi + largest) // 2 in seen:
            mid = (lo + hi + largest) // 2
            if largest:
                lo, hi = (mid, hi) if seen[mid] else (lo, mid - 1)
            else:
                lo, hi = (lo, mid) if seen[mid] else (mid + 1, hi)
    return lo


def weights(totals: DataFrame, budget_tokens: int | None, entropy_share: float | None, max_repeats: float | None) -> DataFrame:
    """``totals(source, tokens, rows)`` with ``weight`` and ``budget`` (tokens).

    Without ``budget_tokens`` the budget is the least that uses every document
    once.  A source without tokens has weight and budget 0.  If the budget
    exceeds ``max_repeats`` times the corpus, no exponent meets the limit; the
    natural shares then repeat all sources alike.
    """
    totals = materialize(totals)
    shares = totals.where("tokens > 0").select("tokens", F.log("tokens").alias("log_n"))
    n, total, log_max = shares.agg(F.count("*"), F.sum("tokens"), F.max("log_n")).first()
    exponent = 1.0
    if n:
        # shares relative to the largest source: their powers stay within 0..1
        z, zl = F.sum(F.exp(F.col("a") * (F.col("log_n") - log_max))).alias("z"), F.sum(
            F.exp(F.col("a") * (F.col("log_n") - log_max)) * (F.col("log_n") - log_max)).alias("zl")
        least = F.min("log_n").alias("least")
        if entropy_share is not None:
            def even(r):
                return math.log(r["z"]) - r["point"] / GRID * r["zl"] / r["z"] >= entropy_share * math.log(n)
            exponent = _search(shares, [z, zl], even, True) / GRID
        if max_repeats is not None:
            def within(r):
                a = r["point"] / GRID
                spread = (1 - a) * (log_max - r["least"])  # log of repeats of the smallest over the largest source
                if budget_tokens is None:
                    return spread <= math.log(max_repeats)
                return math.log(budget_tokens) - math.log(r["z"]) - log_max + spread <= math.log(max_repeats)
            exponent = max(exponent, _search(shares, [z, least], within, False) / GRID)
        power = F.exp(F.lit(exponent) * (F.log("tokens") - log_max))
        z_all = shares.agg(F.sum(F.exp(F.lit(exponent) * (F.col("log_n") - log_max)))).first()[0]
        # the largest source is the one whose budget runs out last
        whole = float(budget_tokens) if budget_tokens is not None else math.exp(log_max) * z_all
        weight = F.when(F.col("tokens") > 0, power / z_all).otherwise(0.0)
        totals = totals.withColumn("weight", weight).withColumn("budget", F.round(F.col("weight") * whole).cast("long"))
    else:
        totals = totals.withColumn("weight", F.lit(0.0)).withColumn("budget", F.lit(0).cast("long"))
    return totals


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
         budget_tokens: int | None = None, entropy_share: float | None = 0.9, max_repeats: float | None = 4.0,
         block_tokens: int = 1 << 18, chunk_rows: int = 4096, seed: str = "mix") -> DataFrame:
    """One row for each document and epoch of the mixture: ``id_col``,
    ``text_hash``, ``source_col``, ``n_tokens``, ``rows``, ``epoch``, ``block``,
    ``pos`` (from 0, inside the block).

    A null source is a source of its own; null and empty texts have no tokens
    and cost nothing; documents of a source without any tokens are taken once,
    spread over the blocks; rows without an id are shuffled by the hash of their
    text.  Equal rows (id and text) are one plan row, ``rows`` says how
    many, and ``n_tokens`` is that of all of them.  The last document of a
    budget is taken whole, documents without tokens at its very end are taken too.
    An empty table gives an empty plan.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = (docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"), F.xxhash64(text).alias("text_hash"),
                        token_count(F.col(text_col)).alias("n"))
            .groupBy("id", "src", "text_hash").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("rows")))
    rows = materialize(rows)
    totals = rows.groupBy("src").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("src_rows"))
    shared = materialize(weights(totals, budget_tokens, entropy_share, max_repeats))
    total = shared.agg(F.sum("budget")).first()[0] or 0
    blocks = max(1, -(-total // block_tokens))

    epochs = F.when(F.col("tokens") == 0, 1).otherwise(F.ceil(F.col("budget") / F.col("tokens")))
    shared = shared.select(
        F.col("src").alias("s"), "tokens", "budget", epochs.cast("long").alias("epochs"),
        F.ceil(F.col("src_rows") / chunk_rows).cast("long").alias("chunks"))
    copies = rows.join(shared, rows.src.eqNullSafe(shared.s)).drop("s").where("epochs > 0").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    copies = copies.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), "epoch", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("text "), F.col("text_hash")))).cast("binary")))
    digits = F.conv(F.substring("key", 1, 7), 16, 10).cast("long")
    copies = copies.withColumn("chunk", F.shiftright(digits * F.col("chunks"), 28))

    sums = copies.groupBy("src", "epoch", "chunk").agg(F.sum("n_tokens").alias("in_chunk"))
    along = Window.partitionBy("src", "epoch").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select(F.col("src").alias("s"), F.col("epoch").alias("e"), F.col("chunk").alias("c"),
                       (F.sum("in_chunk").over(along) - F.col("in_chunk")).alias("before"))
    order = [F.col(c) for c in ("key", "id", "text_hash")]
    inside = Window.partitionBy("src", "epoch", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = copies.join(sums, copies.src.eqNullSafe(sums.s) & (copies.epoch == sums.e) & (copies.chunk == sums.c))
    placed = placed.withColumn("at", F.col("epoch") * F.col("tokens") + F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    free = (F.col("n_tokens") == 0) & (F.col("at") <= F.col("budget"))
    taken = placed.where((F.col("at") < F.col("budget")) | free)
    block = F.when(F.col("tokens") == 0, F.shiftright(digits * F.lit(blocks).cast("long"), 28)).otherwise(
        F.least(F.floor(F.col("at").cast("double") / F.col("budget") * F.lit(blocks)), F.lit(blocks - 1)))
    taken = taken.withColumn("block", block.cast("long"))
    pos = F.row_number().over(Window.partitionBy("block").orderBy(*order, "src")) - 1
    return taken.select(F.col("id").alias(id_col), "text_hash", F.col("src").alias(source_col), "n_tokens", "rows", "epoch", "block",
                        pos.cast("long").alias("pos"))


def mix(docs: DataFrame, planned: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents of a plan, each as often as it is planned, with ``epoch``,
    ``block`` and ``pos``; sort by the last two for the mixture's order.  The
    texts are shuffled once, before they are repeated."""
    made = ["epoch", "block", "pos"]
    names = [c for c in docs.columns if c.lower() not in made]
    left = docs.select(*names).withColumn("__hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    right = planned.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__src"), F.col("text_hash").alias("__text"), *made)
    same = (left["__hash"] == right["__text"]) & left[id_col].eqNullSafe(right["__id"]) & left[source_col].cast("string").eqNullSafe(right["__src"])
    return left.join(right, same).select(*[left[c] for c in names], *made)
