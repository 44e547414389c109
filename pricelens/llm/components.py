"""Connected components of an edge table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: the neighbours of a node that are larger (``large``) or
    not larger than it are linked to the smallest of them all."""
    if large:
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = around.join(least, "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``: ``root`` is the
    smallest node that can be reached.

    Alternates large-star and small-star steps until the table rests, which
    takes a number of rounds in the order of the logarithm of the longest
    chain.  A hub is never gathered: its smallest neighbour is a partial
    aggregate and comes back by a join whose large partitions Spark splits.
    Each round ends in a checkpoint.  Nulls and self-links are left out; an
    empty table gives an empty result.
    """
    edges = settled(edges.where("u IS NOT NULL AND v IS NOT NULL AND u != v").select("u", "v").distinct())
    before = _state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = settled(_stars(_stars(edges, True), False))
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
