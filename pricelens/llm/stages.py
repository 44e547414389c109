"""The stages of the corpus pipeline, each a call of one operator.

Every stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents``
and works on all rows it is given; all but the last return those columns, whole
rows with other columns passed through.  Null ids, null texts and repeated rows
go through every stage as the operators define it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, mixing, repeats, simhash, toxicity
from .common import read
from .queries import BYTE_RANKS, training


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 for toxicity.  The model is learned from
    the labels outside the held-out fold and the documents of this stage."""
    model = training(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score_col="__score").where(F.col("__score") < 0.5).drop("__score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that with the smallest id, of rows
    that repeat the id that of the least text hash.  Texts without words are a
    group like any other.  A row without an id stays only where its group has
    no id at all; such rows are one group for each fingerprint."""
    rows = docs.withColumn("__hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    groups = simhash.near_duplicates(rows.select("doc_id", "text", "__hash"), shingle=4, radius=4)
    named = F.col("component_id").isNotNull()
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("__hash").alias("hash"))
    first = groups.groupBy(named.alias("named"), F.coalesce("component_id", "fp").alias("group")).agg(F.min(place).alias("first"))
    first = first.select(F.col("first.id").alias("__id"), F.col("first.hash").alias("__first"))
    kept = rows.join(first, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__first"))).drop("__id", "__first")
    return kept.dropDuplicates(["doc_id", "__hash"]).drop("__hash")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 words or more that stand in an
    earlier one; ``n_chars`` follows the text.  Texts that lose nothing stay as
    they are, a null text stays null."""
    cut = repeats.remove_repeats(docs, min_words=13, keep_layout=True)
    changed = F.col("n_removed") > 0
    cut = cut.withColumn("text", F.when(changed, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, smaller sources repeated (four times at
    most) until the sources' weights have nine tenths of the greatest entropy."""
    planned = mixing.plan(docs, budget_tokens=None, entropy_share=0.9, max_repeats=4.0)
    return mixing.mix(docs, planned).drop("epoch", "block", "pos")


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``ids``, the byte-level BPE ids of the text, and
    ``n_tokens``, their number."""
    return byte_bpe.encode(docs, BYTE_RANKS, public_tokenizers.PATTERN).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", encode_bytes),
]
