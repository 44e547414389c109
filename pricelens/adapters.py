"""Adapters: the driver's tables viewed as this library's inputs.

The library's operators consume price observations, reviews, raw pages and
subscription requests.  These functions derive those inputs from the shared
test tables with plain projections and joins, so every query's work grows with
the tables (see FIXTURES.md).  Each adapter has a SQL twin in
``pricelens.plans.sql_views`` used by the DuckDB correctness check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S

URL_PREFIX = "https://shop.example.com/p/"
# Reviews have no time of their own; the scrape time is derived from the id.
REVIEW_EPOCH_SECONDS = 1706745600  # 2024-02-01 00:00:00 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _user_product(user_id: Column) -> Column:
    return F.concat(F.lit("user_"), user_id.cast("string"))


def price_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price ticks: one product per event user (``events``)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        _user_product(e.user_id).alias("product_name"),
        e.ts.cast("timestamp").alias("ts"),
        e.value.alias("price"),
        F.concat(F.lit(URL_PREFIX), _user_product(e.user_id)).alias("url"),
        e.event_id.alias("seq"),
    )


def part_price_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long price histories: unit price of each line item, product = part name.

    ``seq`` orders lines shipped on the same day; D2 breaks remaining ties
    on the price itself, so the pick is deterministic.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.select(
        F.col("p_name").alias("product_name"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("price"),
        F.concat(F.lit(URL_PREFIX), F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))).alias("url"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
    )


def review_name_variant(name: Column, k: Column) -> Column:
    """Spellings a listing site shows for one product (for fuzzy matching)."""
    return (F.when(k == 0, name)
            .when(k == 1, F.upper(name))
            .when(k == 2, F.concat(F.lit("Add to Compare"),
                                   F.upper(F.substring(name, 1, 1)), F.substr(name, F.lit(2))))
            .when(k == 3, F.replace(name, F.lit(" "), F.lit("-")))
            .otherwise(F.regexp_replace(name, r"^(\S+) (\S+)$", "$2 $1")))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews: each document is a review of the part with the same key,
    listed under one of five spellings of the part's name."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    j = d.join(p, d.doc_id == p.p_partkey, "left")
    return j.select(
        F.col("doc_id").alias("review_id"),
        F.coalesce(review_name_variant(F.col("p_name"), F.pmod(F.col("doc_id"), F.lit(5))),
                   F.col("source")).alias("product_name"),
        F.col("text").alias("review_text"),
        (F.pmod(F.col("n_chars"), F.lit(5)) + 1).cast("string").alias("rating"),
        F.concat(F.lit("reader_"), F.col("source")).alias("reviewer"),
        F.lit(True).alias("certified"),
        F.timestamp_seconds(F.lit(REVIEW_EPOCH_SECONDS) + F.col("doc_id")).alias("ts"),
        F.col("doc_id").alias("seq"),
        F.col("source").alias("listing"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat observation table (price points and reviews in one table).

    Price timestamps arrive as text in several formats; error events carry
    their payload instead of a time, which the coercion step must drop.
    """
    e = table(spark, sf_dir, "events")
    ts = e.ts.cast("timestamp")
    text_ts = (F.when(e.event_type == "error", e.props)
               .when(e.event_type == "purchase", F.date_format(ts, "yyyy-MM-dd"))
               .when(e.event_type == "click", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
               .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    prices = e.select(
        text_ts.alias("timestamp"),
        F.lit(S.SOURCE_PRICE).alias("source"),
        _user_product(e.user_id).alias("product_name"),
        e.value.alias("price"),
        F.lit(None).cast("string").alias("rating"),
        F.lit(None).cast("string").alias("review_text"),
        F.concat(F.lit(URL_PREFIX), _user_product(e.user_id)).alias("url"),
        F.lit(None).cast("string").alias("metadata"),
        (e.event_id * 2).alias("seq"),
    )
    r = reviews(spark, sf_dir)
    revs = r.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.lit(S.SOURCE_REVIEWS).alias("source"),
        "product_name",
        F.lit(None).cast("double").alias("price"),
        "rating",
        "review_text",
        F.lit(None).cast("string").alias("url"),
        F.to_json(F.struct("reviewer", "certified")).alias("metadata"),
        (F.col("review_id") * 2 + 1).alias("seq"),
    )
    return prices.unionByName(revs)


def subscription_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscribe requests: each sign-up event asks for an alert on the user's
    product at 5 below the price seen then.  Every seventh request carries a
    mistyped address, and low prices give non-positive targets, so the
    validation step has work to do."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    uid = e.user_id.cast("string")
    email = F.when(F.pmod(e.event_id, F.lit(7)) == 0, F.concat(F.lit("u"), uid, F.lit(".example.com"))) \
        .otherwise(F.concat(F.lit("u"), uid, F.lit("@example.com")))
    return e.select(
        email.alias("email"),
        _user_product(e.user_id).alias("product_name"),
        (e.value - 5.0).alias("target_price"),
        e.ts.cast("timestamp").alias("sub_ts"),
        e.event_id.alias("seq"),
    )


def llm_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored classifier replies for labelled documents, two models.

    Model 1 answers in prose around a JSON object; its reply is broken for
    every third document.  Model 2 answers bare JSON with a label outside
    the allowed set for toxic-and-low-quality documents.
    """
    lab = table(spark, sf_dir, "labels")
    label1 = (F.when(lab.toxic == 1, F.lit("NEGATIVE"))
              .when(lab.quality == 1, F.lit("positive"))
              .otherwise(F.lit("Neutral")))
    conf1 = F.when(lab.quality == 1, F.lit("0.9")).otherwise(F.lit("0.6"))
    r1 = F.when(F.pmod(lab.doc_id, F.lit(3)) == 0, F.lit("Sorry, I cannot classify {this}."))\
        .otherwise(F.concat(F.lit('Result: {"sentiment": "'), label1,
                            F.lit('", "confidence": "'), conf1, F.lit('"} done')))
    label2 = (F.when((lab.toxic == 1) & (lab.quality == 0), F.lit("Angry"))
              .when(lab.toxic == 1, F.lit("negative"))
              .otherwise(F.lit("neutral")))
    r2 = F.concat(F.lit('{"sentiment":"'), label2, F.lit('","confidence":0.7}'))
    m1 = lab.select("doc_id", F.lit(1).alias("model_rank"), r1.alias("response_text"))
    m2 = lab.select("doc_id", F.lit(2).alias("model_rank"), r2.alias("response_text"))
    return m1.unionByName(m2).withColumnRenamed("doc_id", "review_id")
