"""Price status and the buy-or-wait decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


def price_stats(series: DataFrame) -> DataFrame:
    """A4/A5/F15 per product over the daily (filled) series:
    current price = last day's value, exact median, Good/High status."""
    agg = series.groupBy("product_name").agg(
        F.max_by("y", "ds").alias("current_price"),
        F.median("y").alias("median_price"),
        F.count(F.lit(1)).alias("n_days"),
    )
    status = F.when(F.col("current_price") <= F.col("median_price") * F.lit(S.GOOD_PRICE_FACTOR),
                    F.lit("Good")).otherwise(F.lit("High"))
    return agg.withColumn("price_status", status)


def decide(price: DataFrame, sentiment: DataFrame,
           min_reviews: int = S.MIN_REVIEWS_FOR_DECISION) -> DataFrame:
    """J3 + F16: full outer join of per-product price stats and review
    counts; a product with either side alone is still answered.

    ``price``: ``(product_name, current_price, median_price, price_status)``.
    ``sentiment``: ``(product_name, positive, neutral, negative, total)``.
    """
    j = price.join(sentiment, "product_name", "full_outer")
    total = F.coalesce(F.col("total"), F.lit(0))
    pos = F.coalesce(F.col("positive"), F.lit(0))
    ratio = F.when(total > 0, pos / total).otherwise(F.lit(0.0))
    status = F.coalesce(F.col("price_status"), F.lit("Unknown"))
    has_prices = F.col("price_status").isNotNull()
    good, high = status == "Good", status == "High"
    cut = F.lit(S.POSITIVE_RATIO_CUT)
    enough = (total >= min_reviews) & has_prices
    decision = F.when(enough & good & (ratio >= cut), F.lit("Buy Now")).otherwise(F.lit("Wait"))
    reason = (F.when(~enough, F.lit(S.REASON_NOT_ENOUGH))
              .when(good & (ratio >= cut), F.lit(S.REASON_BUY))
              .when(high & (ratio >= cut), F.lit(S.REASON_HIGH_POSITIVE))
              .when(good & (ratio < cut), F.lit(S.REASON_GOOD_MIXED))
              .otherwise(F.lit(S.REASON_POOR)))
    # A current price of 0 is reported as missing, as in the original.
    current = F.when(F.col("current_price") != 0, F.col("current_price"))
    return j.select(
        "product_name",
        decision.alias("decision"),
        reason.alias("reason"),
        pos.cast("long").alias("positive"),
        F.coalesce(F.col("neutral"), F.lit(0)).cast("long").alias("neutral"),
        F.coalesce(F.col("negative"), F.lit(0)).cast("long").alias("negative"),
        current.alias("current_price"),
        ratio.alias("positive_ratio"),
        status.alias("price_status"),
    )
