"""Brute-force forms that the tests compare with, on small fixtures only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.operators import alerts as AL


def first_fire_naive(requests: DataFrame, ticks: DataFrame) -> DataFrame:
    """Brute-force J7 for checking ``first_fire`` on small fixtures: every
    tick of a product against every interval of that product."""
    iv = AL.subscription_intervals(requests)
    j = iv.join(ticks.withColumnRenamed("seq", "tick_seq"), "product_name").where(
        (F.col("ts") >= F.col("sub_ts")) & (F.col("next_sub_ts").isNull() | (F.col("ts") < F.col("next_sub_ts")))
        & (F.col("price") <= F.col("target_price")))
    first = j.groupBy(*AL.INTERVAL_KEY, "target_price").agg(
        F.min_by(F.struct("ts", "price"), F.struct("ts", "tick_seq")).alias("f"))
    return first.select(*AL.INTERVAL_KEY, "target_price", F.col("f.ts").alias("fire_ts"),
                        F.col("f.price").alias("fire_price"))
