"""Price series: coercion, product list, daily last price, gap-free daily
series, train/test split, future calendar, history gate.

All functions take and return DataFrames for *all* products at once; a
product filter, when given, is a plain predicate that Catalyst pushes to the
Parquet scan.

Plan shape at scale: D2 is a partial+final hash aggregate keyed by
(product, day), so the raw ticks are pre-aggregated map-side before the
only big shuffle; everything after D2 works on one row per product-day.
W1/W2 then shuffle those small rows once by product.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S

# Text formats tried after the ISO cast rules (each row parsed on its own).
# An ambiguous day and month read month first; day first where the month would be over 12.
EXTRA_TS_FORMATS = ["MM-dd-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "MM-dd-yyyy", "dd-MM-yyyy",
                    "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd"]


def _product_filter(df: DataFrame, products: Iterable[str] | str | None) -> DataFrame:
    if products is None:
        return df
    if isinstance(products, str):
        return df.where(F.col("product_name") == F.lit(products))
    return df.where(F.col("product_name").isin(list(products)))


def parse_timestamp(text: Column, formats: Iterable[str] = EXTRA_TS_FORMATS) -> Column:
    """Text -> timestamp; unparseable text -> NULL (never an error)."""
    return F.coalesce(F.try_to_timestamp(text),
                      *[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def coerce_observations(obs: DataFrame, products=None) -> DataFrame:
    """Price rows with a parseable time and a numeric price.

    Output ``(product_name, ts, price, seq)``; rows whose time or price
    cannot be read are dropped.
    """
    df = _product_filter(obs, products).where(
        F.col("price").isNotNull() & F.col("timestamp").isNotNull())
    out = df.select(
        "product_name",
        parse_timestamp(F.col("timestamp")).alias("ts"),
        F.col("price").try_cast("double").alias("price"),
        "seq",
    )
    return out.where(F.col("ts").isNotNull() & F.col("price").isNotNull())


def price_points(obs: DataFrame, products=None) -> DataFrame:
    """Raw (timestamp, price) points with both present.  With a product
    name this is the point lookup; the predicate reaches the scan."""
    df = _product_filter(obs, products)
    return df.where(F.col("price").isNotNull() & F.col("timestamp").isNotNull()) \
        .select("product_name", "timestamp", "price")


def list_products(obs: DataFrame) -> DataFrame:
    """Distinct products that have a price, in code-point order."""
    return (obs.where(F.col("price").isNotNull() & F.col("product_name").isNotNull())
            .select("product_name").distinct().orderBy("product_name"))


def daily_last_price(prices: DataFrame, products=None) -> DataFrame:
    """The last price recorded on each day, per product.

    Input ``(product_name, ts, price, seq)``.  "Last" orders by time, then
    ingest sequence, then price (so exact duplicates resolve the same way
    everywhere).  Partial aggregation runs before the shuffle.
    """
    df = _product_filter(prices, products).where(
        F.col("ts").isNotNull() & F.col("price").isNotNull())
    return df.groupBy("product_name", F.to_date("ts").alias("ds")).agg(
        F.max_by("price", F.struct("ts", "seq", "price")).alias("y"))


def densify(daily: DataFrame) -> DataFrame:
    """One row per product and day from first to last day; a missing
    day carries the previous day's value (forward fill).

    Each day row expands to itself plus the missing days up to the next
    observed day, so no calendar join and no second fill pass is needed.
    """
    w = Window.partitionBy("product_name").orderBy("ds")
    last_fill = F.coalesce(F.date_sub(F.col("next_ds"), 1), F.col("ds"))
    return (daily.withColumn("next_ds", F.lead("ds").over(w))
            .select("product_name", F.explode(F.sequence("ds", last_fill)).alias("ds"), "y"))


def daily_series(prices: DataFrame, products=None) -> DataFrame:
    """D2 + W1: gap-free daily series ``(product_name, ds, y)``."""
    return densify(daily_last_price(prices, products))


def in_date_order(series: DataFrame) -> DataFrame:
    """O2: the series by product and date, for output: a range sort, so a
    product of any length may lie in several sorted partitions."""
    return series.orderBy("product_name", "ds")


def with_position(series: DataFrame) -> DataFrame:
    """Adds ``idx`` (0-based day number) and ``n`` (days in the series).

    One window with a single sort serves both columns.
    """
    w = Window.partitionBy("product_name").orderBy("ds")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return series.select("*", (F.row_number().over(w) - 1).alias("idx"),
                         F.count(F.lit(1)).over(whole).alias("n"))


def train_test_split(series: DataFrame, train_fraction: float = S.TRAIN_FRACTION) -> DataFrame:
    """First ``int(n * 0.8)`` days are ``train``, the rest ``test``."""
    pos = with_position(series)
    split = F.floor(F.col("n") * F.lit(float(train_fraction)))
    return pos.withColumn("fold", F.when(F.col("idx") < split, F.lit("train")).otherwise(F.lit("test")))


def future_calendar(series: DataFrame, periods: int = S.DEFAULT_PERIODS) -> DataFrame:
    """The ``periods`` days after each product's last day, with ``h``
    = 1..periods."""
    last = series.groupBy("product_name").agg(F.max("ds").alias("last_ds"))
    return last.select(
        "product_name",
        F.posexplode(F.sequence(F.date_add("last_ds", 1), F.date_add("last_ds", periods))).alias("h0", "ds"),
    ).select("product_name", (F.col("h0") + 1).alias("h"), "ds")


def historical_series(series: DataFrame) -> DataFrame:
    """The history as date text and price to 2 places."""
    return series.select("product_name", F.date_format("ds", "yyyy-MM-dd").alias("date"),
                         F.round("y", 2).alias("price"))


def forecast_eligibility(series: DataFrame, min_points: int = S.MIN_HISTORY_POINTS,
                         requested: DataFrame | None = None) -> DataFrame:
    """Products with fewer than ``min_points`` daily rows are rejected
    (``too_short``).  With ``requested`` (a ``product_name`` column), names
    without any price row are reported as ``not_found``."""
    n = series.groupBy("product_name").agg(F.count(F.lit(1)).alias("n_points"))
    if requested is not None:
        n = requested.select("product_name").distinct().join(n, "product_name", "left")
    status = (F.when(F.col("n_points").isNull(), F.lit("not_found"))
              .when(F.col("n_points") >= min_points, F.lit("ok")).otherwise(F.lit("too_short")))
    return n.withColumn("status", status)
