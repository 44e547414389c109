"""Registered queries: price series and price status."""

from __future__ import annotations


from .. import adapters as A
from ..operators import decision as dec
from ..operators import series as ser
from .common import SQL_TS_TEXT, big, iso_date, r6, ts_text
from .registry import query
from .sql_text import rnd


def events_series(spark, d):
    return ser.daily_series(A.price_obs(spark, d))


@query("price_status", "D2 W1 A4 A5 F15", ["series"], f"""
SELECT product_name, {rnd('arg_max(y, ds)', 6)} AS current_price,
       {rnd('quantile_cont(y, 0.5)', 6)} AS median_price, count(*) AS n_days,
       CASE WHEN arg_max(y, ds) <= quantile_cont(y, 0.5) * CAST(1.05 AS DOUBLE)
            THEN 'Good' ELSE 'High' END AS price_status
FROM series GROUP BY product_name""")
def q_price_status(spark, d):
    st = dec.price_stats(events_series(spark, d))
    return st.select("product_name", r6("current_price").alias("current_price"),
                     r6("median_price").alias("median_price"), big("n_days").alias("n_days"),
                     "price_status")


@query("daily_last_price", "D2", ["daily"], f"""
SELECT product_name, strftime(ds, '%Y-%m-%d') AS ds, {rnd('y', 6)} AS y FROM daily""")
def q_daily_last_price(spark, d):
    daily = ser.daily_last_price(A.price_obs(spark, d))
    return daily.select("product_name", iso_date("ds").alias("ds"), r6("y").alias("y"))


@query("daily_series", "D2 W1 O2", ["series"], f"""
SELECT product_name, strftime(ds, '%Y-%m-%d') AS ds, {rnd('y', 6)} AS y FROM series""")
def q_daily_series(spark, d):
    s = ser.in_date_order(events_series(spark, d))
    return s.select("product_name", iso_date("ds").alias("ds"), r6("y").alias("y"))


@query("list_products", "P1 D1 O1", ["observations"], """
SELECT DISTINCT product_name FROM observations
WHERE price IS NOT NULL AND product_name IS NOT NULL ORDER BY product_name""")
def q_list_products(spark, d):
    return ser.list_products(A.observations(spark, d))


@query("coerce_observations", "P6", ["observations"], f"""
SELECT product_name, strftime(ts, '{SQL_TS_TEXT}') AS ts, price, seq FROM (
  SELECT product_name,
         coalesce(try_cast("timestamp" AS TIMESTAMP),
                  try_strptime("timestamp", '%m-%d-%Y %H:%M:%S'), try_strptime("timestamp", '%d-%m-%Y %H:%M:%S'),
                  try_strptime("timestamp", '%m/%d/%Y'), try_strptime("timestamp", '%d/%m/%Y'),
                  try_strptime("timestamp", '%Y/%m/%d %H:%M:%S'), try_strptime("timestamp", '%Y/%m/%d')) AS ts,
         CAST(price AS DOUBLE) AS price, seq
  FROM observations WHERE price IS NOT NULL AND "timestamp" IS NOT NULL)
WHERE ts IS NOT NULL AND price IS NOT NULL""")
def q_coerce_observations(spark, d):
    c = ser.coerce_observations(A.observations(spark, d))
    return c.select("product_name", ts_text("ts").alias("ts"), "price", "seq")


@query("price_points", "P2", ["observations"], """
SELECT product_name, "timestamp", price FROM observations
WHERE price IS NOT NULL AND "timestamp" IS NOT NULL""")
def q_price_points(spark, d):
    return ser.price_points(A.observations(spark, d))


@query("historical_series", "P7 F17 F18", ["series"], f"""
SELECT product_name, strftime(ds, '%Y-%m-%d') AS date, {rnd('y', 2)} AS price FROM series""")
def q_historical_series(spark, d):
    return ser.historical_series(events_series(spark, d))


@query("forecast_eligibility", "P8 M7", ["series"], """
SELECT product_name, count(*) AS n_points,
       CASE WHEN count(*) >= 10 THEN 'ok' ELSE 'too_short' END AS status
FROM series GROUP BY product_name""")
def q_forecast_eligibility(spark, d):
    e = ser.forecast_eligibility(events_series(spark, d))
    return e.select("product_name", big("n_points").alias("n_points"), "status")


@query("train_test_split", "W2", ["split"], f"""
SELECT product_name, strftime(ds, '%Y-%m-%d') AS ds, {rnd('y', 6)} AS y, idx, n,
       CASE WHEN idx < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS fold
FROM split""")
def q_train_test_split(spark, d):
    t = ser.train_test_split(events_series(spark, d))
    return t.select("product_name", iso_date("ds").alias("ds"), r6("y").alias("y"),
                    big("idx").alias("idx"), big("n").alias("n"), "fold")


@query("future_calendar", "W5", ["series"], """
SELECT product_name, h, strftime(CAST(last_ds + CAST(h AS INTEGER) AS DATE), '%Y-%m-%d') AS ds
FROM (SELECT product_name, max(ds) AS last_ds FROM series GROUP BY product_name),
     range(1, 31) r(h)""")
def q_future_calendar(spark, d):
    f = ser.future_calendar(events_series(spark, d), 30)
    return f.select("product_name", big("h").alias("h"), iso_date("ds").alias("ds"))
