"""Registered queries: subscriptions, alerts, search, paging, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from .. import schemas as S
from ..operators import alerts as AL
from ..operators import browse as B
from ..operators import decision as dec
from ..operators import series as ser
from ..session import materialize, scratch_path
from .common import SQL_TS_TEXT, big, ts_text
from .registry import query
from .sql_text import q as sq
from .sql_views import view

view("sub_checked", ["subscription_requests"], """
SELECT *, CASE WHEN email IS NULL OR email = '' OR NOT contains(email, '@') THEN 'invalid_email'
               WHEN target_price IS NULL OR isnan(target_price) OR target_price <= 0 THEN 'invalid_target'
               WHEN product_name IS NULL OR product_name = '' THEN 'missing_product' END AS reason
FROM subscription_requests""")

view("valid_requests", ["sub_checked"], """
SELECT email, product_name, target_price, sub_ts, seq FROM sub_checked WHERE reason IS NULL""")

view("sub_state", ["valid_requests"], """
SELECT email, product_name, arg_max(target_price, (sub_ts, seq)) AS target_price,
       max(sub_ts) AS sub_ts, min(sub_ts) AS first_sub_ts, count(*) AS n_requests, true AS active
FROM valid_requests GROUP BY email, product_name""")


def valid_requests(spark, d):
    good, _ = AL.split_valid(A.subscription_requests(spark, d))
    return good


@query("valid_subscriptions", "P11", ["sub_checked"], """
SELECT email, product_name, seq, reason IS NULL AS valid, reason FROM sub_checked""")
def q_valid_subscriptions(spark, d):
    v = AL.validate_subscriptions(A.subscription_requests(spark, d))
    return v.select("email", "product_name", "seq", "valid", "reason")


@query("subscription_upsert", "D4 S9", ["sub_state"], f"""
SELECT email, product_name, target_price, strftime(sub_ts, '{SQL_TS_TEXT}') AS sub_ts,
       strftime(first_sub_ts, '{SQL_TS_TEXT}') AS first_sub_ts, n_requests, active FROM sub_state""")
def q_subscription_upsert(spark, d):
    st = AL.upsert_state(valid_requests(spark, d))
    return st.select("email", "product_name", "target_price", ts_text("sub_ts").alias("sub_ts"),
                     ts_text("first_sub_ts").alias("first_sub_ts"), big("n_requests").alias("n_requests"),
                     "active")


@query("subscription_store", "S9", ["sub_state"], """
SELECT email, product_name, target_price, active FROM sub_state""")
def q_subscription_store(spark, d):
    """The state written and read back, beside a broken line and a missing store."""
    path = scratch_path(spark, "subscriptions")
    AL.write_subscription_store(AL.upsert_state(valid_requests(spark, d)), path)
    AL.upsert_state(valid_requests(spark, d)).select(F.concat(F.lit('{"email": "'), "email").alias("value")).write.mode("append").text(path)
    return AL.read_subscription_store(spark, path).unionByName(AL.read_subscription_store(spark, f"{path}-missing"))


@query("active_subscribers", "P9 D4", ["sub_state", "price_obs"], """
SELECT s.product_name, s.email FROM sub_state s LEFT JOIN (
  SELECT product_name, arg_max(price, (ts, seq, price)) AS price, max(ts) AS ts FROM price_obs
  WHERE price IS NOT NULL GROUP BY product_name) c ON c.product_name = s.product_name
WHERE s.active AND NOT coalesce(c.price <> 0 AND c.price <= s.target_price AND c.ts >= s.sub_ts, false)""")
def q_active_subscribers(spark, d):
    """Subscriptions still open after the alerts of the current prices went out."""
    ticks = A.price_obs(spark, d)
    state = materialize(AL.upsert_state(valid_requests(spark, d)))
    cur = ticks.where(F.col("price").isNotNull()).groupBy("product_name").agg(
        F.max_by("price", F.struct("ts", "seq", "price")).alias("current_price"), F.max("ts").alias("fired_ts"))
    fired = AL.alerts_due(cur, state).join(cur.select("product_name", "fired_ts"), "product_name")
    return AL.active_subscribers(AL.apply_fired(state, fired))


@query("alerts_due", "J2 F24 A5", ["sub_state", "price_obs", "series"], f"""
SELECT s.email, c.product_name, c.current_price, s.target_price,
       format({sq(AL.ALERT_SUBJECT.replace('%s', '{}'))}, c.product_name) AS subject,
       format({sq(AL.ALERT_BODY.replace('%s', '{}'))}, c.product_name, CAST(c.current_price AS VARCHAR),
              {sq(S.REASON_NOT_ENOUGH)}, 'http://localhost:8000', {sq(AL.ALERT_SENDER)}) AS body
FROM (SELECT product_name, arg_max(price, (ts, seq, price)) AS current_price FROM price_obs
      WHERE price IS NOT NULL GROUP BY product_name) c
JOIN sub_state s ON s.product_name = c.product_name AND c.current_price <= s.target_price
WHERE c.current_price <> 0 AND s.active AND s.target_price IS NOT NULL
  AND c.product_name IN (SELECT product_name FROM series)""")
def q_alerts_due(spark, d):
    ticks = A.price_obs(spark, d)
    # One pass over the ticks: the series' last value is the current price.
    stats = materialize(dec.price_stats(ser.daily_series(ticks)))
    empty = spark.createDataFrame([], "product_name string, positive long, neutral long, negative long, total long")
    reasons = dec.decide(stats, empty).select("product_name", "reason")
    cur = stats.select("product_name", "current_price")
    return AL.alerts_due(cur, AL.upsert_state(valid_requests(spark, d)), reasons)


view("intervals", ["valid_requests"], """
SELECT *, lead(sub_ts) OVER (PARTITION BY email, product_name ORDER BY sub_ts, seq) AS next_sub_ts
FROM valid_requests""")

view("first_fire", ["intervals", "price_obs"], """
SELECT i.email, i.product_name, i.sub_ts, i.seq, i.target_price,
       min(t.ts) AS fire_ts, arg_min(t.price, (t.ts, t.seq)) AS fire_price
FROM intervals i JOIN price_obs t
  ON t.product_name = i.product_name AND t.ts >= i.sub_ts
 AND (i.next_sub_ts IS NULL OR t.ts < i.next_sub_ts) AND t.price <= i.target_price
GROUP BY i.email, i.product_name, i.sub_ts, i.seq, i.target_price""")

FIRE_SQL = f"""
SELECT email, product_name, strftime(sub_ts, '{SQL_TS_TEXT}') AS sub_ts, seq, target_price,
       strftime(fire_ts, '{SQL_TS_TEXT}') AS fire_ts, fire_price FROM first_fire"""


def fire_out(df):
    return df.select("email", "product_name", ts_text("sub_ts").alias("sub_ts"), "seq", "target_price",
                     ts_text("fire_ts").alias("fire_ts"), "fire_price")


@query("alerts_first_fire", "J7 T1", ["first_fire"], FIRE_SQL)
def q_alerts_first_fire(spark, d):
    return fire_out(AL.first_fire(valid_requests(spark, d), A.price_obs(spark, d)))


# ----------------------------------------------------------------- browse

KEYWORD = "ANVIL"
PAGE_TERM = "user_1"
PAGE = 3


def _like_sql(term: str) -> str:
    return " OR ".join(f"coalesce({c} ILIKE {sq('%' + term + '%')}, false)" for c in B.SEARCH_COLUMNS)


@query("search_keyword", "P4", ["observations"], f"""
SELECT seq, product_name, source FROM observations WHERE {_like_sql(KEYWORD)}""")
def q_search_keyword(spark, d):
    return B.search_keyword(A.observations(spark, d), KEYWORD).select("seq", "product_name", "source")


@query("page_counts", "A12", ["observations"], f"""
SELECT count(*) AS total_rows, count(*) FILTER (WHERE {_like_sql(PAGE_TERM)}) AS matched_rows,
       CAST(greatest(1, ceil(count(*) FILTER (WHERE {_like_sql(PAGE_TERM)}) / {S.PAGE_SIZE})) AS BIGINT)
         AS total_pages
FROM observations""")
def q_page_counts(spark, d):
    c = B.page_counts(A.observations(spark, d), PAGE_TERM)
    return c.select(big("total_rows").alias("total_rows"), big("matched_rows").alias("matched_rows"),
                    "total_pages")


@query("paginate", "O3 A12", ["observations"], f"""
SELECT seq, product_name, source, total_rows, page, total_pages FROM (
  SELECT o.seq, o.product_name, o.source, c.n AS total_rows,
         least(greatest({PAGE}, 1), greatest(1, CAST(ceil(c.n / {S.PAGE_SIZE}) AS BIGINT))) AS page,
         greatest(1, CAST(ceil(c.n / {S.PAGE_SIZE}) AS BIGINT)) AS total_pages,
         row_number() OVER (ORDER BY o.seq) AS rn
  FROM (SELECT * FROM observations WHERE {_like_sql(PAGE_TERM)}) o,
       (SELECT count(*) AS n FROM observations WHERE {_like_sql(PAGE_TERM)}) c)
WHERE rn > (page - 1) * {S.PAGE_SIZE} AND rn <= page * {S.PAGE_SIZE}""")
def q_paginate(spark, d):
    hits = B.search_keyword(A.observations(spark, d), PAGE_TERM)
    pg = B.paginate(hits, PAGE, S.PAGE_SIZE, "seq")
    return pg.rows.select("seq", "product_name", "source",
                          F.lit(pg.total_rows).cast("long").alias("total_rows"),
                          F.lit(pg.page).cast("long").alias("page"),
                          F.lit(pg.total_pages).cast("long").alias("total_pages"))


ANY_TERM = "99"


def _customer_csv(spark, d) -> str:
    """S5 input: the customer table landed as a CSV data file."""
    cust = A.table(spark, d, "customer")
    path = scratch_path(spark, "flat") + "/customers.csv"
    cust.write.mode("overwrite").option("header", "true").csv(path)
    return path


@query("search_any_column", "P5 S5", [], f"""
SELECT * FROM customer WHERE {' OR '.join(
    f"coalesce(regexp_matches(CAST({c} AS VARCHAR), '(?i){ANY_TERM}'), false)"
    for c in ['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment'])}""")
def q_search_any_column(spark, d):
    schema = A.table(spark, d, "customer").schema
    df = B.read_flat_file(spark, _customer_csv(spark, d), schema)
    return B.search_any_column(df, ANY_TERM)


@query("search_json_file", "S5 P5", [], f"""
SELECT * FROM customer WHERE {' OR '.join(
    f"coalesce(regexp_matches(CAST({c} AS VARCHAR), '(?i){ANY_TERM}'), false)"
    for c in ['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment'])}""")
def q_search_json_file(spark, d):
    """S5, the JSON leg: the customer table landed as JSON lines."""
    cust = A.table(spark, d, "customer")
    path = scratch_path(spark, "flat") + "/customers.json"
    cust.write.mode("overwrite").json(path)
    return B.search_any_column(B.read_flat_file(spark, path, cust.schema), ANY_TERM)


@query("file_catalog", "S6 U2 O6")
def q_file_catalog(spark, d):
    root = scratch_path(spark, "datafiles")
    A.table(spark, d, "customer").write.mode("overwrite").option("header", "true").csv(f"{root}/customers.csv")
    A.table(spark, d, "orders").write.mode("overwrite").json(f"{root}/archive/orders.json")
    A.table(spark, d, "nation").write.mode("overwrite").parquet(f"{root}/nation.parquet")
    return B.file_catalog(spark, root).select("name", "size")


@query("export_json", "S10", ["observations"], """
SELECT to_json({'timestamp': "timestamp", 'source': source, 'product_name': product_name, 'price': price,
                'rating': rating, 'review_text': review_text, 'url': url, 'metadata': metadata,
                'seq': seq})::VARCHAR AS json
FROM observations""")
def q_export_json(spark, d):
    return B.export_json(A.observations(spark, d))
