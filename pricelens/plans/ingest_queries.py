"""Registered queries: the observation store and page ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .. import adapters as A
from .. import schemas as S
from ..functions import text as T
from ..operators import reviews as R
from ..session import scratch_path
from ..sources import price_pages as PP
from ..sources import review_pages as RP
from ..sources import store as ST
from . import landing as L
from .common import big
from .registry import query
from .sql_text import q as sq
from .sql_views import view

ALL_COLS = "\"timestamp\", source, product_name, price, rating, review_text, url, metadata, seq"


def _price_rows(spark, d):
    obs = A.observations(spark, d)
    return obs.where(F.col("source") == S.SOURCE_PRICE)


def _review_rows(spark, d):
    obs = A.observations(spark, d)
    return obs.where(F.col("source") == S.SOURCE_REVIEWS)


@query("scan_observations", "S1 S2 U1", ["observations"], f"SELECT {ALL_COLS} FROM observations")
def q_scan_observations(spark, d):
    path = scratch_path(spark, "store")
    ST.append_observations(_price_rows(spark, d).drop("rating", "review_text", "metadata"), path)
    ST.append_observations(_review_rows(spark, d).drop("price", "url"), path)
    return ST.scan_observations(spark, path)


@query("append_observations", "S2 U1", ["observations"], f"""
SELECT {ALL_COLS} FROM observations
UNION ALL SELECT {ALL_COLS} FROM observations WHERE source = 'flipkart_price_history'""")
def q_append_observations(spark, d):
    path = scratch_path(spark, "store")
    prices = _price_rows(spark, d).drop("rating", "review_text", "metadata")
    ST.append_observations(prices, path)
    ST.append_observations(_review_rows(spark, d).drop("price", "url"), path)
    ST.append_observations(prices.limit(0), path)          # empty batch: no-op
    ST.append_observations(prices, path)                   # same page again: no dedup
    return ST.scan_observations(spark, path)


@query("review_source", "P3 S1", ["observations"], """
SELECT seq, product_name, rating, review_text FROM observations WHERE source = 'flipkart_reviews'""")
def q_review_source(spark, d):
    """The review rows of a stored table: the source filter prunes the other source's folder."""
    path = scratch_path(spark, "store")
    ST.append_observations(A.observations(spark, d), path)
    return R.review_sources(ST.scan_observations(spark, path)).select("seq", "product_name", "rating", "review_text")


@query("schema_align", "S3", ["observations"], f"""
SELECT {ALL_COLS} FROM observations WHERE source = 'flipkart_reviews'""")
def q_schema_align(spark, d):
    r = A.reviews(spark, d)
    partial = r.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.lit(S.SOURCE_REVIEWS).alias("source"), "product_name", "rating", "review_text",
        F.struct("reviewer", "certified").alias("metadata"),
        (F.col("review_id") * 2 + 1).alias("seq"), "listing")
    return ST.align_to_schema(partial)


CSV_SCHEMA = StructType([StructField("Date", StringType()), StructField("Source", StringType()),
                         StructField("Product", StringType()), StructField("Price", DoubleType()),
                         StructField("Seq", LongType())])


@query("csv_replace_load", "S4 A13", ["observations"], """
SELECT "timestamp", source, product_name, price, rating, review_text, CAST(NULL AS VARCHAR) AS url, metadata, seq
FROM observations WHERE source = 'flipkart_price_history'""")
def q_csv_replace_load(spark, d):
    root = scratch_path(spark, "csvload")
    src = _price_rows(spark, d).select(F.col("timestamp").alias("Date"), F.col("source").alias("Source"),
                                       F.col("product_name").alias("Product"), F.col("price").alias("Price"),
                                       F.col("seq").alias("Seq"))
    src.write.option("header", "true").option("escape", "\"").csv(f"{root}/prices.csv")
    return ST.csv_replace_load(spark, f"{root}/prices.csv", f"{root}/table",
                               {"Date": "timestamp", "Source": "source", "Product": "product_name",
                                "Price": "price", "Seq": "seq"}, CSV_SCHEMA)


# ------------------------------------------------------------ price pages

def landed_price_pages(spark, d):
    """Driver pages plus price pages landed from the ticks."""
    return L.price_pages(A.price_obs(spark, d)).unionByName(A.table(spark, d, "pages"))


view("price_page_urls", ["price_obs"], f"""
SELECT DISTINCT product_name, '{PP.PAGE_URL_PREFIX}' || product_name || '/' || strftime(ts, '%Y%m') AS url
FROM price_obs""")


@query("decode_price_pages", "S7 F10 F11", ["price_obs"], """
SELECT product_name, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS "timestamp", price, false AS price_defaulted
FROM price_obs""")
def q_decode_price_pages(spark, d):
    rows, _ = PP.decode_price_pages(landed_price_pages(spark, d))
    return rows.select("product_name", "timestamp", "price", "price_defaulted")


def _status_sql(url: str, html: str) -> str:
    cipher = f"regexp_extract({html}, {sq(S.PRICE_DATASET_PATTERN)}, 1)"
    key = f"regexp_extract({html}, {sq(S.PRICE_KEY_PATTERN)}, 1)"
    return (f"CASE WHEN NOT coalesce(contains({url}, {sq(S.PRICE_HOST)}), false) THEN 'invalid_url' "
            f"WHEN {cipher} = '' THEN 'no_data' WHEN {key} = '' THEN 'no_key' ELSE 'ok' END")


@query("page_ingest_status", "S11", ["price_page_urls"], f"""
SELECT url, 'ok' AS status FROM price_page_urls
UNION ALL SELECT url, {_status_sql('url', 'html')} FROM pages""")
def q_page_ingest_status(spark, d):
    return PP.page_status(landed_price_pages(spark, d)).select("url", "status")


def _title_sql(html: str) -> str:
    t = f"regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title>', 1)"
    cp = ("(CASE WHEN lower(substr(r, 3, 1)) = 'x' THEN CAST(('0x' || substr(r, 4, length(r) - 4)) AS BIGINT) "
          "ELSE CAST(substr(r, 3, length(r) - 3) AS BIGINT) END)")
    printable = f"(({cp} BETWEEN 32 AND 126) OR ({cp} BETWEEN 160 AND 55295) OR ({cp} BETWEEN 57344 AND 1114111))"
    refs = f"regexp_extract_all({t}, {sq(T.NUMERIC_REF)}, 0)"
    first_seen = f"list_filter({refs}, lambda x, i: list_position({refs}, x) = i)"
    t = (f"list_reduce({first_seen}, "
         f"lambda acc, r: CASE WHEN {printable} THEN replace(acc, r, chr(CAST({cp} AS INTEGER))) ELSE acc END, {t})")
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = f"replace({t}, {sq(ent)}, {sq(ch)})"
    t = f"replace({t}, {sq(S.TITLE_SUFFIX)}, '')"
    ws = "[ \\t\\n\\r\\f\\x{0B}]"
    t = f"regexp_replace({t}, '^{ws}+|{ws}+$', '', 'g')"
    return (f"CASE WHEN regexp_matches({html}, '(?is)<title[^>]*>.*?</title>') THEN {t} "
            f"ELSE {sq(S.DEFAULT_PRICE_PRODUCT)} END")


@query("title_product_name", "F11", ["price_page_urls"], f"""
SELECT url, product_name FROM price_page_urls
UNION ALL SELECT url, {_title_sql('html')} FROM pages""")
def q_title_product_name(spark, d):
    p = landed_price_pages(spark, d)
    return p.select("url", T.title_product_name(F.col("html")).alias("product_name"))


@query("url_page_number", "S8c", [], r"""
SELECT page_id, regexp_replace(url, '&page=\d+', '', 'g') AS base_url,
       CASE WHEN regexp_extract(url, '[?&]page=(\d+)', 1) = '' THEN NULL
            ELSE CAST(regexp_extract(url, '[?&]page=(\d+)', 1) AS INTEGER) END AS page
FROM pages""")
def q_url_page_number(spark, d):
    p = RP.page_numbers(A.table(spark, d, "pages"))
    return p.select("page_id", "base_url", "page")


# ----------------------------------------------------------- review pages

def review_pages(spark, d):
    return L.review_pages(A.reviews(spark, d))


view("review_page_rows", ["reviews"], f"""
SELECT *, 2 * CAST(review_id // {L.PAGE_IDS} AS INTEGER) + 1 AS page, min(review_id) OVER (PARTITION BY listing, review_id // {L.PAGE_IDS}) AS page_id,
       (length(listing) + review_id // {L.PAGE_IDS}) % {L.EMPTY_EVERY} = {L.EMPTY_EVERY - 1} AS empty_follows
FROM reviews""")


def _slug_sql(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g')"


@query("first_product_link", "S8e", ["review_page_rows"], f"""
SELECT 'landed' AS kind, page_id, NULL AS product_link, NULL AS reviews_link, 'Product' AS title FROM pages
UNION ALL
SELECT 'review', page_id + extra, '/p/' || {_slug_sql('product_name')}, '/product-reviews/' || {_slug_sql('product_name')},
       CASE WHEN product_name = '' THEN 'Product'
            ELSE replace(replace(replace(product_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END
FROM review_page_rows, (SELECT unnest([0, {L.EMPTY_PAGE_ID}]) AS extra) WHERE review_id = page_id AND (extra = 0 OR empty_follows)""")
def q_first_product_link(spark, d):
    landed = A.table(spark, d, "pages").withColumn("kind", F.lit("landed"))
    rev = review_pages(spark, d).withColumn("kind", F.lit("review"))
    html = F.col("html")
    return landed.unionByName(rev).select(
        "kind", "page_id", PP.first_link(html, "/p/").alias("product_link"),
        PP.first_link(html, "/product-reviews/").alias("reviews_link"),
        RP.product_title(html).alias("title"))


def _card_sql() -> str:
    """The S8 rules for the layout of the landed pages (title, body and READ
    MORE, reviewer, badge, relative date; the first card repeated)."""
    ws = T.WHITESPACE_CLASS
    strip = lambda x: f"regexp_replace({x}, '^{ws}|{ws}$', '', 'g')"
    edge_l, edge_r = T.WORD_EDGE_L, T.WORD_EDGE_R
    noise = (lambda x: f"(regexp_matches({x}, {sq(edge_l + 'ago' + edge_r)}) OR "
             f"regexp_matches({x}, {sq(edge_l + S.MONTH_PATTERN + edge_r)}) OR regexp_full_match({x}, '[0-9,]+'))")
    ok = (lambda x: f"({x} <> '' AND {x} NOT IN ('READ MORE', 'Certified Buyer', rating) AND NOT {noise(x)} "
          f"AND length({x}) > 1)")
    return f"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY first_id) - 1 AS INTEGER) AS card_no, rating, title, body, reviewer
FROM (SELECT page_id, rating, title, body, reviewer, min(review_id) AS first_id FROM (
SELECT page_id, review_id, rating, title, {strip("replace(body, 'READ MORE', '')")} AS body,
       coalesce(list_filter([t, rv], lambda y: y <> '' AND length(y) < 40
                AND y NOT IN ('READ MORE', 'Certified Buyer', rating, title, body) AND NOT {noise('y')})[1], '')
         AS reviewer
FROM (
  SELECT *, coalesce(list_filter(texts, lambda x: x <> body AND length(x) < 100)[1], '') AS title
  FROM (
    SELECT *, list_reduce(texts, lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END) AS body
    FROM (
      SELECT *, list_filter(cand, lambda x, i: list_position(cand, x) = i) AS texts
      FROM (
        SELECT page_id, review_id, rating, reviewer AS rv,
               {strip("split_part(review_text, chr(10), 1)")} AS t,
               [x FOR x IN [{strip("split_part(review_text, chr(10), 1)")},
                            {strip("review_text")} || 'READ MORE', reviewer] IF {ok('x')}] AS cand
        FROM review_page_rows)
      WHERE len(cand) > 0))))
GROUP BY page_id, rating, title, body, reviewer)"""


@query("extract_reviews", "S8 D3 D5 O8 F22", ["review_page_rows"], _card_sql())
def q_extract_reviews(spark, d):
    pages = review_pages(spark, d).unionByName(A.table(spark, d, "pages").select(
        (F.col("page_id") + F.lit(-1_000_000)).alias("page_id"), "url", "html"))
    return RP.extract_reviews(pages).select("page_id", "card_no", "rating", "title", "body", "reviewer")


@query("pages_until_empty", "S8b S8c", ["review_page_rows"], f"""
SELECT base_url, page, n_reviews FROM (
  SELECT *, min(CASE WHEN n_reviews = 0 THEN page END) OVER (PARTITION BY base_url) AS first_empty FROM (
    SELECT '{L.REVIEW_URL}' || listing || '?sort=id' AS base_url, page,
           CAST(count(*) + 1 AS INTEGER) AS n_reviews
    FROM review_page_rows GROUP BY listing, page
    UNION ALL SELECT DISTINCT '{L.REVIEW_URL}' || listing || '?sort=id', page + 1, 0 FROM review_page_rows WHERE empty_follows))
WHERE first_empty IS NULL OR page < first_empty""")
def q_pages_until_empty(spark, d):
    p = RP.page_numbers(review_pages(spark, d)).withColumn("n_reviews", RP.anchor_count(F.col("html")))
    return RP.pages_until_empty(p).select("base_url", "page", "n_reviews")


@query("review_text", "F12 F13", ["reviews"], """
SELECT review_id,
       CASE WHEN t <> '' THEN t || ' - ' || review_text ELSE review_text END AS review_text,
       to_json({'reviewer': reviewer, 'certified': certified})::VARCHAR AS metadata
FROM (SELECT *, CASE WHEN length(split_part(review_text, chr(10), 1)) < 100
                     THEN split_part(review_text, chr(10), 1) ELSE '' END AS t FROM reviews)""")
def q_review_text(spark, d):
    r = A.reviews(spark, d)
    first = F.substring_index("review_text", "\n", 1)
    title = F.when(F.length(first) < 100, first).otherwise(F.lit(""))
    return r.select("review_id", RP.review_text(title, F.col("review_text")).alias("review_text"),
                    RP.review_metadata(F.col("reviewer"), F.col("certified")).alias("metadata"))


@query("clean_text", "F14", [], f"""
SELECT doc_id, coalesce(trim(regexp_replace(text, '{T.WHITESPACE_CLASS}', ' ', 'g')), '') AS text
FROM documents""")
def q_clean_text(spark, d):
    docs = A.table(spark, d, "documents")
    return docs.select("doc_id", T.clean_text(F.col("text")).alias("text"))


def _noise_sql(x: str) -> str:
    edge_l, edge_r = T.WORD_EDGE_L, T.WORD_EDGE_R
    return (f"(coalesce({x} IN ({sq(S.READ_MORE)}, {sq(S.CERTIFIED_BUYER)}) "
            f"OR regexp_matches({x}, {sq(edge_l + 'ago' + edge_r)}) "
            f"OR regexp_matches({x}, {sq(edge_l + S.MONTH_PATTERN + edge_r)}) "
            f"OR regexp_matches({x}, '^[0-9,]+$') OR length({x}) <= 1, true))")


@query("noise_text_filter", "F22", [], f"""
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines,
       CAST(len(list_filter(ls, lambda x: {_noise_sql('x')})) AS BIGINT) AS n_noise
FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)""")
def q_noise_text_filter(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("ls"))
    return docs.select("doc_id", big(F.size("ls")).alias("n_lines"),
                       big(F.size(F.filter("ls", lambda x: T.is_noise_text(x)))).alias("n_noise"))


@query("dedup_reviews", "D3", ["reviews"], """
SELECT DISTINCT listing, rating, reviewer, review_text FROM reviews""")
def q_dedup_reviews(spark, d):
    r = A.reviews(spark, d).select("listing", "rating", "reviewer", "review_text")
    return r.dropDuplicates()
