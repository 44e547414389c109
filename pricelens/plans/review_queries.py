"""Registered queries: names, review text, matching, distributions, decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from .. import schemas as S
from ..functions import text as T
from ..operators import alerts as AL
from ..operators import decision as dec
from ..operators import reviews as R
from ..operators import series as ser
from . import sql_text as X
from .common import big, r6
from .registry import query
from ..session import materialize
from .sql_views import DRIVER_NEGATIVE, DRIVER_POSITIVE, view


def analyzed_reviews(spark, d):
    """F9 over all reviews: stored replies first, driver lexicon fallback."""
    return R.analyze_reviews(A.reviews(spark, d), A.llm_responses(spark, d),
                             positive=DRIVER_POSITIVE, negative=DRIVER_NEGATIVE)


def part_targets(spark, d):
    return A.table(spark, d, "part").select(F.col("p_name").alias("product_name"))


def part_matched(spark, d):
    return R.match_reviews(part_targets(spark, d), A.reviews(spark, d))


def part_label_counts(spark, d, by):
    """Counts of every matched review by a label, for each part name."""
    pairs = R.match_names(part_targets(spark, d), A.reviews(spark, d))
    return R.counts_by_target(R.label_counts(analyzed_reviews(spark, d), [by]), pairs)


@query("normalize_name", "F1", ["reviews"], f"""
SELECT review_id, product_name, {X.norm('product_name', True)} AS norm_review,
       {X.norm('product_name', False)} AS norm_target FROM reviews""")
def q_normalize_name(spark, d):
    r = A.reviews(spark, d)
    return r.select("review_id", "product_name",
                    T.normalize_name(F.col("product_name"), True).alias("norm_review"),
                    T.normalize_name(F.col("product_name"), False).alias("norm_target"))


@query("tokenize_name", "F2", ["reviews"], f"""
SELECT review_id, product_name, array_to_string(tk, '|') AS tokens, CAST(len(tk) AS BIGINT) AS n_tokens
FROM (SELECT review_id, product_name, {X.tokens('product_name')} AS tk FROM reviews)""")
def q_tokenize_name(spark, d):
    r = A.reviews(spark, d).withColumn("tk", T.name_tokens(F.col("product_name")))
    return r.select("review_id", "product_name", F.array_join("tk", "|").alias("tokens"),
                    big(F.size("tk")).alias("n_tokens"))


@query("token_overlap", "U4 F3", ["reviews"], f"""
SELECT review_id, CAST(len(list_intersect(a, b)) AS BIGINT) AS n_common,
       CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS BIGINT) AS n_target_only,
       CAST(len(list_filter(b, lambda x: NOT list_contains(a, x))) AS BIGINT) AS n_review_only,
       {X.overlap_ok('a', 'b')} AS overlap_ok
FROM (SELECT r.review_id, {X.tokens('p.p_name')} AS a, {X.tokens('r.product_name')} AS b
      FROM reviews r JOIN part p ON r.review_id = p.p_partkey)""")
def q_token_overlap(spark, d):
    r = A.reviews(spark, d)
    p = A.table(spark, d, "part")
    j = r.join(p, r.review_id == p.p_partkey).select(
        "review_id", T.name_tokens(F.col("p_name")).alias("a"), T.name_tokens(F.col("product_name")).alias("b"))
    return j.select("review_id",
                    big(F.size(F.array_intersect("a", "b"))).alias("n_common"),
                    big(F.size(F.array_except("a", "b"))).alias("n_target_only"),
                    big(F.size(F.array_except("b", "a"))).alias("n_review_only"),
                    T.tokens_overlap("a", "b").alias("overlap_ok"))


@query("detect_category", "F4", ["reviews"], f"""
SELECT review_id, {X.category('review_text')} AS category FROM reviews""")
def q_detect_category(spark, d):
    r = A.reviews(spark, d).withColumn("_low", F.lower("review_text"))
    return r.select("review_id", T.detect_category(F.col("review_text"), lowered=F.col("_low")).alias("category"))


@query("rule_sentiment", "F5", ["reviews"], f"""
SELECT review_id, {X.rule_label('review_text')} AS label, {X.rule_conf('review_text')} AS confidence,
       {X.rule_label('review_text', DRIVER_POSITIVE, DRIVER_NEGATIVE)} AS label_driver,
       CAST({X.score('review_text', DRIVER_POSITIVE, DRIVER_NEGATIVE)} AS BIGINT) AS score_driver
FROM reviews""")
def q_rule_sentiment(spark, d):
    t = F.col("review_text")
    r = A.reviews(spark, d).withColumn("_low", F.lower(t))
    r = r.withColumns({"_s0": T.sentiment_score(t, lowered=F.col("_low")),
                       "_s1": T.sentiment_score(t, DRIVER_POSITIVE, DRIVER_NEGATIVE, lowered=F.col("_low"))})
    dflt, drv = T.rule_from_score(t, F.col("_s0")), T.rule_from_score(t, F.col("_s1"))
    return r.select("review_id", dflt["label"].alias("label"), dflt["confidence"].alias("confidence"),
                    drv["label"].alias("label_driver"), big(F.col("_s1")).alias("score_driver"))


@query("parse_llm_label", "F6", ["llm_parsed"], """
SELECT review_id, CAST(model_rank AS BIGINT) AS model_rank, label, confidence FROM llm_parsed""")
def q_parse_llm_label(spark, d):
    resp = A.llm_responses(spark, d)
    p = resp.select("review_id", "model_rank", T.parse_llm_label(F.col("response_text")).alias("p"))
    return p.select("review_id", big("model_rank").alias("model_rank"),
                    F.col("p.label").alias("label"), F.col("p.confidence").alias("confidence"))


@query("sentiment_cascade", "F7", ["reviews", "llm_best"], f"""
SELECT r.review_id, coalesce(b.label, {X.rule_label('r.review_text')}) AS sentiment,
       CASE WHEN b.label IS NOT NULL THEN b.confidence ELSE {X.rule_conf('r.review_text')} END AS confidence
FROM reviews r LEFT JOIN llm_best b ON r.review_id = b.review_id""")
def q_sentiment_cascade(spark, d):
    a = R.analyze_reviews(A.reviews(spark, d), A.llm_responses(spark, d))
    return a.select("review_id", "sentiment", "confidence")


@query("analyze_reviews", "F8 F9", ["analyzed"], f"""
SELECT review_id, product_name, sentiment, {X.rnd('confidence', 6)} AS confidence, category FROM analyzed""")
def q_analyze_reviews(spark, d):
    a = analyzed_reviews(spark, d)
    return a.select("review_id", "product_name", "sentiment", r6("confidence").alias("confidence"), "category")


KEPT_CATEGORY = "Archived"

view("labelled_reviews", ["reviews"], f"""
SELECT review_id, CASE WHEN rating IN ('4', '5') THEN 'Positive' END AS old_sentiment, 0.5 AS old_confidence,
       CASE WHEN rating = '5' THEN {X.q(KEPT_CATEGORY)} END AS old_category FROM reviews""")


@query("labels_kept", "F8", ["analyzed", "labelled_reviews"], f"""
SELECT a.review_id, CASE WHEN l.old_category IS NOT NULL THEN l.old_sentiment ELSE a.sentiment END AS sentiment,
       CASE WHEN l.old_category IS NOT NULL THEN CAST(l.old_confidence AS DOUBLE) ELSE {X.rnd('a.confidence', 6)} END AS confidence,
       CASE WHEN l.old_category IS NOT NULL THEN l.old_category ELSE a.category END AS category
FROM analyzed a JOIN labelled_reviews l ON l.review_id = a.review_id""")
def q_labels_kept(spark, d):
    """Reviews that come with labels: five stars with both (kept), four stars
    without a category (labelled anew), the others with none."""
    labelled = A.reviews(spark, d).withColumns({
        "sentiment": F.when(F.col("rating").isin("4", "5"), "Positive"), "confidence": F.lit(0.5),
        "category": F.when(F.col("rating") == "5", KEPT_CATEGORY)})
    a = R.analyze_reviews(labelled, A.llm_responses(spark, d), positive=DRIVER_POSITIVE, negative=DRIVER_NEGATIVE)
    return a.select("review_id", "sentiment", r6("confidence").alias("confidence"), "category")


@query("match_reviews", "J1 P3", ["part_matched"], """
SELECT product_name, review_id, review_product FROM part_matched""")
def q_match_reviews(spark, d):
    return part_matched(spark, d).select("product_name", "review_id", "review_product")


@query("top100_reviews", "O4", ["part_top100"], """
SELECT product_name, review_id FROM part_top100""")
def q_top100_reviews(spark, d):
    return R.first_per_product(part_matched(spark, d), S.MAX_REVIEWS_ANALYSED).select("product_name", "review_id")


@query("top100_of_rating", "O4", ["reviews"], """
SELECT rating, review_id FROM reviews QUALIFY row_number() OVER (PARTITION BY rating ORDER BY seq) <= 100""")
def q_top100_of_rating(spark, d):
    """The limit where it bites: a rating has far more than a hundred reviews."""
    return R.first_per_product(A.reviews(spark, d), S.MAX_REVIEWS_ANALYSED, key="rating").select("rating", "review_id")


@query("sample_reviews", "O5", ["part_matched"], """
SELECT product_name, review_id FROM part_matched
QUALIFY row_number() OVER (PARTITION BY product_name ORDER BY seq) <= 10""")
def q_sample_reviews(spark, d):
    return R.first_per_product(part_matched(spark, d), S.SAMPLE_REVIEWS).select("product_name", "review_id")


@query("sentiment_distribution", "A1", ["part_sentiment"], """
SELECT product_name, positive, neutral, negative, total FROM part_sentiment""")
def q_sentiment_distribution(spark, d):
    c = R.sentiment_totals(part_label_counts(spark, d, "sentiment"))
    return c.select("product_name", *[big(x).alias(x) for x in ("positive", "neutral", "negative", "total")])


@query("category_distribution", "A2", ["part_matched_analyzed"], """
SELECT product_name, category, CAST(count(*) AS BIGINT) AS n FROM part_matched_analyzed
GROUP BY product_name, category""")
def q_category_distribution(spark, d):
    c = part_label_counts(spark, d, "category")
    return c.select("product_name", "category", big("n").alias("n"))


@query("positive_ratio", "A3 F20", ["part_sentiment"], f"""
SELECT product_name, total, {X.rnd('CASE WHEN total > 0 THEN positive / total ELSE 0.0 END', 6)} AS positive_ratio,
       CAST({X.rnd('(CASE WHEN total > 0 THEN positive / total ELSE 0.0 END) * 100', 0)} AS BIGINT) AS positive_pct
FROM part_sentiment""")
def q_positive_ratio(spark, d):
    c = R.sentiment_totals(part_label_counts(spark, d, "sentiment"))
    return c.select("product_name", big("total").alias("total"), r6("positive_ratio").alias("positive_ratio"),
                    big(F.round(F.col("positive_ratio") * 100)).alias("positive_pct"))


# ----------------------------------------------------------------- decision

def decision_frame(spark, d):
    """Entry 2 for every product name a user could ask about: prices by
    exact name, all reviews by fuzzy match."""
    prices = A.part_price_obs(spark, d)
    revs = A.reviews(spark, d)
    # One row per priced product; read twice (target list, decision).
    stats = materialize(dec.price_stats(ser.daily_series(prices)))
    targets = stats.select("product_name").unionByName(revs.select("product_name"))
    pairs = R.match_names(targets, revs)
    counts = R.counts_by_target(R.label_counts(analyzed_reviews(spark, d), ["sentiment"]), pairs)
    return dec.decide(stats, R.sentiment_totals(counts))


DECISION_SQL = f"""
SELECT product_name, decision, reason, positive, neutral, negative,
       {X.rnd('current_price', 6)} AS current_price, {X.rnd('positive_ratio', 6)} AS positive_ratio, price_status
FROM (
  SELECT product_name,
         CASE WHEN total >= 5 AND has_prices AND status = 'Good' AND ratio >= 0.5 THEN 'Buy Now' ELSE 'Wait' END AS decision,
         CASE WHEN NOT (total >= 5 AND has_prices) THEN {X.q(S.REASON_NOT_ENOUGH)}
              WHEN status = 'Good' AND ratio >= 0.5 THEN {X.q(S.REASON_BUY)}
              WHEN status = 'High' AND ratio >= 0.5 THEN {X.q(S.REASON_HIGH_POSITIVE)}
              WHEN status = 'Good' AND ratio < 0.5 THEN {X.q(S.REASON_GOOD_MIXED)}
              ELSE {X.q(S.REASON_POOR)} END AS reason,
         positive, neutral, negative,
         CASE WHEN current_price <> 0 THEN current_price END AS current_price,
         ratio AS positive_ratio, status AS price_status
  FROM (
    SELECT coalesce(p.product_name, s.product_name) AS product_name,
           coalesce(s.total, 0) AS total, coalesce(s.positive, 0) AS positive,
           coalesce(s.neutral, 0) AS neutral, coalesce(s.negative, 0) AS negative,
           CASE WHEN coalesce(s.total, 0) > 0 THEN coalesce(s.positive, 0) / s.total ELSE 0.0 END AS ratio,
           p.price_status IS NOT NULL AS has_prices,
           coalesce(p.price_status, 'Unknown') AS status, p.current_price
    FROM (SELECT product_name, arg_max(y, ds) AS current_price,
                 CASE WHEN arg_max(y, ds) <= quantile_cont(y, 0.5) * CAST(1.05 AS DOUBLE) THEN 'Good' ELSE 'High' END
                 AS price_status
          FROM part_series GROUP BY product_name) p
    FULL OUTER JOIN (
      SELECT product_name,
             CAST(count(*) FILTER (WHERE sentiment = 'Positive') AS BIGINT) AS positive,
             CAST(count(*) FILTER (WHERE sentiment IS NULL OR sentiment NOT IN ('Positive', 'Negative')) AS BIGINT)
               AS neutral,
             CAST(count(*) FILTER (WHERE sentiment = 'Negative') AS BIGINT) AS negative,
             CAST(count(*) AS BIGINT) AS total
      FROM (SELECT m.product_name, a.sentiment FROM all_matched m JOIN analyzed a ON m.review_id = a.review_id)
      GROUP BY product_name) s
    ON p.product_name = s.product_name))"""


def _register_decision_views():
    view("all_targets", ["part_daily", "reviews"], f"""
SELECT t_name, {X.norm('t_name', False)} AS t_norm, {X.tokens('t_name')} AS t_tokens
FROM (SELECT DISTINCT product_name AS t_name FROM
      (SELECT product_name FROM part_daily UNION ALL SELECT product_name FROM reviews)
      WHERE product_name IS NOT NULL)""")
    view("all_matched", ["all_targets", "review_names", "reviews"], f"""
SELECT p.t_name AS product_name, r.review_id
FROM (SELECT t_name, r_name FROM all_targets, review_names
      WHERE {X.names_match('t_norm', 'r_norm', 't_tokens', 'r_tokens')}) p
JOIN reviews r ON r.product_name = p.r_name""")


_register_decision_views()


@query("decision", "J3 F15 F16 A3 A4 A5", ["part_series", "all_matched", "analyzed"], DECISION_SQL)
def q_decision(spark, d):
    out = decision_frame(spark, d)
    return out.select("product_name", "decision", "reason", "positive", "neutral", "negative",
                      r6("current_price").alias("current_price"), r6("positive_ratio").alias("positive_ratio"),
                      "price_status")


@query("alert_reasons", "J2 F24 J3", ["part_series", "all_matched", "analyzed"], f"""
SELECT 'c' || CAST(c.c_custkey AS VARCHAR) || '@example.com' AS email, p.p_name AS product_name, v.price AS current_price,
       p.p_retailprice AS target_price, format({X.q(AL.ALERT_SUBJECT.replace('%s', '{}'))}, p.p_name) AS subject, v.reason
FROM customer c JOIN part p ON p.p_partkey = c.c_custkey
JOIN (SELECT product_name, {X.rnd('current_price', 2)} AS price, reason FROM ({DECISION_SQL})) v ON v.product_name = p.p_name
WHERE v.price <> 0 AND v.price <= p.p_retailprice""")
def q_alert_reasons(spark, d):
    """Alerts of the part prices with the decision's own reason: customer k
    waits for part k at its list price."""
    found = materialize(decision_frame(spark, d))
    part = A.table(spark, d, "part")
    state = A.table(spark, d, "customer").join(part, F.col("c_custkey") == F.col("p_partkey")).select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.col("p_name").alias("product_name"), F.col("p_retailprice").alias("target_price"), F.lit(True).alias("active"))
    due = AL.alerts_due(found.select("product_name", F.round("current_price", 2).alias("current_price")), state, found.select("product_name", "reason"))
    told = F.regexp_extract("body", r"AI Decision Insight: ([^\n]*)", 1)
    return due.select("email", "product_name", "current_price", "target_price", "subject", told.alias("reason"))
