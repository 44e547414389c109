"""SQL twins of the adapters and shared steps, for the DuckDB oracle.

Each entry is a named CTE body over the driver's views.  ``with_views``
assembles only the CTEs a query needs, in dependency order.  Where it is
cheap, the SQL is written differently from the Spark code (window
``row_number`` instead of ``max_by``, calendar + as-of join instead of
``lead`` + ``explode``) so the check compares two formulations.
"""

from __future__ import annotations

URL_PREFIX = "https://shop.example.com/p/"

VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, deps: list[str], body: str) -> None:
    VIEWS[name] = (deps, body)


view("price_obs", [], f"""
SELECT 'user_' || CAST(user_id AS VARCHAR) AS product_name, CAST(ts AS TIMESTAMP) AS ts,
       value AS price, '{URL_PREFIX}user_' || CAST(user_id AS VARCHAR) AS url, event_id AS seq
FROM events""")

view("part_price_obs", [], f"""
SELECT p.p_name AS product_name, CAST(l.l_shipdate AS TIMESTAMP) AS ts,
       CASE WHEN l.l_quantity <> 0 THEN l.l_extendedprice / l.l_quantity END AS price,
       '{URL_PREFIX}' || replace(p.p_name, ' ', '-') AS url,
       l.l_orderkey * 8 + l.l_linenumber AS seq
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""")

view("reviews", [], r"""
SELECT d.doc_id AS review_id,
       coalesce(CASE d.doc_id % 5
                  WHEN 0 THEN p.p_name
                  WHEN 1 THEN upper(p.p_name)
                  WHEN 2 THEN 'Add to Compare' || upper(substr(p.p_name, 1, 1)) || substr(p.p_name, 2)
                  WHEN 3 THEN replace(p.p_name, ' ', '-')
                  ELSE regexp_replace(p.p_name, '^(\S+) (\S+)$', '\2 \1') END,
                d.source) AS product_name,
       d.text AS review_text,
       CAST(d.n_chars % 5 + 1 AS VARCHAR) AS rating,
       'reader_' || d.source AS reviewer,
       true AS certified,
       TIMESTAMP '2024-02-01 00:00:00' + to_seconds(d.doc_id) AS ts,
       d.doc_id AS seq,
       d.source AS listing
FROM documents d LEFT JOIN part p ON d.doc_id = p.p_partkey""")

view("observations", ["reviews"], f"""
SELECT CASE WHEN event_type = 'error' THEN props
            WHEN event_type = 'purchase' THEN strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d')
            WHEN event_type = 'click' THEN strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')
            ELSE strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%f') END AS "timestamp",
       'flipkart_price_history' AS source,
       'user_' || CAST(user_id AS VARCHAR) AS product_name,
       value AS price, CAST(NULL AS VARCHAR) AS rating, CAST(NULL AS VARCHAR) AS review_text,
       '{URL_PREFIX}user_' || CAST(user_id AS VARCHAR) AS url, CAST(NULL AS VARCHAR) AS metadata,
       event_id * 2 AS seq
FROM events
UNION ALL
SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'flipkart_reviews', product_name, CAST(NULL AS DOUBLE),
       rating, review_text, CAST(NULL AS VARCHAR),
       to_json({{'reviewer': reviewer, 'certified': certified}})::VARCHAR, review_id * 2 + 1
FROM reviews""")

view("subscription_requests", [], """
SELECT CASE WHEN event_id % 7 = 0 THEN 'u' || CAST(user_id AS VARCHAR) || '.example.com'
            ELSE 'u' || CAST(user_id AS VARCHAR) || '@example.com' END AS email,
       'user_' || CAST(user_id AS VARCHAR) AS product_name,
       value - 5.0 AS target_price, CAST(ts AS TIMESTAMP) AS sub_ts, event_id AS seq
FROM events WHERE event_type = 'signup'""")

view("llm_responses", [], """
SELECT doc_id AS review_id, 1 AS model_rank,
       CASE WHEN doc_id % 3 = 0 THEN 'Sorry, I cannot classify {this}.'
            ELSE 'Result: {"sentiment": "' ||
                 CASE WHEN toxic = 1 THEN 'NEGATIVE' WHEN quality = 1 THEN 'positive' ELSE 'Neutral' END ||
                 '", "confidence": "' || CASE WHEN quality = 1 THEN '0.9' ELSE '0.6' END || '"} done' END
       AS response_text
FROM labels
UNION ALL
SELECT doc_id, 2,
       '{"sentiment":"' || CASE WHEN toxic = 1 AND quality = 0 THEN 'Angry'
                                WHEN toxic = 1 THEN 'negative' ELSE 'neutral' END || '","confidence":0.7}'
FROM labels""")

# Last price per product-day (row_number formulation).
view("daily", ["price_obs"], """
SELECT product_name, CAST(ts AS DATE) AS ds, price AS y
FROM price_obs WHERE ts IS NOT NULL AND price IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY product_name, CAST(ts AS DATE)
                           ORDER BY ts DESC, seq DESC, price DESC) = 1""")

# Calendar per product + as-of join (forward fill).
view("series", ["daily"], """
SELECT c.product_name, c.ds, d.y
FROM (SELECT product_name, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds
      FROM daily GROUP BY product_name) c
ASOF JOIN daily d ON c.product_name = d.product_name AND c.ds >= d.ds""")

view("part_daily", ["part_price_obs"], """
SELECT product_name, CAST(ts AS DATE) AS ds, price AS y
FROM part_price_obs WHERE ts IS NOT NULL AND price IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY product_name, CAST(ts AS DATE)
                           ORDER BY ts DESC, seq DESC, price DESC) = 1""")

view("part_series", ["part_daily"], """
SELECT c.product_name, c.ds, d.y
FROM (SELECT product_name, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds
      FROM part_daily GROUP BY product_name) c
ASOF JOIN part_daily d ON c.product_name = d.product_name AND c.ds >= d.ds""")

# Position and fold on the dense series.
view("split", ["series"], """
SELECT product_name, ds, y,
       row_number() OVER (PARTITION BY product_name ORDER BY ds) - 1 AS idx,
       count(*) OVER (PARTITION BY product_name) AS n
FROM series""")


def with_views(names: list[str], body: str) -> str:
    """``WITH`` clause holding ``names`` and their dependencies, then body."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    return f"WITH {ctes}\n{body}"


def _register_text_views() -> None:
    from . import sql_text as X

    drv_pos, drv_neg = DRIVER_POSITIVE, DRIVER_NEGATIVE
    view("llm_parsed", ["llm_responses"], f"""
SELECT review_id, model_rank, {X.llm_parsed('response_text')} FROM llm_responses""")
    view("llm_best", ["llm_parsed"], """
SELECT review_id, arg_min(label, model_rank) AS label, arg_min(confidence, model_rank) AS confidence
FROM llm_parsed WHERE label IS NOT NULL GROUP BY review_id""")
    view("analyzed", ["reviews", "llm_best"], f"""
SELECT r.*, coalesce(b.label, {X.rule_label('r.review_text', drv_pos, drv_neg)}) AS sentiment,
       CASE WHEN b.label IS NOT NULL THEN b.confidence
            ELSE {X.rule_conf('r.review_text', drv_pos, drv_neg)} END AS confidence,
       {X.category('r.review_text')} AS category
FROM reviews r LEFT JOIN llm_best b ON r.review_id = b.review_id""")
    view("review_names", ["reviews"], f"""
SELECT r_name, {X.norm('r_name', True)} AS r_norm, {X.tokens('r_name')} AS r_tokens
FROM (SELECT DISTINCT product_name AS r_name FROM reviews WHERE product_name IS NOT NULL)""")
    view("part_targets", [], f"""
SELECT t_name, {X.norm('t_name', False)} AS t_norm, {X.tokens('t_name')} AS t_tokens
FROM (SELECT DISTINCT p_name AS t_name FROM part WHERE p_name IS NOT NULL)""")
    view("part_matched", ["part_targets", "review_names", "reviews"], f"""
SELECT p.t_name AS product_name, r.review_id, r.seq, r.product_name AS review_product
FROM (SELECT t_name, r_name FROM part_targets, review_names
      WHERE {X.names_match('t_norm', 'r_norm', 't_tokens', 'r_tokens')}) p
JOIN reviews r ON r.product_name = p.r_name""")
    view("part_top100", ["part_matched"], """
SELECT * FROM part_matched
QUALIFY row_number() OVER (PARTITION BY product_name ORDER BY seq) <= 100""")
    view("part_matched_analyzed", ["part_matched", "analyzed"], """
SELECT t.product_name, a.review_id, a.sentiment, a.category
FROM part_matched t JOIN analyzed a ON t.review_id = a.review_id""")
    view("part_sentiment", ["part_matched_analyzed"], """
SELECT product_name,
       CAST(count(*) FILTER (WHERE sentiment = 'Positive') AS BIGINT) AS positive,
       CAST(count(*) FILTER (WHERE sentiment IS NULL OR sentiment NOT IN ('Positive', 'Negative')) AS BIGINT) AS neutral,
       CAST(count(*) FILTER (WHERE sentiment = 'Negative') AS BIGINT) AS negative,
       CAST(count(*) AS BIGINT) AS total
FROM part_matched_analyzed GROUP BY product_name""")


# A second lexicon of words frequent in the driver's text (the default one
# hardly occurs there), used by the review queries next to the default.
DRIVER_POSITIVE = ["that", "with", "ther"]
DRIVER_NEGATIVE = ["this", "from", "tion"]

_register_text_views()
