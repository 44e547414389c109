"""The original application's operations over one observation table.

Each function answers for every product at once (optionally restricted
with ``products``, a predicate pushed to the scan) and returns DataFrames:

    obs = store.scan_observations(spark, path)
    api.list_products(obs)
    api.load_product_price_data(obs, products=["Foo 12"])
    api.run_forecast(obs, model="both", periods=30)
    api.make_decision(obs, responses=stored_replies)
    api.check_alerts(obs, subscribe_requests)
    api.preview(obs, page=2, search="battery")
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import schemas as S
from .operators import alerts as AL
from .operators import browse as B
from .operators import decision as DEC
from .operators import forecast as FC
from .operators import reviews as R
from .operators import series as SER
from .session import materialize
from .sources import price_pages as PP
from .sources import review_pages as RP

METADATA_SCHEMA = "reviewer string, certified boolean"


def price_ticks(obs: DataFrame, products=None) -> DataFrame:
    """P2 + P6: price rows with a readable time and price."""
    return SER.coerce_observations(obs.where(F.col("source") == S.SOURCE_PRICE), products)


def review_rows(obs: DataFrame) -> DataFrame:
    """Review rows as ``reviews`` (metadata JSON unpacked)."""
    r = R.review_sources(obs)
    meta = F.from_json("metadata", METADATA_SCHEMA)
    return r.select(F.col("seq").alias("review_id"), "product_name", "review_text", "rating",
                    meta["reviewer"].alias("reviewer"), meta["certified"].alias("certified"),
                    SER.parse_timestamp(F.col("timestamp")).alias("ts"), "seq")


def list_products(obs: DataFrame) -> DataFrame:
    """D1."""
    return SER.list_products(obs)


def load_product_price_data(obs: DataFrame, products=None) -> DataFrame:
    """D2 + W1: gap-free daily series ``(product_name, ds, y)``."""
    return SER.daily_series(price_ticks(obs, products))


@dataclass
class ForecastAnswer:
    history: DataFrame       # P7
    eligibility: DataFrame   # P8 / M7
    result: FC.ForecastResult | None


def run_forecast(obs: DataFrame, products=None, model: str = "both",
                 periods: int = S.DEFAULT_PERIODS) -> ForecastAnswer:
    """Entry 1: history, the 10-day gate, and the selected model(s)."""
    series = load_product_price_data(obs, products)
    requested = None
    if products is not None:
        names = [products] if isinstance(products, str) else list(products)
        requested = obs.sparkSession.createDataFrame([(n,) for n in names], "product_name string")
    return ForecastAnswer(SER.historical_series(series), SER.forecast_eligibility(series, requested=requested),
                          FC.forecast(series, model, periods))


def get_product_reviews(obs: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Reviews matched to target names (default: every name in the
    table)."""
    revs = review_rows(obs)
    if targets is None:
        targets = obs.select("product_name")
    return R.match_reviews(targets, revs)


def analyze_reviews(reviews: DataFrame, responses: DataFrame | None = None, **lexicon) -> DataFrame:
    """F9 with the F7 cascade."""
    return R.analyze_reviews(reviews, responses, **lexicon)


def make_decision(obs: DataFrame, products=None, responses: DataFrame | None = None, **lexicon) -> DataFrame:
    """Entry 2: buy-or-wait for every product name (or ``products``)."""
    series = load_product_price_data(obs, products)
    stats = DEC.price_stats(series)
    names = obs.select("product_name").distinct()
    if products is not None:
        names = names.where(F.col("product_name").isin(
            [products] if isinstance(products, str) else list(products)))
    revs = review_rows(obs)
    pairs = R.match_names(names, revs)
    labels = R.label_counts(R.analyze_reviews(revs, responses, **lexicon), ["sentiment"])
    return DEC.decide(stats, R.sentiment_totals(R.counts_by_target(labels, pairs)))


def subscribe(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P11 + D4: (current subscription state, rejected requests)."""
    good, bad = AL.split_valid(requests)
    return AL.upsert_state(good), bad


def check_alerts(obs: DataFrame, requests: DataFrame, reasons: DataFrame | None = None,
                 fired: DataFrame | None = None) -> DataFrame:
    """J2 on the current prices (last value of each daily series), with
    the decision reason in the message.  ``fired`` is the log of alerts sent
    before ``(email, product_name, fired_ts)``; those do not fire again until
    their key subscribes anew."""
    state, _ = subscribe(requests)
    if fired is not None:
        state = AL.apply_fired(state, fired)
    current = DEC.price_stats(load_product_price_data(obs)).select("product_name", "current_price")
    return AL.alerts_due(current, state, reasons)


def preview(df: DataFrame, page: int = 1, page_size: int = S.PAGE_SIZE, search: str = "",
            order_by: str = "seq") -> B.Page:
    """O3 + P4 + A12: one page of (searched) rows with counts."""
    return B.paginate(B.search_keyword(df, search) if search else df, page, page_size, order_by)


def ingest_price_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entry 3 (prices): observation rows and rejected pages from landed
    price-history pages."""
    rows, rejected = PP.decode_price_pages(pages)
    obs = rows.select("timestamp", "source", "product_name", "price", "url",
                      F.xxhash64("page_id", "timestamp").alias("seq"))
    return obs, rejected


def ingest_review_pages(pages: DataFrame, product_name: str | None = None) -> DataFrame:
    """Entry 3 (reviews): observation rows from landed review pages, each
    listing's pages up to the first one without reviews (S8b; a page without a
    number is the first).  The product is the title of the page's product link
    (S8e) unless a name is given."""
    cards = materialize(RP.extract_reviews(pages))
    numbered = RP.page_numbers(pages).withColumn("page", F.coalesce("page", F.lit(1)))
    counts = cards.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    listed = numbered.join(counts, "page_id", "left").withColumn("n_reviews", F.coalesce("n", F.lit(0)))
    used = RP.pages_until_empty(listed).select("page_id", "url", RP.product_title(F.col("html")).alias("title_"))
    j = cards.join(used, "page_id")
    name = F.lit(product_name) if product_name is not None else F.col("title_")
    return j.select(F.lit(None).cast("string").alias("timestamp"), F.lit(S.SOURCE_REVIEWS).alias("source"),
                    name.alias("product_name"), F.col("rating"),
                    RP.review_text(F.col("title"), F.col("body")).alias("review_text"), "url",
                    RP.review_metadata(F.col("reviewer"), F.col("certified")).alias("metadata"),
                    F.xxhash64("page_id", "card_no").alias("seq"))
