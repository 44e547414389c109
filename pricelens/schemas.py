"""Schemas, label sets and the fixed values results depend on."""

from __future__ import annotations

from pyspark.sql.types import (BooleanType, DoubleType, IntegerType, LongType,
                               StringType, StructField, StructType,
                               TimestampType)

# The flat observation table: price points and reviews told apart by source.
OBSERVATIONS = StructType([
    StructField("timestamp", StringType()),
    StructField("source", StringType()),
    StructField("product_name", StringType()),
    StructField("price", DoubleType()),
    StructField("rating", StringType()),
    StructField("review_text", StringType()),
    StructField("url", StringType()),
    StructField("metadata", StringType()),
    StructField("seq", LongType()),
])

PRICE_OBS = StructType([
    StructField("product_name", StringType()),
    StructField("ts", TimestampType()),
    StructField("price", DoubleType()),
    StructField("url", StringType()),
    StructField("seq", LongType()),
])

REVIEWS = StructType([
    StructField("review_id", LongType()),
    StructField("product_name", StringType()),
    StructField("review_text", StringType()),
    StructField("rating", StringType()),
    StructField("reviewer", StringType()),
    StructField("certified", BooleanType()),
    StructField("ts", TimestampType()),
    StructField("seq", LongType()),
])

SUBSCRIPTION_EVENTS = StructType([
    StructField("email", StringType()),
    StructField("product_name", StringType()),
    StructField("target_price", DoubleType()),
    StructField("sub_ts", TimestampType()),
    StructField("seq", LongType()),
])

LLM_RESPONSES = StructType([
    StructField("review_id", LongType()),
    StructField("model_rank", IntegerType()),
    StructField("response_text", StringType()),
])

PAGES = StructType([
    StructField("page_id", LongType()),
    StructField("url", StringType()),
    StructField("html", StringType()),
])

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the original application's for equal
# results; they are stated verbatim and in their original order.
# ---------------------------------------------------------------------------

SOURCE_PRICE = "flipkart_price_history"
SOURCE_REVIEWS = "flipkart_reviews"

# Category keyword lists, tested in this order; the first list with any
# keyword contained in the lower-cased text wins.
CATEGORIES = [
    ("Battery", ["battery", "charging", "backup", "drain", "heat"]),
    ("Camera", ["camera", "photo", "picture", "clarity", "lens"]),
    ("Performance", ["performance", "lag", "smooth", "hang", "speed", "processor", "slow"]),
    ("Display", ["screen", "brightness", "resolution", "display", "color"]),
    ("Value", ["price", "money", "worth", "value", "cheap", "expensive"]),
    ("Design", ["design", "look", "build", "color", "ui", "weight", "feel"]),
    ("Delivery", ["delivery", "packaging", "received", "delay", "box", "shipping"]),
]
DEFAULT_CATEGORY = "General"

# Rule-based sentiment lexicon.
POSITIVE_WORDS = ["good", "nice", "excellent", "love", "amazing", "great", "perfect",
                  "smooth", "best", "awesome", "superb"]
NEGATIVE_WORDS = ["bad", "slow", "refund", "poor", "worst", "terrible", "heating",
                  "hang", "issue", "horrible", "awful", "waste"]

SENTIMENT_LABELS = ["Positive", "Neutral", "Negative"]

# Name matching: stop tokens and the phrase stripped from review-side names.
NAME_STOP_TOKENS = ["add", "to", "compare"]
NAME_NOISE_PHRASE = "add to compare"
OVERLAP_RATIO = 0.7

# Review-card extraction.
CERTIFIED_BUYER = "Certified Buyer"
READ_MORE = "READ MORE"
MONTH_PATTERN = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
MAX_REVIEW_PAGES = 10

# Price page markers.
PRICE_DATASET_PATTERN = r'var PagePriceHistoryDataSet\s*=\s*"([^"]+)"'
PRICE_KEY_PATTERN = r"let CachedKey='([^']+)'"
PRICE_HOST = "pricehistory.app"
TITLE_SUFFIX = "Price History"
DEFAULT_PRICE_PRODUCT = "Flipkart Product"

# Decision rule.
GOOD_PRICE_FACTOR = 1.05
MIN_REVIEWS_FOR_DECISION = 5
POSITIVE_RATIO_CUT = 0.5
REASON_NOT_ENOUGH = "Not enough data to make a confident decision."
REASON_BUY = ("Price is currently at or below the historical average, and user "
              "sentiment is strongly positive.")
REASON_HIGH_POSITIVE = ("User sentiment is positive, but the price is currently higher "
                        "than the historical average. Consider waiting for a drop.")
REASON_GOOD_MIXED = ("Price is good, but user reviews are predominantly negative or "
                     "mixed. Proceed with caution.")
REASON_POOR = "Price is high and reviews are poor. Not recommended to buy right now."

# Request defaults and limits.
DEFAULT_PERIODS = 30
MIN_HISTORY_POINTS = 10
MAX_REVIEWS_ANALYSED = 100
SAMPLE_REVIEWS = 10
PAGE_SIZE = 50
TRAIN_FRACTION = 0.8
DATA_FILE_EXTENSIONS = ["csv", "xlsx", "json", "sqlite", "db"]
