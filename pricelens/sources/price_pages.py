"""Price-history pages: decode (S7, F10, F11) and validate.

The cipher is Base64 of the JSON bytes XOR-ed with a repeating text key.  Spark
has no function that XORs byte strings, and character arrays cost about five
boxed objects a character, so this one step is an Arrow-batched function.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .. import schemas as S
from ..functions import text as T

HISTORY_SCHEMA = StructType([StructField("History", StructType([
    StructField("Price", ArrayType(StructType([
        StructField("x", StringType()), StructField("y", DoubleType())])))]))])

PAGE_URL_PREFIX = "https://pricehistory.app/p/"


@F.pandas_udf(StringType())
def _decipher(cipher: pd.Series, key: pd.Series) -> pd.Series:
    """One vectorized XOR a page over its bytes."""
    def one(c, k):
        try:
            data = np.frombuffer(base64.b64decode("".join((c or "").split()), validate=True), np.uint8)
        except ValueError:
            return ""
        if not len(data) or not k:
            return ""
        run = np.resize(np.frombuffer(k.encode("latin-1", "replace"), np.uint8), len(data))
        return (data ^ run).tobytes().decode("latin-1")
    return pd.Series([one(c, k) for c, k in zip(cipher, key)], dtype="object")


def xor_decrypt(cipher: Column, key: Column) -> Column:
    """Base64-decode, XOR with the repeating key, read bytes as
    Latin-1 characters (one character per byte).  Text that is no Base64, and
    an empty key, give the empty text."""
    return _decipher(cipher, key)


def page_fields(pages: DataFrame) -> DataFrame:
    """Cipher text, key, status and product name of each page."""
    html = F.col("html")
    cipher = F.regexp_extract(html, S.PRICE_DATASET_PATTERN, 1)
    key = F.regexp_extract(html, S.PRICE_KEY_PATTERN, 1)
    status = (F.when(~F.coalesce(F.contains(F.col("url"), F.lit(S.PRICE_HOST)), F.lit(False)),
                     F.lit("invalid_url"))
              .when(cipher == "", F.lit("no_data"))
              .when(key == "", F.lit("no_key"))
              .otherwise(F.lit("ok")))
    return pages.select("*", cipher.alias("cipher"), key.alias("key"), status.alias("status"),
                        T.title_product_name(html).alias("product_name"))


def decode_price_pages(pages: DataFrame, source: str = S.SOURCE_PRICE) -> tuple[DataFrame, DataFrame]:
    """Price observations from landed pages, plus the quarantine.

    Returns ``(rows, rejected)``: rows are ``(page_id, product_name, url,
    timestamp, price, price_defaulted, source)``; rejected pages carry
    their ``status`` (invalid_url, no_data, no_key, decode_failed).
    """
    f = page_fields(pages)
    doc = F.from_json(xor_decrypt(F.col("cipher"), F.col("key")), HISTORY_SCHEMA)
    # A page that does not decode yields no points (explode of NULL).
    pts = f.where(F.col("status") == "ok").select(
        "page_id", "product_name", "url", F.explode(doc["History"]["Price"]).alias("p"))
    rows = pts.select("page_id", "product_name", "url", F.col("p.x").alias("timestamp"),
                      F.coalesce(F.col("p.y"), F.lit(0.0)).alias("price"),
                      F.col("p.y").isNull().alias("price_defaulted"), F.lit(source).alias("source"))
    rejected = page_status(pages).where(F.col("status") != "ok")
    return rows, rejected


def page_status(pages: DataFrame) -> DataFrame:
    """One status per page: ok when the cipher text decodes to a price
    list, decode_failed when it does not."""
    f = page_fields(pages)
    doc = F.from_json(xor_decrypt(F.col("cipher"), F.col("key")), HISTORY_SCHEMA)
    st = F.when((F.col("status") == "ok") & doc["History"]["Price"].isNull(), F.lit("decode_failed")).otherwise(F.col("status"))
    return f.select("page_id", "url", st.alias("status"))


def first_link(html: Column, marker: str) -> Column:
    """S8e: the first ``href`` whose target holds ``marker``, else NULL."""
    links = F.regexp_extract_all(html, F.lit(r'href="([^"]*' + marker.replace("/", r"\/") + r'[^"]*)"'), 1)
    return F.try_element_at(links, F.lit(1))
