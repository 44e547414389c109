"""Test pages landed from the driver's tables: price-history pages from ticks,
review pages from reviews.  Only the queries use these; the library reads pages
that were landed elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..sources.price_pages import PAGE_URL_PREFIX

REVIEW_URL = "https://shop.example.com/product-reviews/"
#: Consecutive review ids from which a listing's page takes its reviews.
PAGE_IDS = 100
#: Behind one of so many pages of all listings an empty one is landed.
EMPTY_EVERY = 7
#: What an empty page's id has beyond that of the page before it.
EMPTY_PAGE_ID = 10_000_000_000


def xor_chars(text: Column, key: Column) -> Column:
    """Each character of ``text`` (code 0-255) XOR-ed with the key's
    character at the same position mod ``len(key)``.

    The lambda sees only its two arguments: the text's characters and the
    key codes repeated to the text's length are built once per row, so the
    work is linear in the page size.
    """
    chars = F.split(text, "")
    n = F.size(chars)
    codes = F.transform(F.split(key, ""), lambda c: F.ascii(c))
    reps = F.ceil(n / F.greatest(F.size(codes), F.lit(1))).cast("int")
    key_run = F.slice(F.flatten(F.array_repeat(codes, reps)), 1, n)
    out = F.array_join(F.zip_with(chars, key_run, lambda c, k: F.char(F.ascii(c).bitwiseXOR(k))), "")
    return F.when((F.length(text) > 0) & (F.length(key) > 0), out).otherwise(F.lit(""))


def page_key(product: Column) -> Column:
    """Key text of a product's price page."""
    return F.substring(F.sha2(product, 256), 1, 16)


def price_pages(ticks: DataFrame) -> DataFrame:
    """Price pages, one for each product and month, holding its points as
    ``{"History":{"Price":[{"x","y"}...]}}`` under the page cipher."""
    g = ticks.groupBy("product_name", F.trunc("ts", "month").alias("month")).agg(
        F.array_sort(F.collect_list(F.struct("ts", "seq", "price"))).alias("pts"))
    pts = F.transform("pts", lambda p: F.struct(
        F.date_format(p["ts"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("x"), p["price"].alias("y")))
    js = F.to_json(F.struct(F.struct(pts.alias("Price")).alias("History")))
    key = page_key(F.col("product_name"))
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"), F.col("product_name"), F.lit(" " + S.TITLE_SUFFIX),
        F.lit("</title></head><body><div id=\"chart\"></div><script>var PagePriceHistoryDataSet = \""),
        F.base64(F.encode(xor_chars(js, key), "ISO-8859-1")), F.lit("\";\nlet CachedKey='"), key, F.lit("';</script></body></html>"))
    url = F.concat(F.lit(PAGE_URL_PREFIX), F.col("product_name"), F.lit("/"), F.date_format("month", "yyyyMM"))
    return g.select(F.xxhash64("product_name", "month").alias("page_id"), url.alias("url"), html.alias("html"))


def _esc(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def review_card(r: Column) -> Column:
    """A card of ``(rating, review_text, reviewer)``."""
    return F.concat(
        F.lit('<div class="card"><div class="hdr"><div class="rt"><div>'), r["rating"],
        F.lit('<svg width="12"></svg></div></div><p class="ttl">'), _esc(F.substring_index(r["review_text"], "\n", 1)),
        F.lit("</p></div>"), F.lit('<div class="txt"><div>'), _esc(r["review_text"]), F.lit("<span>READ MORE</span></div></div>"),
        F.lit('<div class="l1"><div class="l2"><div class="l3"><div class="l4"><div class="meta"><p>'),
        _esc(r["reviewer"]), F.lit("</p><p><span>Certified Buyer</span></p><p>2 months ago</p>"),
        F.lit("</div></div></div></div></div></div>"))


def review_pages(reviews: DataFrame) -> DataFrame:
    """Review pages of every listing: page 2k - 1 holds the listing's reviews
    among the k-th hundred ids, in id order, the first one shown once more at
    the end as featured.  Behind every seventh of them (counted over listings
    and numbers) an empty page 2k is landed as well.  A page gathers at most
    ``PAGE_IDS`` ids, however large its listing."""
    block = F.floor(F.col("review_id") / PAGE_IDS).cast("int")
    g = reviews.groupBy("listing", block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("review_id", "product_name", "rating", "review_text", "reviewer"))).alias("rs"))
    first = F.col("rs")[0]
    slug = F.regexp_replace(F.lower(first["product_name"]), "[^a-z0-9]+", "-")
    links = F.concat(F.lit('<a href="/p/'), slug, F.lit('">'), _esc(first["product_name"]),
                     F.lit('</a><a href="/product-reviews/'), slug, F.lit('">All reviews</a>'))
    cards = F.concat(F.array_join(F.transform("rs", review_card), ""), review_card(first))
    follows = F.pmod(F.length("listing") + F.col("block"), F.lit(EMPTY_EVERY)) == EMPTY_EVERY - 1

    def page(shift: int, after: int, main: Column) -> Column:
        html = F.concat(F.lit("<html><head><title>"), _esc(first["product_name"]), F.lit("</title></head><body><nav>"), links,
                        F.lit("</nav><main>"), main, F.lit("</main></body></html>"))
        return F.struct((first["review_id"] + F.lit(shift)).alias("page_id"), (2 * F.col("block") + after).cast("string").alias("number"), html.alias("html"))

    both = F.array(page(0, 1, cards), page(EMPTY_PAGE_ID, 2, F.lit("<p>No reviews yet</p>")))
    pages = g.select("listing", F.inline(F.slice(both, F.lit(1), F.when(follows, 2).otherwise(1))))
    return pages.select("page_id", F.concat(F.lit(REVIEW_URL), "listing", F.lit("?sort=id&page="), "number").alias("url"), "html")
