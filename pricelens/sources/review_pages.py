"""Review pages: card extraction from landed HTML (S8), page numbers and
the take-until-empty rule (S8b, S8c), product/review links (S8e) and review
text assembly (F12, F13).

Spark SQL has no function that reads HTML, so one Python step reads a page's
elements and gives each, in one pass in document order, to the cards that are
open there (``page_cards``).  A card is a row with the texts a rule may read;
the rules are expressions over it, and nothing is shuffled before rule 7.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as T

CARDS = "page_id long, badge int, stars array<string>, leaves array<string>, inline array<string>"
# Fixed values of HTML: elements that never hold others, and those whose text is no page text.
_EMPTY_TAGS = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
_SILENT_TAGS = frozenset(["script", "style", "template"])
_BLOCK_TAGS, _ICON_TAGS = frozenset(["p", "div"]), frozenset(["svg", "img"])
_TEXT_TAGS = frozenset(["div", "span", "p"])
_STARS = frozenset("12345")
#: A card is so many elements above its badge.
LEVELS = 6
#: Cards that a Python worker gathers before it hands them on: characters of their texts, and rows.
HELD_CHARS, HELD_CARDS = 1 << 20, 5_000


class _Elements(HTMLParser):
    """A page's elements that cards are made of, ``(number, last number inside,
    tag, text, holds a block, holds an icon, card)``.  Elements are numbered in
    document order, the page itself is 0; one is noted when it closes, from what
    its children handed up, so nothing is visited twice.  ``card`` is set where
    the element reads as the badge: the sixth element above, or the topmost."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.count = 0
        self.open: list[list] = []   # [number, tag, texts, holds a block, holds an icon]
        self._begin("[page]")

    def _begin(self, tag):
        self.open.append([self.count, tag, [], False, False])
        self.count += 1

    def _close(self):
        number, tag, texts, block, icon = self.open.pop()
        text = "".join(texts)
        card = None
        if text == S.CERTIFIED_BUYER and tag in _TEXT_TAGS:
            card = self.open[-LEVELS if len(self.open) >= LEVELS else 0][0]
        self.rows.append((number, self.count - 1, tag, text, block, icon, card))
        if self.open:
            parent = self.open[-1]
            if tag not in _SILENT_TAGS:
                parent[2].append(text)
            parent[3] |= block or tag in _BLOCK_TAGS
            parent[4] |= icon or tag in _ICON_TAGS

    def handle_starttag(self, tag, attrs):
        self._begin(tag)
        if tag in _EMPTY_TAGS:
            self._close()

    def handle_startendtag(self, tag, attrs):
        self._begin(tag)
        self._close()

    def handle_endtag(self, tag):
        if any(e[1] == tag for e in self.open[1:]):
            while self.open[-1][1] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        self.open[-1][2].append(data.strip())

    def finish(self) -> list[tuple]:
        self.close()
        while self.open:
            self._close()
        return self.rows


def cards_of(elements: list[tuple]) -> list[tuple]:
    """Rules 1 and 2 on a page's elements: for each card ``(badge, stars, leaves,
    inline)``, the number of its first badge and the texts inside it, in
    document order, of ratings beside an icon, of elements without blocks, and
    of p and span.  Badges are the outermost elements that read so.  One pass in
    document order carries the cards that are open."""
    elements = sorted(elements)
    cards: dict[int, tuple] = {}
    end = -1
    for number, last, *_, card in elements:
        if card is not None:
            if number > end:
                cards.setdefault(card, (number, [], [], []))
            end = max(end, last)
    inside: list[tuple] = []   # cards around the element: (last number, card)
    for number, last, tag, text, block, icon, _ in elements if cards else ():
        while inside and inside[-1][0] < number:
            inside.pop()
        if tag in _TEXT_TAGS:
            for _, (_, stars, leaves, inline) in inside:
                if icon and tag != "p" and text in _STARS:
                    stars.append(text)
                if not block:
                    leaves.append(text)
                if tag != "div":
                    inline.append(text)
        if number in cards:
            inside.append((last, cards[number]))
    return list(cards.values())


def card_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cards of batches of pages.  One page at a time is a Python text, and
    cards of about ``HELD_CHARS`` are held, whatever number of pages a batch has."""
    texts = pa.list_(pa.string())
    schema = pa.schema([("page_id", pa.int64()), ("badge", pa.int32()), ("stars", texts), ("leaves", texts), ("inline", texts)])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    rows, held = [], 0
    for batch in batches:
        for page_id, html in zip(*batch.columns):
            reader = _Elements()
            reader.feed(html.as_py() or "")
            for card in cards_of(reader.finish()):
                rows.append((page_id.as_py(), *card))
                held += sum(len(t) for column in card[1:] for t in column)
                if held > HELD_CHARS or len(rows) >= HELD_CARDS:
                    yield batch_of(rows)
                    rows, held = [], 0
    if rows:
        yield batch_of(rows)


def page_cards(pages: DataFrame) -> DataFrame:
    """The cards of each page ``(page_id, html)`` as ``cards_of`` gives them; a
    null page has none."""
    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(card_batches, CARDS)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` reads it
    for every entry of an array."""
    return F.transform(F.array(value), use)[0]


def extract_reviews(pages: DataFrame, compat: bool = False) -> DataFrame:
    """The review cards of every page ``(page_id, html)``, numbered within
    it (``card_no``): rating, title, body, reviewer, certified.

    ``compat`` matches month names and "ago" inside words too.  Equal cards of a
    page are one (rule 7)."""
    cards = page_cards(pages).withColumn("rating", F.coalesce(F.get("stars", F.lit(0)), F.lit("")))   # rule 3

    def said(t: Column) -> Column:
        return ~T.is_noise_text(t, F.col("rating"), compat)

    def card(texts: Column) -> Column:
        body = _let(F.array_max(F.transform(texts, lambda t: F.length(t))),                                 # rule 5
                    lambda longest: F.filter(texts, lambda t: F.length(t) == longest)[0])
        return _let(body, lambda body: _let(
            F.coalesce(F.get(F.filter(texts, lambda t: (t != body) & (F.length(t) < 100)), F.lit(0)), F.lit("")),
            lambda title: F.struct(
                title.alias("title"), T.strip_ws(F.replace(body, F.lit(S.READ_MORE), F.lit(""))).alias("body"),
                F.coalesce(F.get(F.filter("inline", lambda t: reviewer(t, texts, title, body)), F.lit(0)),
                           F.lit("")).alias("reviewer"))))

    # rule 6; a reviewer may be one character long, so only the text tests apply there
    def reviewer(t: Column, texts: Column, title: Column, body: Column) -> Column:
        return ((t != "") & (F.length(t) < 40) & (t != title) & (t != body)
                & ~T.is_dated_or_digits(t, compat) & ~t.isin(S.READ_MORE, S.CERTIFIED_BUYER) & (t != F.col("rating"))
                & ((F.size(texts) <= 3) | ~F.array_contains(texts, t)))

    texts = F.array_distinct(F.filter("leaves", said))   # rule 4
    found = F.transform(F.filter(F.array(texts), lambda x: F.size(x) > 0), card)
    cards = cards.select("page_id", "badge", "rating", F.inline(found))
    cards = cards.groupBy("page_id", "rating", "title", "body", "reviewer").agg(F.min("badge").alias("badge"))  # rule 7
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("badge")) - 1
    return cards.select("page_id", number.alias("card_no"), "rating", "title", "body", "reviewer", F.lit(True).alias("certified"))


def product_title(html: Column) -> Column:
    """S8e: the text of the first product link, "Product" without one."""
    title = F.regexp_extract(html, r'href="[^"]*/p/[^"]*"[^>]*>([^<]*)</a>', 1)
    return F.when(title != "", title).otherwise(F.lit("Product"))


def review_text(title: Column, body: Column) -> Column:
    """F12."""
    return T.review_text(title, body)


def review_metadata(reviewer: Column, certified: Column) -> Column:
    """reviewer and certified flag as JSON text."""
    return F.to_json(F.struct(reviewer.alias("reviewer"), certified.alias("certified")))


def page_numbers(pages: DataFrame) -> DataFrame:
    """Adds ``base_url`` and ``page`` from the URL."""
    base = F.regexp_replace(F.col("url"), r"&page=\d+", "")
    num = F.regexp_extract(F.col("url"), r"[?&]page=(\d+)", 1)
    return pages.withColumns({"base_url": base, "page": F.when(num != "", num.cast("int"))})


def pages_until_empty(pages: DataFrame, max_pages: int | None = None, key: str = "base_url") -> DataFrame:
    """Per listing, pages before the first page without reviews; with
    ``max_pages`` (``schemas.MAX_REVIEW_PAGES`` in the original) no later ones either.  Input
    ``(key, page, n_reviews, ...)``.  The first empty page of each listing is a
    partial aggregate joined back, so a listing of any size is never gathered."""
    p = pages.where(F.col("page") >= 1)
    if max_pages is not None:
        p = p.where(F.col("page") <= max_pages)
    empty = p.where(F.col("n_reviews") == 0).groupBy(F.col(key).alias("_key")).agg(F.min("page").alias("first_empty"))
    j = p.join(empty, F.col(key).eqNullSafe(F.col("_key")), "left")
    return j.where(F.col("first_empty").isNull() | (F.col("page") < F.col("first_empty"))).drop("first_empty", "_key")


def anchor_count(html: Column) -> Column:
    """Number of "Certified Buyer" badges in a page (a quick review count)."""
    return F.size(F.regexp_extract_all(html, F.lit(r">\s*Certified Buyer\s*<"), 0))
