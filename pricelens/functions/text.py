"""Column expressions for names, review text and classifier replies.

All are built-in Spark SQL expressions (whole-stage codegen, no Python).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S

# Python's str.split() whitespace, spelled for both Java regex and RE2.
WHITESPACE_CLASS = (r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------- names

def normalize_name(name, review_side: bool = False) -> Column:
    """lower case, keep only ``[a-z0-9]``; review-side names lose the
    "add to compare" phrase first."""
    low = F.lower(_c(name))
    if review_side:
        low = F.replace(low, F.lit(S.NAME_NOISE_PHRASE), F.lit(""))
    return F.regexp_replace(low, "[^a-z0-9]", "")


def name_tokens(name) -> Column:
    """distinct ``[a-z0-9]+`` tokens of the lower-cased name, minus the
    stop tokens (first-seen order)."""
    toks = F.regexp_extract_all(F.lower(_c(name)), F.lit("[a-z0-9]+"), 0)
    return F.array_except(toks, F.array(*[F.lit(s) for s in S.NAME_STOP_TOKENS]))


def tokens_overlap(a, b, ratio: float = S.OVERLAP_RATIO) -> Column:
    """both token sets non-empty and
    ``|a ∩ b| >= min(|a|, |b|) * ratio`` (double arithmetic)."""
    a, b = _c(a), _c(b)
    na, nb = F.size(a), F.size(b)
    return (na > 0) & (nb > 0) & (
        F.size(F.array_intersect(a, b)) >= F.least(na, nb) * F.lit(float(ratio)))


def names_match(t_norm, r_norm, t_tokens, r_tokens, compat: bool = False) -> Column:
    """J1 predicate on prepared columns: containment of normalised names
    either way, else token overlap.  By default an empty normalised name
    matches nothing (``compat=True`` keeps the original "contained in
    everything" behaviour)."""
    t_norm, r_norm = _c(t_norm), _c(r_norm)
    contain = F.contains(r_norm, t_norm) | F.contains(t_norm, r_norm)
    if not compat:
        contain = contain & (F.length(t_norm) > 0) & (F.length(r_norm) > 0)
    return F.coalesce(contain, F.lit(False)) | F.coalesce(tokens_overlap(t_tokens, r_tokens), F.lit(False))


# ------------------------------------------------------ review text

def _any_contains(low: Column, words: Sequence[str]) -> Column:
    out = None
    for w in words:
        e = F.contains(low, F.lit(w))
        out = e if out is None else (out | e)
    return out if out is not None else F.lit(False)


def detect_category(text, categories=S.CATEGORIES, lowered=None) -> Column:
    """the first category any of whose keywords occurs in the text
    (lower-cased substring test); empty or missing text -> General.
    ``lowered``: the text already lower-cased in an earlier projection, so
    it is computed once per row rather than once per CASE branch."""
    t = _c(text)
    low = _c(lowered) if lowered is not None else F.lower(t)
    expr = F.when(t.isNull() | (t == ""), F.lit(S.DEFAULT_CATEGORY))
    for name, words in categories:
        expr = expr.when(_any_contains(low, words), F.lit(name))
    return expr.otherwise(F.lit(S.DEFAULT_CATEGORY))


def sentiment_score(text, positive=S.POSITIVE_WORDS, negative=S.NEGATIVE_WORDS, lowered=None) -> Column:
    """Number of positive words present minus negative words present
    (substring test, each word counted once)."""
    low = _c(lowered) if lowered is not None else F.lower(_c(text))
    pos = sum((F.contains(low, F.lit(w)).cast("int") for w in positive), F.lit(0))
    neg = sum((F.contains(low, F.lit(w)).cast("int") for w in negative), F.lit(0))
    return pos - neg


def rule_sentiment(text, positive=S.POSITIVE_WORDS, negative=S.NEGATIVE_WORDS, lowered=None) -> Column:
    """struct(label, confidence): score > 1 Positive .75, < -1 Negative
    .75, else Neutral .5; empty or missing text Neutral .5."""
    return rule_from_score(text, sentiment_score(_c(text), positive, negative, lowered))


def rule_from_score(text, score) -> Column:
    """F5 labels from a precomputed lexicon score."""
    t, score = _c(text), _c(score)
    empty = t.isNull() | (t == "")
    label = (F.when(empty, F.lit("Neutral")).when(score > 1, F.lit("Positive"))
             .when(score < -1, F.lit("Negative")).otherwise(F.lit("Neutral")))
    conf = F.when(empty, F.lit(0.5)).when((score > 1) | (score < -1), F.lit(0.75)).otherwise(F.lit(0.5))
    return F.struct(label.alias("label"), conf.alias("confidence"))


# --------------------------------------------------- classifier replies

def capitalize(s) -> Column:
    """Python ``str.capitalize``: first character upper, the rest lower."""
    s = _c(s)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substr(s, F.lit(2))))


def parse_llm_label(response) -> Column:
    """struct(label, confidence) from a classifier reply, or NULL.

    The first ``{...}`` without nested braces is read as JSON; the label is
    capitalised and must be one of the three labels; a missing confidence
    counts 0.0 and an unreadable one invalidates the reply.
    """
    obj = F.regexp_extract(_c(response), r"\{[^{}]*\}", 0)
    raw_label = F.get_json_object(obj, "$.sentiment")
    raw_conf = F.get_json_object(obj, "$.confidence")
    label = capitalize(F.coalesce(raw_label, F.lit("")))
    has_conf = F.coalesce(F.array_contains(F.json_object_keys(obj), "confidence"), F.lit(False))
    # float(): a missing key is 0.0, JSON true/false are 1.0/0.0, null fails.
    conf = (F.when(~has_conf, F.lit(0.0))
            .when(raw_conf == "true", F.lit(1.0)).when(raw_conf == "false", F.lit(0.0))
            .otherwise(raw_conf.try_cast("double")))
    # A reply is JSON only if some key could be read back.
    is_json = F.get_json_object(obj, "$").isNotNull()
    ok = is_json & label.isin(*S.SENTIMENT_LABELS) & conf.isNotNull()
    return F.when(ok, F.struct(label.alias("label"), conf.alias("confidence")))


# ------------------------------------------------------- page text

NUMERIC_REF = r"&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"


def _code_point(ref: Column) -> Column:
    n = F.length(ref)
    is_hex = F.lower(F.substring(ref, 3, 1)) == "x"
    return F.when(is_hex, F.conv(F.substring(ref, 4, n - 4), 16, 10).cast("long")) \
        .otherwise(F.substring(ref, 3, n - 3).cast("long"))


def html_unescape_basic(s) -> Column:
    """Decode numeric character references (``&#233;``, ``&#xE9;``) of
    printable code points, then the named ``&lt; &gt; &quot; &amp;``
    (``&amp;`` last)."""
    s = _c(s)
    refs = F.array_distinct(F.regexp_extract_all(s, F.lit(NUMERIC_REF), 0))

    def put(acc, ref):
        cp = _code_point(ref)
        printable = ((cp >= 0x20) & (cp <= 0x7E)) | ((cp >= 0xA0) & (cp <= 0xD7FF)) | \
            ((cp >= 0xE000) & (cp <= 0x10FFFF))
        ch = F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")
        return F.when(printable, F.replace(acc, ref, ch)).otherwise(acc)
    s = F.aggregate(refs, s, put)
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        s = F.replace(s, F.lit(ent), F.lit(ch))
    return s


ASCII_WS = r"[ \t\n\r\f\x{0B}]"
WORD_EDGE_L = r"(^|[^A-Za-z0-9_])"
WORD_EDGE_R = r"([^A-Za-z0-9_]|$)"


def strip_ws(s) -> Column:
    """Python ``str.strip()`` for ASCII whitespace."""
    return F.regexp_replace(_c(s), f"^{ASCII_WS}+|{ASCII_WS}+$", "")


def title_product_name(html, default: str = S.DEFAULT_PRICE_PRODUCT) -> Column:
    """page title minus "Price History", trimmed; no title -> default."""
    title = F.regexp_extract(_c(html), r"(?is)<title[^>]*>(.*?)</title>", 1)
    has_title = F.regexp_like(_c(html), F.lit(r"(?is)<title[^>]*>.*?</title>"))
    name = strip_ws(F.replace(html_unescape_basic(title), F.lit(S.TITLE_SUFFIX), F.lit("")))
    return F.when(has_title, name).otherwise(F.lit(default))


def review_text(title, body) -> Column:
    """``title - body`` when there is a title, else the body."""
    t = _c(title)
    return F.when(t.isNotNull() & (t != ""), F.concat_ws(" - ", t, _c(body))).otherwise(_c(body))


def clean_text(t) -> Column:
    """collapse whitespace runs to one space and trim; NULL -> ''."""
    return F.coalesce(F.trim(F.regexp_replace(_c(t), WHITESPACE_CLASS, " ")), F.lit(""))


def is_dated_or_digits(txt, compat: bool = False) -> Column:
    """Relative dates ("ago"), month names, digits and commas only.

    Month names and "ago" match as words by default; ``compat=True`` uses
    the original substring test (which also hits "Decent", "Chicago").
    """
    t = _c(txt)
    if compat:
        dated = F.contains(t, F.lit("ago")) | F.regexp_like(t, F.lit(S.MONTH_PATTERN))
    else:
        # The plain search goes first: few texts hold such a word, and a pattern
        # with two open edges is tried at every character.
        months = S.MONTH_PATTERN.strip("()").split("|")
        month = reduce(or_, [F.contains(t, F.lit(m)) for m in months])
        dated = (F.contains(t, F.lit("ago")) & F.regexp_like(t, F.lit(WORD_EDGE_L + "ago" + WORD_EDGE_R))
                 | month & F.regexp_like(t, F.lit(WORD_EDGE_L + S.MONTH_PATTERN + WORD_EDGE_R)))
    return F.coalesce(dated | F.regexp_like(t, F.lit(r"^[0-9,]+$")), F.lit(True))


def is_noise_text(txt, rating=None, compat: bool = False) -> Column:
    """text that cannot be a review title/body: the fixed button and
    badge texts, the rating itself, dates and bare numbers, or one character
    or less."""
    t = _c(txt)
    fixed = t.isin(S.READ_MORE, S.CERTIFIED_BUYER)
    if rating is not None:
        fixed = fixed | (t == _c(rating))
    return F.coalesce(fixed | is_dated_or_digits(t, compat) | (F.length(t) <= 1), F.lit(True))
