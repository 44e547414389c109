"""Reviews: fuzzy product matching (J1), per-product limits (O4, O5),
sentiment/category labelling (F4-F9) and distributions (A1-A3).

J1 at scale
-----------
The match predicate (containment of normalised names either way, or token
overlap >= 70% of the smaller token set) is not an equi-join.  Instead of a
nested loop over all name pairs, candidates come from equi-joins on blocking
keys that are *lossless* for the predicate, and every candidate is then
checked with the exact predicate:

* containment ``a ⊂ b`` (``len(a) >= 3``): every 3-gram of ``a`` occurs in
  ``b``, so ``a``'s rarest 3-gram (by how many names on the other side hold
  it) is a sufficient key; names of 1-2 characters key on themselves
  against the other side's 1- and 2-grams.
* overlap: with ``req(m) = ceil(0.7 m)`` shared tokens needed and
  ``m = min(|A|, |B|)``, the smaller set shares a token with the larger one
  within its first ``m - req(m) + 1`` tokens in any fixed global order
  (prefix filtering).  Ordering tokens rare-first keeps hot tokens out of
  the join keys.

Only distinct names are matched; the matched name pairs are then joined
back to the reviews.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as T


# ------------------------------------------------------------------ names

def prepare_names(df: DataFrame, col: str, prefix: str, review_side: bool) -> DataFrame:
    """Distinct names with normalised form and token set."""
    n = df.select(F.col(col).alias(f"{prefix}_name")).where(F.col(f"{prefix}_name").isNotNull()).distinct()
    return n.select(f"{prefix}_name",
                    T.normalize_name(F.col(f"{prefix}_name"), review_side).alias(f"{prefix}_norm"),
                    T.name_tokens(F.col(f"{prefix}_name")).alias(f"{prefix}_tokens"))


def _grams(s: Column, k: int) -> Column:
    """Distinct k-grams of a string (empty when shorter than k)."""
    return F.when(F.length(s) >= k, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substring(s, i, k)))) \
        .otherwise(F.array().cast("array<string>"))


def _containment_candidates(inner: DataFrame, i_name: str, i_norm: str,
                            outer: DataFrame, o_name: str, o_norm: str) -> DataFrame:
    """Name pairs (inner, outer) that may satisfy ``inner_norm ⊂ outer_norm``.
    Lossless: every true pair with a non-empty inner name is produced.

    Outer names are exploded into 3-grams only; their 1- and 2-grams are
    needed (and exploded) only when some inner name is that short, which is
    checked on the small distinct-name table first.
    """
    og3 = outer.select(o_name, F.explode(_grams(F.col(o_norm), 3)).alias("gram"))
    df3 = og3.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    long_inner = inner.where(F.length(i_norm) >= 3).select(
        i_name, F.explode(_grams(F.col(i_norm), 3)).alias("gram"))
    # The rarest gram; a gram absent from the outer side means no match.
    keyed = (long_inner.join(df3, "gram", "left")
             .groupBy(i_name)
             .agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("gram"),
                  F.min(F.coalesce("df", F.lit(0))).alias("df"))
             .where(F.col("df") > 0).select(i_name, "gram"))
    cands = keyed.join(og3, "gram").select(i_name, o_name)
    short_inner = inner.where(F.length(i_norm).between(1, 2)).select(i_name, F.col(i_norm).alias("gram"))
    if not short_inner.isEmpty():
        og12 = outer.select(o_name, F.explode(F.array_union(_grams(F.col(o_norm), 2),
                                                            _grams(F.col(o_norm), 1))).alias("gram"))
        cands = cands.unionByName(short_inner.join(og12, "gram").select(i_name, o_name))
    return cands


def _token_prefix(names: DataFrame, name: str, tokens: str, freq: DataFrame,
                  ratio: float) -> DataFrame:
    """(name, token, size) for the first ``m - ceil(m*ratio) + 1`` tokens of
    each name in rare-first order."""
    ex = names.select(name, F.size(tokens).alias("size"), F.explode(tokens).alias("tok"))
    ex = ex.join(freq, "tok")
    w = Window.partitionBy(name).orderBy("freq", "tok")
    plen = F.col("size") - F.ceil(F.col("size") * F.lit(float(ratio))) + 1
    return ex.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= plen) \
        .select(name, "tok", "size")


def _overlap_candidates(t: DataFrame, r: DataFrame, ratio: float) -> DataFrame:
    toks = t.select(F.explode("t_tokens").alias("tok")).unionAll(
        r.select(F.explode("r_tokens").alias("tok")))
    freq = toks.groupBy("tok").agg(F.count(F.lit(1)).alias("freq"))
    t_all = t.select("t_name", F.size("t_tokens").alias("t_size"), F.explode("t_tokens").alias("tok"))
    r_all = r.select("r_name", F.size("r_tokens").alias("r_size"), F.explode("r_tokens").alias("tok"))
    t_pre = _token_prefix(t, "t_name", "t_tokens", freq, ratio).withColumnRenamed("size", "t_size")
    r_pre = _token_prefix(r, "r_name", "r_tokens", freq, ratio).withColumnRenamed("size", "r_size")
    c1 = t_pre.join(r_all, "tok").where(F.col("r_size") >= F.col("t_size")).select("t_name", "r_name")
    c2 = r_pre.join(t_all, "tok").where(F.col("t_size") >= F.col("r_size")).select("t_name", "r_name")
    return c1.unionByName(c2)


def match_names(targets: DataFrame, reviews: DataFrame, target_col: str = "product_name",
                review_col: str = "product_name", ratio: float = S.OVERLAP_RATIO,
                materialize: str = "checkpoint") -> DataFrame:
    """J1 on distinct names: ``(t_name, r_name)`` pairs that match.

    Equi-join blocking + exact verification (see module doc); no pair of
    names is enumerated unless it shares a blocking key.  The two distinct
    name tables feed six candidate branches, so they are materialized once.
    """
    from ..session import materialize as mat
    t = mat(prepare_names(targets, target_col, "t", review_side=False), materialize)
    r = mat(prepare_names(reviews, review_col, "r", review_side=True), materialize)
    cands = (_containment_candidates(t, "t_name", "t_norm", r, "r_name", "r_norm")
             .unionByName(_containment_candidates(r, "r_name", "r_norm", t, "t_name", "t_norm"))
             .unionByName(_overlap_candidates(t, r, ratio))
             .distinct())
    v = cands.join(t, "t_name").join(r, "r_name")
    return v.where(T.names_match("t_norm", "r_norm", "t_tokens", "r_tokens")).select("t_name", "r_name")


def match_reviews(targets: DataFrame, reviews: DataFrame, target_col: str = "product_name") -> DataFrame:
    """Every review matched to every target product it fuzzily names.

    Output: the review columns with ``product_name`` = target and
    ``review_product`` = the name the review was listed under.
    """
    pairs = match_names(targets, reviews, target_col, "product_name")
    rv = reviews.withColumnRenamed("product_name", "review_product")
    j = pairs.join(rv, pairs.r_name == rv.review_product)
    return j.select(F.col("t_name").alias("product_name"), *[c for c in rv.columns])


# --------------------------------------------------------------- limits

def first_per_product(reviews: DataFrame, n: int = S.MAX_REVIEWS_ANALYSED,
                      order: str = "seq", key: str = "product_name") -> DataFrame:
    """The first ``n`` reviews of each product in storage order.
    Spark plans a per-group limit before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(key).orderBy(order)
    return reviews.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


# ----------------------------------------------------------- labelling

def classifier_responses(reviews: DataFrame, classifier, model_rank: int = 1,
                         text_col: str = "review_text") -> DataFrame:
    """Replies from a user classifier in place of the remote model.

    ``classifier(texts: pandas.Series) -> pandas.Series`` of reply texts is
    run on Arrow batches (``mapInPandas``); its replies feed
    ``analyze_reviews(responses=...)`` like stored ones.
    """
    def run(batches):
        import pandas as pd
        for pdf in batches:
            yield pd.DataFrame({"review_id": pdf["review_id"], "model_rank": model_rank,
                                "response_text": classifier(pdf[text_col]).astype("string")})
    return reviews.select("review_id", text_col).mapInPandas(
        run, "review_id long, model_rank int, response_text string")


def llm_labels(responses: DataFrame) -> DataFrame:
    """F6/F7 (model part): per review, the label of the best-ranked model
    whose reply parses to a valid label."""
    parsed = responses.select("review_id", "model_rank",
                              T.parse_llm_label(F.col("response_text")).alias("p")).where(F.col("p").isNotNull())
    return parsed.groupBy("review_id").agg(F.min_by("p", "model_rank").alias("llm"))


def analyze_reviews(reviews: DataFrame, responses: DataFrame | None = None,
                    positive=S.POSITIVE_WORDS, negative=S.NEGATIVE_WORDS,
                    categories=S.CATEGORIES, text_col: str = "review_text") -> DataFrame:
    """adds ``sentiment``, ``confidence``, ``category`` to each review.

    F7 cascade: stored classifier replies (``responses``: review_id,
    model_rank, response_text) first, else the rule lexicon (F5).  F8: when
    the input already carries both ``sentiment`` and ``category`` those are
    kept.  The category (F4) is computed from the text.

    Everything derived from the text (lexicon score, rule label, category)
    is computed before the join with the replies, so a caller that keeps
    only ids and labels does not move review text through that shuffle.
    """
    text = F.col(text_col)
    # Lower-case once per row; every keyword test reads this column.
    df = reviews.withColumn("_low", F.lower(text))
    df = df.withColumn("_score", T.sentiment_score(text, positive, negative, lowered=F.col("_low")))
    rule = T.rule_from_score(text, F.col("_score"))
    df = df.withColumns({"_rl": rule["label"], "_rc": rule["confidence"],
                         "_cat": T.detect_category(text, categories, lowered=F.col("_low"))}).drop("_low", "_score")
    label, conf, cat = F.col("_rl"), F.col("_rc"), F.col("_cat")
    if responses is not None:
        df = df.join(llm_labels(responses), "review_id", "left")
        label = F.coalesce(F.col("llm.label"), label)
        conf = F.when(F.col("llm").isNotNull(), F.col("llm.confidence")).otherwise(conf)
    new = {"sentiment": label, "confidence": conf, "category": cat}
    if "sentiment" in reviews.columns and "category" in reviews.columns:
        keep = F.col("sentiment").isNotNull() & F.col("category").isNotNull()
        old_conf = F.col("confidence") if "confidence" in reviews.columns else F.lit(None).cast("double")
        new = {"sentiment": F.when(keep, F.col("sentiment")).otherwise(label),
               "confidence": F.when(keep, old_conf).otherwise(conf),
               "category": F.when(keep, F.col("category")).otherwise(cat)}
    df = df.withColumns(new).drop("_rl", "_rc", "_cat")
    if "llm" in df.columns:
        df = df.drop("llm")
    return df


def sentiment_counts(analyzed: DataFrame, key: str = "product_name") -> DataFrame:
    """A1/A3: per product the three label counts (0 when absent), total and
    positive ratio (0 without reviews).  Unknown labels count as Neutral."""
    s = F.col("sentiment")
    neutral = ~s.isin("Positive", "Negative") | s.isNull()
    agg = analyzed.groupBy(key).agg(
        F.count_if(s == "Positive").alias("positive"),
        F.count_if(neutral).alias("neutral"),
        F.count_if(s == "Negative").alias("negative"),
        F.count(F.lit(1)).alias("total"),
    )
    ratio = F.when(F.col("total") > 0, F.col("positive") / F.col("total")).otherwise(F.lit(0.0))
    return agg.withColumn("positive_ratio", ratio)


def category_counts(analyzed: DataFrame, key: str = "product_name") -> DataFrame:
    """A2: per product and seen category, the number of reviews."""
    return analyzed.groupBy(key, "category").agg(F.count(F.lit(1)).alias("n"))


def label_counts(analyzed: DataFrame, by: list[str], key: str = "product_name") -> DataFrame:
    """Reviews of each listed name by the columns ``by``: ``(r_name, *by, n)``.
    The reviews meet nothing else, so this is one partial aggregate."""
    return analyzed.groupBy(F.col(key).alias("r_name"), *by).agg(F.count(F.lit(1)).alias("n"))


def counts_by_target(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """J1 on counts: the rows of ``label_counts`` for every target whose name
    matches, ``product_name`` and ``n`` summed.  Name pairs join label counts;
    no review row is multiplied or shuffled again."""
    by = [c for c in counts.columns if c not in ("r_name", "n")]
    return (counts.join(pairs, "r_name").groupBy(F.col("t_name").alias("product_name"), *by)
            .agg(F.sum("n").alias("n")))


def sentiment_totals(counts: DataFrame) -> DataFrame:
    """A1/A3 from counts by sentiment ``(product_name, sentiment, n)``."""
    s, n = F.col("sentiment"), F.col("n")
    agg = counts.groupBy("product_name").agg(
        F.coalesce(F.sum(F.when(s == "Positive", n)), F.lit(0)).alias("positive"),
        F.coalesce(F.sum(F.when(s.isNull() | ~s.isin("Positive", "Negative"), n)), F.lit(0)).alias("neutral"),
        F.coalesce(F.sum(F.when(s == "Negative", n)), F.lit(0)).alias("negative"),
        F.sum("n").alias("total"))
    return agg.withColumn("positive_ratio", F.when(F.col("total") > 0, F.col("positive") / F.col("total")).otherwise(F.lit(0.0)))


def review_sources(obs: DataFrame) -> DataFrame:
    """Review rows of the observation table (prunes the other source)."""
    return obs.where(F.col("source") == S.SOURCE_REVIEWS)
