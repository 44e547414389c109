from pyspark.sql import functions as F

from pricelens.functions import text as T
from pricelens.operators import reviews as R


def match_names_nested(targets, reviews, target_col: str = "product_name",
                       review_col: str = "product_name", compat: bool = False):
    """Brute-force J1 over all name pairs.  For checking ``match_names`` on
    small fixtures and for the original's ``compat`` behaviour; it
    evaluates |targets| x |reviews| pairs, so it is not for large inputs."""
    t = R.prepare_names(targets, target_col, "t", review_side=False)
    r = R.prepare_names(reviews, review_col, "r", review_side=True)
    return t.join(r, T.names_match("t_norm", "r_norm", "t_tokens", "r_tokens", compat)) \
        .select("t_name", "r_name")


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(expr(F.col("v")).alias("o")).collect()[0].o


def test_normalize_and_tokens(spark):
    assert one(spark, lambda c: T.normalize_name(c, True), "Add to CompareFoo 12 (Blue, 8 GB)") == "foo12blue8gb"
    assert one(spark, lambda c: T.normalize_name(c, False), "Add to Compare X") == "addtocomparex"
    assert one(spark, T.name_tokens, "Foo foo TO add 12") == ["foo", "12"]


F_MATCH = [("Add to CompareFoo 12 (Blue, 8 GB)", True), ("foo12", True), ("GB 8 Blue Foo", True),
           ("Bar 12", False), (None, False), ("Продукт", False)]


def _match_pairs(spark, fn):
    t = spark.createDataFrame([("Foo 12 (Blue, 8 GB)",)], "product_name string")
    r = spark.createDataFrame([(n,) for n, _ in F_MATCH], "product_name string")
    return {x.r_name for x in fn(t, r).collect()}


def test_fuzzy_match_fixture_blocked_and_nested(spark):
    want = {n for n, ok in F_MATCH if ok}
    assert _match_pairs(spark, R.match_names) == want
    assert _match_pairs(spark, match_names_nested) == want


def test_compat_mode_matches_empty_names(spark):
    t = spark.createDataFrame([("Foo",)], "product_name string")
    r = spark.createDataFrame([("Продукт",)], "product_name string")
    assert match_names_nested(t, r, compat=True).count() == 1
    assert match_names_nested(t, r).count() == 0


def test_blocked_equals_nested_on_driver_names(spark):
    from pricelens import adapters as A
    d = "/root/testdata/sf0.01"
    targets = A.part_price_obs(spark, d).select("product_name").unionByName(
        A.reviews(spark, d).select("product_name"))
    revs = A.reviews(spark, d)
    a = {tuple(x) for x in R.match_names(targets, revs).collect()}
    b = {tuple(x) for x in match_names_nested(targets, revs).collect()}
    assert a == b and len(a) > 0


def test_blocked_equals_nested_random_names(spark):
    import random
    rnd = random.Random(7)
    words = ["ab", "abc", "blue", "red", "x", "pro", "max", "12", "8gb", "add", "to", "compare"]
    names = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 5))) for _ in range(150)]
    t = spark.createDataFrame([(n,) for n in names[:60]], "product_name string")
    r = spark.createDataFrame([(n,) for n in names[60:]], "product_name string")
    a = {tuple(x) for x in R.match_names(t, r).collect()}
    b = {tuple(x) for x in match_names_nested(t, r).collect()}
    assert a == b


def test_rule_sentiment_fixture(spark):
    cases = {"good nice phone": ("Positive", 0.75), "good phone": ("Neutral", 0.5),
             "bad slow waste": ("Negative", 0.75), "good good good": ("Neutral", 0.5),
             "": ("Neutral", 0.5), None: ("Neutral", 0.5)}
    for text, want in cases.items():
        got = one(spark, T.rule_sentiment, text)
        assert (got.label, got.confidence) == want, text


def test_category_fixture(spark):
    cases = {"battery lag": "Battery", "color": "Display", "build": "Design", "cheat": "Battery",
             "xyz": "General", None: "General", "": "General"}
    for text, want in cases.items():
        assert one(spark, T.detect_category, text) == want, text


def test_llm_parse_fixture(spark):
    ok = one(spark, T.parse_llm_label, 'ok {"sentiment":"POSITIVE","confidence":"0.9"}')
    assert (ok.label, ok.confidence) == ("Positive", 0.9)
    assert one(spark, T.parse_llm_label, '{"sentiment":"Happy","confidence":1}') is None
    assert one(spark, T.parse_llm_label, '{"sentiment":"neutral","confidence":"high"}') is None
    miss = one(spark, T.parse_llm_label, '{"sentiment":"negative"}')
    assert (miss.label, miss.confidence) == ("Negative", 0.0)
    assert one(spark, T.parse_llm_label, "no json here") is None


def test_cascade_prefers_first_valid_model(spark):
    reviews = spark.createDataFrame([(1, "bad slow waste"), (2, "good nice"), (3, "meh")],
                                    "review_id long, review_text string")
    resp = spark.createDataFrame(
        [(1, 1, '{"sentiment":"Happy"}'), (1, 2, '{"sentiment":"positive","confidence":0.8}'),
         (2, 1, "garbage"), (3, 2, '{"sentiment":"negative","confidence":0.6}'),
         (3, 1, '{"sentiment":"neutral","confidence":0.7}')],
        "review_id long, model_rank int, response_text string")
    got = {r.review_id: (r.sentiment, r.confidence) for r in R.analyze_reviews(reviews, resp).collect()}
    assert got == {1: ("Positive", 0.8), 2: ("Positive", 0.75), 3: ("Neutral", 0.7)}


def test_keep_existing_labels(spark):
    df = spark.createDataFrame([(1, "bad slow waste", "Positive", "Camera", 0.9),
                                (2, "bad slow waste", None, "Camera", None)],
                               "review_id long, review_text string, sentiment string, category string, confidence double")
    got = {r.review_id: (r.sentiment, r.category) for r in R.analyze_reviews(df).collect()}
    assert got == {1: ("Positive", "Camera"), 2: ("Negative", "Performance")}


def test_clean_text_and_title(spark):
    assert one(spark, T.clean_text, "  a\t b\n\nc  ") == "a b c"
    assert one(spark, T.clean_text, None) == ""
    assert one(spark, T.title_product_name, "<html><title> Foo &amp; Bar Price History </title>") == "Foo & Bar"
    assert one(spark, T.title_product_name, "<html><body>no title</body>") == "Flipkart Product"


def test_noise_text(spark):
    noisy = ["READ MORE", "Certified Buyer", "2 months ago", "Dec 2023", "1,234", "x", ""]
    clean = ["Decent phone", "Chicago style", "Great value"]
    for t in noisy:
        assert one(spark, T.is_noise_text, t) is True, t
    for t in clean:
        assert one(spark, T.is_noise_text, t) is False, t
    assert one(spark, lambda c: T.is_noise_text(c, compat=True), "Decent phone") is True


def test_review_text_assembly(spark):
    df = spark.createDataFrame([("T", "B"), ("", "B"), (None, "B")], "t string, b string")
    assert [r.o for r in df.select(T.review_text(F.col("t"), F.col("b")).alias("o")).collect()] == ["T - B", "B", "B"]


def test_user_classifier_feeds_cascade(spark):
    reviews = spark.createDataFrame([(1, "love it"), (2, "meh")], "review_id long, review_text string")

    def clf(texts):
        return texts.map(lambda t: '{"sentiment": "positive", "confidence": 0.66}' if "love" in t else "n/a")
    resp = R.classifier_responses(reviews, clf)
    got = {r.review_id: (r.sentiment, r.confidence) for r in R.analyze_reviews(reviews, resp).collect()}
    assert got == {1: ("Positive", 0.66), 2: ("Neutral", 0.5)}


def test_llm_confidence_edge_cases(spark):
    assert one(spark, T.parse_llm_label, '{"sentiment":"neutral","confidence":null}') is None
    t = one(spark, T.parse_llm_label, '{"sentiment":"negative","confidence":true}')
    assert (t.label, t.confidence) == ("Negative", 1.0)
    s = one(spark, T.parse_llm_label, '{"sentiment":"positive","confidence":" 0.25 "}')
    assert (s.label, s.confidence) == ("Positive", 0.25)


def test_title_numeric_references(spark):
    html = "<title>Caf&#233; &#x2013; 5&#8482; &amp;amp; &#1; Price History</title>"
    assert one(spark, T.title_product_name, html) == "Café – 5™ &amp; &#1;"
