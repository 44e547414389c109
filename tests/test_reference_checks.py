"""The original application's own checks (status and keys of its five
endpoints), restated for the DataFrame API: same questions, same shapes."""

from conftest import SF_SMALL
from pricelens import adapters as A
from pricelens import api
from pricelens.operators import reviews as R


def test_product_list_has_products(spark):
    obs = A.observations(spark, SF_SMALL)
    assert api.list_products(obs).columns == ["product_name"]


def test_unknown_product_is_not_found(spark):
    obs = A.observations(spark, SF_SMALL)
    ans = api.run_forecast(obs, products=["NonExistentProduct12345"])
    assert [r.status for r in ans.eligibility.collect()] == ["not_found"]
    assert ans.history.count() == 0


def test_sentiment_result_structure(spark):
    revs = A.reviews(spark, SF_SMALL)
    counts = R.sentiment_counts(R.analyze_reviews(revs))
    assert {"positive", "neutral", "negative", "total", "positive_ratio"} <= set(counts.columns)
    analyzed = R.analyze_reviews(revs)
    assert {"sentiment", "confidence", "category"} <= set(analyzed.columns)


def test_preview_structure(spark):
    obs = A.observations(spark, SF_SMALL)
    pg = api.preview(obs, page=1, page_size=50)
    assert set(vars(pg)) == {"rows", "total_rows", "page", "page_size", "total_pages"}
    assert pg.rows.count() == 50 and pg.total_pages == (pg.total_rows + 49) // 50
