from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from pricelens import adapters as A
from pricelens import api


def test_api_over_one_observation_table(spark):
    obs = A.observations(spark, SF_SMALL)
    names = [r.product_name for r in api.list_products(obs).collect()]
    assert names == sorted(names) and len(names) > 0
    one = api.load_product_price_data(obs, products=names[0])
    assert {r.product_name for r in one.select("product_name").distinct().collect()} == {names[0]}
    ans = api.run_forecast(obs, products=names[:3], model="chronos", periods=5)
    assert ans.result.forecast.count() == 5 * ans.eligibility.where("status = 'ok'").count()
    assert api.run_forecast(obs, products=names[:1], model="other").result is None
    dec = api.make_decision(obs)
    assert dec.count() > 0 and set(dec.columns) >= {"product_name", "decision", "reason", "current_price"}
    reqs = A.subscription_requests(spark, SF_SMALL)
    state, bad = api.subscribe(reqs)
    assert state.count() > 0 and bad.count() > 0
    assert api.check_alerts(obs, reqs).where(F.col("current_price") > F.col("target_price")).count() == 0
    pg = api.preview(obs, page=2, search="user_1")
    assert pg.page == 2 and pg.rows.count() == 50


def test_api_ingest_round_trip(spark):
    from pricelens.plans import landing as L
    pages = L.price_pages(A.price_obs(spark, SF_SMALL))
    obs, rejected = api.ingest_price_pages(pages)
    assert rejected.count() == 0
    assert obs.count() == A.price_obs(spark, SF_SMALL).count()


def test_trend_floor_clamps(spark):
    import datetime as dt

    from pricelens.operators import forecast as FC
    s = spark.createDataFrame([("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(30 - i)) for i in range(20)],
                              "product_name string, ds date, y double")
    fut = FC.trend_seasonal(s, periods=30, floor=0.0).forecast
    assert fut.where(F.col("predicted_price") < 0).count() == 0
    assert rows(FC.trend_seasonal(s, periods=30).forecast.where(F.col("predicted_price") < 0), "h")
