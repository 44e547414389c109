import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from pricelens import schemas as S
from pricelens.operators import decision as dec
from pricelens.operators import series as ser


def ticks(spark, data):
    return spark.createDataFrame(
        [(p, dt.datetime.fromisoformat(t) if t else None, v, i) for i, (p, t, v) in enumerate(data)],
        "product_name string, ts timestamp, price double, seq long")


F_SERIES = [("A", "2024-01-01 08:00", 10.0), ("A", "2024-01-01 20:00", 11.0), ("A", "2024-01-04 01:00", 9.0)]


def test_daily_last_and_densify(spark):
    s = ser.daily_series(ticks(spark, F_SERIES))
    got = rows(s, F.date_format("ds", "yyyy-MM-dd"), "y")
    assert got == [("2024-01-01", 11.0), ("2024-01-02", 11.0), ("2024-01-03", 11.0), ("2024-01-04", 9.0)]


def test_last_of_day_tiebreak_by_seq_then_price(spark):
    df = ticks(spark, [("A", "2024-01-01 08:00", 5.0), ("A", "2024-01-01 08:00", 7.0)])
    assert rows(ser.daily_last_price(df), "y") == [(7.0,)]


def test_price_status(spark):
    st = dec.price_stats(ser.daily_series(ticks(spark, F_SERIES))).collect()[0]
    assert st.current_price == 9.0 and st.median_price == 11.0 and st.price_status == "Good"


def test_coerce_keeps_parseable_rows(spark):
    obs = spark.createDataFrame(
        [("2024-01-01", "A", 1.0, 1), ("2024-01-02T10:00:00.5", "A", 2.0, 2), ("junk", "A", 3.0, 3),
         (None, "A", 4.0, 4), ("2024-01-03", "A", None, 5)],
        "timestamp string, product_name string, price double, seq long")
    got = rows(ser.coerce_observations(obs), "seq")
    assert got == [(1,), (2,)]


def test_densify_has_no_gaps_property(spark):
    from pricelens import adapters as A
    s = ser.daily_series(A.price_obs(spark, "/root/testdata/sf0.001"))
    chk = s.groupBy("product_name").agg(F.count("*").alias("n"), F.countDistinct("ds").alias("d"),
                                        F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    bad = chk.where((F.col("n") != F.col("d")) | (F.datediff("hi", "lo") + 1 != F.col("n")))
    assert bad.count() == 0


def test_split_and_calendar(spark):
    data = [("A", f"2024-01-{d:02d} 10:00", float(d)) for d in range(1, 11)]
    s = ser.daily_series(ticks(spark, data))
    folds = dict(rows(ser.train_test_split(s).groupBy("fold").count()))
    assert folds == {"train": 8, "test": 2}
    cal = rows(ser.future_calendar(s, 3), "h", F.date_format("ds", "yyyy-MM-dd"))
    assert cal == [(1, "2024-01-11"), (2, "2024-01-12"), (3, "2024-01-13")]


def test_eligibility_gate(spark):
    data = [("A", f"2024-01-{d:02d} 10:00", 1.0) for d in range(1, 11)] + [("B", "2024-01-01 00:00", 1.0)]
    e = dict(rows(ser.forecast_eligibility(ser.daily_series(ticks(spark, data))), "product_name", "status"))
    assert e == {"A": "ok", "B": "too_short"}
    assert S.MIN_HISTORY_POINTS == 10


def test_point_lookup_and_source_pruning_reach_the_scan(spark):
    from pricelens import adapters as A
    from pricelens.operators import reviews as R
    from pricelens.session import scratch_path
    from pricelens.sources import store as ST
    path = scratch_path(spark, "t-store")
    ST.append_observations(A.observations(spark, "/root/testdata/sf0.001"), path)
    obs = ST.scan_observations(spark, path)
    plan = ser.price_points(obs, "user_3")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(product_name,user_3)" in plan
    plan = R.review_sources(obs)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "flipkart_reviews" in plan
    assert ser.price_points(obs, "user_3").count() > 0


def test_eligibility_reports_unknown_requested_products(spark):
    data = [("A", f"2024-01-{d:02d} 10:00", 1.0) for d in range(1, 11)]
    req = spark.createDataFrame([("A",), ("nope",)], "product_name string")
    e = dict(rows(ser.forecast_eligibility(ser.daily_series(ticks(spark, data)), requested=req),
                  "product_name", "status"))
    assert e == {"A": "ok", "nope": "not_found"}


def test_series_in_date_order(spark):
    import __spark_entry__ as E
    got = [(r.product_name, r.ds) for r in E.queries()["daily_series"](spark, SF_SMALL).collect()]
    assert len(got) > 100 and got == sorted(got)
