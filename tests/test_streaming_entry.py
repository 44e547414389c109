import duckdb

from conftest import SF_SMALL, rows
from pricelens import adapters as A
from pricelens.operators import alerts as AL
from pricelens.operators import series as ser
from pricelens.streaming import jobs as J
from pricelens.streaming.live_alerts import run_alerts

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def test_stream_alerts_equal_batch(spark):
    valid, _ = AL.split_valid(A.subscription_requests(spark, SF_SMALL))
    ticks = J.tick_stream(spark, SF_SMALL, "events.parquet")
    reqs = J.request_stream(spark, SF_SMALL, "events.parquet")
    got = run_alerts(spark, ticks, reqs)[0]
    assert rows(got) == rows(AL.first_fire(valid, A.price_obs(spark, SF_SMALL)))


def test_stream_daily_equal_batch(spark):
    ticks = J.tick_stream(spark, SF_SMALL, "events.parquet")
    got = J.run_to_table(spark, J.daily_last_stream(ticks), "t-daily", "update", sink=J.upsert_by_day())
    assert rows(got, "product_name", "ds", "y") == rows(ser.daily_last_price(A.price_obs(spark, SF_SMALL)),
                                                        "product_name", "ds", "y")


def test_entry_and_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs) and len(qs) >= 60


def test_oracle_sample_at_small_scale(spark):
    import __spark_entry__ as E
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    qs, sqls = E.queries(), E.oracle_sql()
    for name in ["price_status", "decision", "match_reviews", "forecast_quantile", "alerts_first_fire",
                 "decode_price_pages", "metric_r2"]:
        s = qs[name](spark, SF_SMALL).toPandas()
        d = con.execute(sqls[name]).df()
        assert sorted(s.columns) == sorted(d.columns), name
        cols = sorted(s.columns)
        key = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))
        assert key(s) == key(d), name


def _land_in_time_order(spark, parts=4, reverse=False):
    """The events landed as ``parts`` files in time order (one per trigger),
    or newest first with ``reverse``."""
    import time as _t

    from pyspark.sql import functions as F

    from pricelens.session import scratch_path
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    land = scratch_path(spark, "t-landing")
    bounds = ev.select(F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()[0]
    step = (bounds.hi - bounds.lo) / parts
    for k in (reversed(range(parts)) if reverse else range(parts)):
        lo, hi = bounds.lo + step * k, bounds.lo + step * (k + 1)
        part = ev.where((F.col("ts") >= lo) & ((F.col("ts") < hi) if k < parts - 1 else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(land)
        _t.sleep(1.1)
    return land


def test_stream_daily_upsert_across_micro_batches(spark):
    land = _land_in_time_order(spark)
    ticks = J.tick_stream(spark, land, "*.parquet", max_files_per_trigger=1)
    got = J.run_to_table(spark, J.daily_last_stream(ticks), "t-daily-mb", "update", sink=J.upsert_by_day())
    assert rows(got, "product_name", "ds", "y") == rows(ser.daily_last_price(A.price_obs(spark, SF_SMALL)),
                                                        "product_name", "ds", "y")


def test_stream_alerts_across_micro_batches(spark):
    land = _land_in_time_order(spark)
    ticks = J.tick_stream(spark, land, "*.parquet", max_files_per_trigger=1)
    reqs = J.request_stream(spark, land, "*.parquet", max_files_per_trigger=1)
    got, late = run_alerts(spark, ticks, reqs)
    assert late.count() == 0
    valid, _ = AL.split_valid(A.subscription_requests(spark, SF_SMALL))
    assert rows(got) == rows(AL.first_fire(valid, A.price_obs(spark, SF_SMALL)))


def test_stream_alerts_exact_when_files_arrive_in_reverse_time_order(spark):
    land = _land_in_time_order(spark, reverse=True)
    ticks = J.tick_stream(spark, land, "*.parquet", max_files_per_trigger=1)
    reqs = J.request_stream(spark, land, "*.parquet", max_files_per_trigger=1)
    got = run_alerts(spark, ticks, reqs, lateness="40 days")[0]
    valid, _ = AL.split_valid(A.subscription_requests(spark, SF_SMALL))
    assert rows(got) == rows(AL.first_fire(valid, A.price_obs(spark, SF_SMALL)))


def test_ingest_stream_is_exactly_once_across_restarts(spark):
    from pyspark.sql import functions as F

    from pricelens.session import scratch_path
    from pricelens.plans import landing as L
    pages = L.price_pages(A.price_obs(spark, SF_SMALL))
    land = scratch_path(spark, "t-land")
    root = scratch_path(spark, "t-ingest")
    first = pages.where(F.col("url") < "https://pricehistory.app/p/user_5")
    rest = pages.subtract(first)
    first.write.mode("append").parquet(land)
    n1 = J.run_to_table(spark, J.ingest_stream(spark, land), "ingest", root=root).count()
    rest.write.mode("append").parquet(land)
    out = J.run_to_table(spark, J.ingest_stream(spark, land), "ingest", root=root)
    # a third run with nothing new changes nothing
    J.run_to_table(spark, J.ingest_stream(spark, land), "ingest", root=root)
    total = A.price_obs(spark, SF_SMALL).count()
    assert 0 < n1 < total and out.count() == total
    assert spark.read.parquet(root + "/table").count() == total


def test_upsert_sink_replaces_by_key_and_is_idempotent(spark):
    from pricelens.session import scratch_path
    out = scratch_path(spark, "t-upsert") + "/t"
    sink = J.upsert_partitions(("k",), "p")
    b1 = spark.createDataFrame([(1, "a", 10.0), (2, "a", 20.0), (3, "b", 30.0)], "k long, p string, v double")
    sink(b1, out)
    sink(b1, out)                                   # replay: same table
    assert rows(spark.read.parquet(out), "k", "p", "v") == [(1, "a", 10.0), (2, "a", 20.0), (3, "b", 30.0)]
    b2 = spark.createDataFrame([(2, "a", 21.0), (4, "a", 40.0)], "k long, p string, v double")
    sink(b2, out)                                   # partition b untouched
    assert rows(spark.read.parquet(out), "k", "p", "v") == [(1, "a", 10.0), (2, "a", 21.0), (3, "b", 30.0),
                                                            (4, "a", 40.0)]


def test_streams_over_a_table_of_several_files(spark, tmp_path):
    from pricelens.plans import load_all
    spark.read.parquet(f"{SF_SMALL}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    build = load_all()["stream_daily_last"].build
    assert rows(build(spark, str(tmp_path))) == rows(build(spark, SF_SMALL))


def test_update_mode_needs_a_keyed_sink(spark):
    import pytest
    with pytest.raises(ValueError):
        J.run_to_table(spark, J.daily_last_stream(J.tick_stream(spark, SF_SMALL, "events.parquet")), "daily", "update")
