"""One product holding a large share of all rows: results must not change."""

from pyspark.sql import functions as F

from conftest import rows
from naive import first_fire_naive
from pricelens.operators import alerts as AL
from pricelens.operators import series as ser

SF = "/root/testdata/sf0.01"


def skewed_ticks(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    hot = F.col("event_type").isin("view", "click")
    return e.select(F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("user_"), F.col("user_id").cast("string")))
                    .alias("product_name"), F.col("ts").cast("timestamp").alias("ts"),
                    F.col("value").alias("price"), F.col("event_id").alias("seq"))


def test_daily_series_under_skew_matches_pandas(spark):
    t = skewed_ticks(spark)
    share = t.where("product_name = 'hot'").count() / t.count()
    assert share > 0.3
    got = {(r.product_name, str(r.ds)): r.y for r in ser.daily_series(t).collect()}
    pdf = t.toPandas().sort_values(["product_name", "ts", "seq", "price"])
    pdf["ds"] = pdf["ts"].dt.normalize()
    want = {}
    for name, g in pdf.groupby("product_name"):
        d = g.drop_duplicates("ds", keep="last").set_index("ds")["price"].asfreq("D").ffill()
        want.update({(name, str(k.date())): v for k, v in d.items()})
    assert got == want


def test_first_fire_under_skew_matches_naive(spark):
    t = skewed_ticks(spark)
    req = t.where(F.pmod("seq", F.lit(50)) == 0).select(
        F.concat(F.lit("e"), F.pmod("seq", F.lit(7)).cast("string"), F.lit("@x")).alias("email"),
        "product_name", (F.col("price") - 3.0).alias("target_price"), F.col("ts").alias("sub_ts"), "seq")
    assert rows(AL.first_fire(req, t)) == rows(first_fire_naive(req, t))
    assert AL.upsert_state(req).where("product_name = 'hot'").count() == 7
